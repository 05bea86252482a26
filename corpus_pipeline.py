"""A cleaning pipeline over `documents`: toxicity, SimHash near-dedup, benchmark decontamination, secret scan, packing.

Each stage takes what its predecessor kept; all but the last return the columns of `documents`. Null texts count as empty everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treedex.llm import common, decontaminate, packing, secrets, simhash, toxicity


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no column of the table clashes with an operator's and a text goes to a worker once."""
    common.prepare(docs.sparkSession)
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))


def _restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects (score of 0.5 or more). It learns from labelled documents of docs."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return _restored(toxicity.predict(_carried(docs), model, ["text", "_row"]).filter("predicted = 0"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a similarity of 0.8 or more of their sets of five words: wide SimHash fingerprints find pairs, the sets decide.

    That row has the group's smallest doc_id, or none if no row has one. Rows of other groups stay, even if they share that doc_id or have none; of rows with
    one id and one text one stays. The join and the distinct rows share one exchange of the texts, by doc_id and the text's hash; null ids stand as 0
    there, with hashes of their own.
    """
    common.prepare(spark)
    key = {"_id": F.coalesce("doc_id", F.lit(0)), "_hash": F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))}
    found = simhash.similar(docs.select("doc_id", "text", *(x.alias(c) for c, x in key.items())), keep=list(key))
    # a text has one fingerprint and a fingerprint one group, so an id and a hash name a row of one group
    own = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = common.written(own.groupBy("root").agg(F.min(F.struct("fp", *key)).alias("x")).select(*(f"x.{c}" for c in key)), "kept")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    row = docs.select(whole.alias("_row"), *(x.alias(c) for c, x in key.items())).join(first, list(key), "left_semi")
    return row.dropDuplicates(list(key)).select("_row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    found = decontaminate.decontaminate(_carried(docs), common.table(spark, sf_dir, "benchmark"), ["text", "_row"])
    return _restored(found.filter(~F.col("contaminated")), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows."""
    out = secrets.redact_documents(_carried(docs), ["_row"])
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_secrets") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids, with their ids as little-endian unsigned 32-bit integers."""
    common.prepare(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("secrets", without_secrets), ("packing", packed)]

#: Learned scores, fingerprints and tokens are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = common.written(stage(spark, docs, sf_dir), name)
        if i:  # the stage before this one's table
            common.dropped(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

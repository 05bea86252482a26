"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, decontaminate, divergence, language, mixing, neighbours, packing, repeats, secrets, simhash, token_output, toxicity, warc, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return common.table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(_documents(spark, sf_dir), text=False)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan_documents(_documents(spark, sf_dir)))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-files")
    token_output.write(_documents(spark, sf_dir), path)
    return token_output.digests(spark, path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    files = warc.write_pages(common.table(spark, sf_dir, "pages"), common.shared_path(spark, "warc"))
    return warc.page_digests(warc.read(spark, files))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.predict(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return neighbours.search(common.table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), ids=False)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return whitening.whitened(common.table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_secret_scan, op4_token_output, op5_warc, op6_simhash, op7_toxicity, op8_decontaminate, op9_neighbours, op10_packing, op11_whitening, op12_mixing, op13_divergence)}

SQL = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
        m AS (SELECT payload_digest AS k, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to
        FROM d LEFT JOIN m ON payload_digest = k AND payload_bytes >= 1000""",
    "op8_decontaminate": r"""
        WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
        sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, sizes WHERE len(w) >= n)),
        found AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows v ON g.k = v.k AND g.n = v.n),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY 1),
        named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM lowered LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
        s AS (SELECT source, sum(size)::HUGEINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w FROM d GROUP BY source),
        r AS (SELECT *, 3 * sum(n) OVER () - 4 * (sum(n) OVER upto - n) AS above, 2 * (sum(w) OVER () - sum(w) OVER upto + w) AS below
              FROM s WINDOW upto AS (ORDER BY n::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT above AS a, below AS b FROM r WHERE 2 * n * below > w * above ORDER BY n::DOUBLE / w, source NULLS LAST LIMIT 1),
        t AS (SELECT source, n, CASE WHEN 2 * n * b > w * a THEN w::DOUBLE * a::DOUBLE / b::DOUBLE ELSE (2 * n)::DOUBLE END AS target,
                     CASE WHEN 2 * n * b > w * a THEN w * a // b ELSE 2 * n END AS budget FROM s LEFT JOIN l ON true),
        p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM d)
        SELECT doc_id, size, n::BIGINT AS source_size, target,
               (CASE WHEN n = 0 THEN 0 ELSE budget // n * size + greatest(0, least(size, budget % n - place)) END)::BIGINT AS taken
        FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        v AS (SELECT lang, count(*) AS terms, sum(n) AS n FROM kept GROUP BY lang),
        g AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT c.* FROM c JOIN kept USING (lang, term)) USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.n + 5 * v.terms) AS p, 1 + 1000000000 * (k.n + 5) // (v.n + 5 * v.terms) AS q
              FROM g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
                  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
}

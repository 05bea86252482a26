"""Patterns in Python's dialect against Python itself, and many terms at once against one pattern at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from treedex.functions import patterns, text as T
from treedex.operators import search

PATTERNS = [
    "abc", "a|b", "x y", r"(?P<n>a)(?P=n)", r"(?P<a_b>x)\d\1?", r"(a)(b)?\1", r"a\Z", r"\Aab", "a$", "^b", r"(a)?b(?(1)c|d)", r"(?P<q>')?x(?(q)')", r"(a)?(?(1)b)", r"((a)|b)(?(2)c|d)", "(?i:A)b", "(?-i:a)b", "(?s:a.b)", "a.b",
    "a(?#no)b", "a{2}", "a{,2}b", "a{1,}", "a{x", "{a}", "a{}", "}", "]", "[]]a", "[^]]a", "[[a]", "[a&&b]", "[a b]", r"[\w.]+", r"[^\s]a", r"[\S]", r"a\sb", r"\x61", r"ab", r"\U00000061", r"\141", r"\0", r"[\b]a", r"a\vb", r"\tb",
    r"(?:a|b)++c", "(?>a+)b", "a*?b", r"\N{LATIN SMALL LETTER A}b", r"\é", r"[\-a]b", r"a\.b", r"\[a\]", r"(?<=a)b", "(?<!a)b", "a(?=b)", "a(?!b)", r"\Bb", r"\ba", "é", r"\w+é", r"\d+", "[a-c]{2,3}?",
]
WRONG = ["(", "[", "a)", r"\p{L}", r"\Qa\E", r"\h", r"\k<n>", "a**", "(?P<n>a", "(?(1)a)", "[z-a]", "(?P<a>x)(?P<a>y)", "a(?i)b", "(?<n>a)", r"\z"]
TEXTS = [
    "", "abc", "a", "b", "aa", "ab", "aab", "abab", "ABC ab", "x y", "x  y", "x1x", "'x'", "x", "bc", "bd", "abcx abd", "abc\nb", "a\nb", "a.b", "a\x0bb", "a\x1cb", "a\tb", "a{x", "{a}", "a{}", "]a", "[a", "&a", "a b", "\x00", "\x08a", "bbc", "aaab",
    "é", "Éa", "café", "٣", "a\n", "ab\n", "a\rb", "a\x85b", "-b", "a_b", "ba", "aba", "cab", "ac ad", "a.b]", "[a]", "ß", "ſ",
]


@pytest.fixture(scope="module")
def pairs(spark):
    good = [p for p in PATTERNS if patterns.valid(p)]
    rows = [(i, t, T.boundary(p), T.raw_pattern(p)) for i, p in enumerate(good) for t in TEXTS]
    f = spark.createDataFrame(rows, "i int, t string, b string, r string").repartition(4)
    return good, f.select("i", "t", F.regexp_like("t", F.col("b")).alias("b"), F.regexp_like("t", F.col("r")).alias("r")).collect()


def test_as_python(pairs):
    good, got = pairs
    assert len(good) == len(PATTERNS)
    wrong = [(good[r.i], r.t, form) for r in got for form, p in (("b", rf"\b(?:{good[r.i]})\b"), ("r", good[r.i])) if bool(re.search(p, r.t, re.I)) != getattr(r, form)]
    assert not wrong


def test_wrong_patterns(spark):
    assert not any(search.valid_patterns(spark, WRONG).values())
    for p in ("(", "a)", r"[\p{L}]("):
        with pytest.raises(ValueError):
            patterns.java(p)


def test_plain_patterns_stay():
    assert patterns.java("the") == "the" and patterns.java("a|b c-d") == "a|b c-d"


WORDS = ["the", "The", "straße", "STRASSE", "weiß", "WEIẞ", "İx", "ix", "ıx", "K", "k", "ſo", "so", "ﬁn", "fin", "Σας", "σασ", "a_b", "a-b", "a b", "a  b", "ét", "ét", "x‍y", "ⓐ", "1a", "ᾳ", "ᾼ", "ŉ", "né", "C3"]
TERMS = [*WORDS, "the|so", "a b|k", "x y|", "t.e", "a.*b", r"a\-b", "'the", "-", "no such", "the so", r"(?P<z>s)o", "weiss", "i̇x", "n[eé]"]


def test_many_terms_as_one_by_one(spark):
    rng = random.Random(4)
    texts = [None, "", *WORDS, *(rng.choice([" ", ", ", "-", "'", "_", ""]).join(rng.choice(WORDS) for _ in range(rng.randrange(1, 6))) for _ in range(300))]
    f = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    each = F.filter(F.array(*(F.when(F.col("t").rlike(T.boundary(x)), F.lit(i)) for i, x in enumerate(TERMS))), lambda x: x.isNotNull())
    rows = f.select("t", F.array_sort(search.matched_terms(F.col("t"), TERMS)).alias("got"), each.alias("want")).collect()
    assert all(r.got == r.want for r in rows if r.t is not None), [r for r in rows if r.got != r.want][:5]
    assert all(not r.got for r in rows if r.t is None)


def test_words_that_a_term_needs():
    assert search.required_words("the") == [("THE", True)] and search.required_words("big data|it") == [("DATA", False), ("IT", True)]
    assert search.required_words(r"c\+\+") == [("C", False)] and search.required_words("a.b") is None and search.required_words("a|") is None and search.required_words("straße") is None


def test_letters_with_two_capitals():
    odd = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower().upper() != c.upper()]
    assert "".join(odd) == search._ODD and all(a.lower().replace("\u0307", "") == b for a, b in zip(search._ODD, search._SMALL, strict=True))


def test_shared_stems(spark):
    """Leaves below one term, a term that is stem and leaf, sequences of one to four terms, against sequence by sequence."""
    rng = random.Random(9)
    nodes = []
    for f in range(6):
        levels = [rng.randrange(1, 5) for _ in range(30)]
        for i, v in enumerate(levels):
            last = next((j for j in range(i + 1, len(levels)) if levels[j] <= v), len(levels))
            nodes.append((f"f{f}", i + 1, last, x := " ".join(rng.sample("abcde", rng.randrange(0, 4))), x))
    n = spark.createDataFrame(nodes, "file_path string, pre bigint, last bigint, text string, search_text string").cache()
    sequences = [["a"], ["a", "b"], ["a", "c"], ["a", "a"], ["a", "b", "c"], ["a", "b", "d"], ["b", "b", "b"], ["c", "a", "b", "e"], ["nothing", "a"], ["e"]]
    together = sorted((r.sequence, r.file_path, r.pre) for r in search.search_multiple(n, sequences).collect())
    apart = sorted((":".join(s), r.file_path, r.pre) for s in sequences for r in search.search_sequence(n, s).collect())
    assert together == apart
    counts = {(r.sequence, r.file_path, r.pre): r.times for r in search.search_counts(n, sequences).collect()}
    assert counts == {k: together.count(k) for k in set(together)}
    assert search.search_counts(n, []).count() == 0 and search.search_multiple(n, [[]]).count() == 0


def test_a_chain_is_counted_not_multiplied(spark):
    chain = spark.range(1, 20_001).selectExpr("'f' AS file_path", "id AS pre", "20000L AS last", "'the' AS text", "'the' AS search_text")
    r = search.search_counts(chain, [["the", "the"]]).agg(F.count("*").alias("n"), F.sum("times").alias("t")).first()
    assert (r.n, r.t) == (20_000, 20_000 * 20_001 // 2)

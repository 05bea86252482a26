"""The secret scan's columns against the patterns of its definition, rows that meet at a keyword, keys of any length, and the measured share of false discoveries."""

import hashlib
import random
import re

from treedex.llm import common, secrets

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
WORDS = "user config server handle request parse json update status connection timeout value buffer size event listener array index product thread pool der die und nicht mit para los que wird sein".split()


def base(text):
    """By the definition: each kind's matches from left to right, then those that are long enough."""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def identifier(rng):
    while True:
        ws = [rng.choice(WORDS) for _ in range(rng.randint(3, 6))]
        ws.insert(rng.randint(0, len(ws)), str(rng.randint(0, 99999)))
        s = rng.choice(["_".join(ws), "-".join(ws), "/".join(ws), "".join(w.capitalize() for w in ws), "_".join(ws).upper()])
        if len(s) >= 20 and re.search("[A-Za-z]", s):
            return s


def key(rng, n):
    return "".join(rng.choice(secrets.ALPHABETS[3]) for _ in range(n))


def test_columns_by_definition(spark):
    common.prepare(spark)
    rng = random.Random(5)
    parts = ["a secre", "token=abcdef", "Secret", ": 'x9_.=-abc'", "api_key=", "APIKEY = zzzzzz", "pass", "word:123456", "AKIA" + "Z9" * 9, "AKIAX", "f0" * 13, "0123456789abcdef0123456", "ſecret=abcdef", "token=short", "é ", "", "tokentoken=1234567 secret=token=abcdefg"]
    texts = [*parts, None, *("".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 6))) for _ in range(600)), "x " * 40000 + "secret=" + "q" * 50000, key(rng, 10000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    for r in secrets.digest_columns(secrets.scan_documents(docs)).collect():
        want = base(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[3] == k for w in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in joined.split(",") if x]
        if r.doc_id == len(texts) - 1:
            assert r.spans == "random:0:10000"


def test_power():
    rng = random.Random(1)
    for n, least in ((32, 0.9), (40, 0.95), (64, 0.99), (600, 1.0), (10000, 1.0)):
        keys = [key(rng, n) for _ in range(200 if n < 1000 else 20)]
        assert sum(secrets.random_spans(k, [(0, n)]) == [(0, n)] for k in keys) >= least * len(keys)


def test_false_discoveries():
    rng = random.Random(2)
    plain = [identifier(rng) for _ in range(1500)]
    assert sum(bool(secrets.random_spans(s, [(0, len(s))])) for s in plain) <= 0.03 * len(plain)
    false = found = 0
    for _ in range(300):
        items = [(identifier(rng), False) for _ in range(rng.randint(1, 12))] + [(key(rng, rng.choice([24, 32, 40, 64])), True) for _ in range(rng.randint(0, 3))]
        rng.shuffle(items)
        text, spans = "", {}
        for s, real in items:
            spans[len(text), len(text) + len(s)] = real
            text += s + " "
        got = secrets.random_spans(text, list(spans))
        false, found = false + sum(not spans[x] for x in got), found + len(got)
    assert false <= secrets.FALSE_DISCOVERY * found and found > 200

"""Runs against the definition, word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from vitrine.llm import periodic_runs


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w):
    """Every stretch that no neighbour extends with its smallest period."""
    out = []
    for s in range(len(w)):
        for e in range(s + 6, len(w) + 1):
            q = smallest_period(w[s:e])
            if e - s >= max(6, 4 * q) and (s == 0 or w[s - 1] != w[s - 1 + q]) and (e == len(w) or w[e] != w[e - q]):
                out.append((s, e - s, q))
    return sorted(out)


def want(text, key):
    w = (text or "").encode().split()
    h = zlib.crc32(str(key).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    gone = {j for s, n, q in found for j in range(s + q, s + n)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())


def test_runs_against_the_definition():
    rng = random.Random(7)
    docs = []
    for _ in range(300):
        w = [rng.randrange(rng.choice((1, 2, 2, 3, 30))) for _ in range(rng.randrange(30))]
        unit = [rng.randrange(2) for _ in range(rng.randrange(1, 9))]
        docs.append((w + unit * rng.randrange(9) + w[: rng.randrange(9)])[:60])
    ends = np.cumsum([0, *map(len, docs)])
    found = periodic_runs.runs(np.array([x for w in docs for x in w]), ends)
    assert found == [(s + int(ends[i]), n, q) for i, w in enumerate(docs) for s, n, q in brute(w)] and len(found) > 200


def test_long_periods_and_hot_words():
    rng = random.Random(8)
    unit = [rng.randrange(2) for _ in range(5_000)]
    x = np.array([9] * 100_000 + unit * 5 + [7] + unit * 3 + [8, 9] * 50_000)
    got = periodic_runs.runs(x, np.array([0, len(x)]))
    assert (0, 100_000, 1) in got and (125_000 + 1 + 15_000, 100_000, 2) in got
    assert [r for r in got if r[2] == 5_000] == [(100_000, 25_000, 5_000)]


def test_query_shape_and_edges(spark):
    rng = random.Random(9)
    texts = {i: " ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for i in range(150)}
    texts |= {200: "", 201: None, 202: " \t\n", 203: "A\x0bA A\rA  A A", 204: "x " * 40, 205: "é\xa0é " * 7, 206: "one two", 207: "a a a a a", 208: "  " * 6}
    rows = [(i, t, 1, "x") for i, t in texts.items()] + [(None, "b b b b b b", 1, "x"), (0, texts[0], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string")
    out = periodic_runs.digests(periodic_runs.find(periodic_runs.repeated(docs))).collect()
    assert len(out) == len(rows)
    for r in out:
        key = r.doc_id
        got = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        # A row without a key is not changed: key 1 is one that leaves texts alone.
        assert got == want(texts[key] if key is not None else "b b b b b b", key if key is not None else 1), key
    assert zlib.crc32(b"1") % 10
    plain = {r.doc_id: r.collapsed for r in periodic_runs.find(docs).collect()}
    assert plain[203] == "A" and plain[204] == "x" and plain[207] == "a a a a a"
    assert periodic_runs.digests(periodic_runs.find(periodic_runs.repeated(docs.limit(0)))).count() == 0


def test_a_long_text(spark):
    rng = random.Random(10)
    text = " ".join(str(rng.randrange(1000)) for _ in range(200_000)) + " a b c" * 1000
    r = periodic_runs.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert r.runs[-1] == (200_000, 3000, 3) and r.collapsed.endswith("a b c") and len(r.collapsed.split()) == 200_003

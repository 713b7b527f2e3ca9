"""Reliabilities against a plain EM, the classifier against its formula, and planted accidents."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import pii


def plain_em(instances, rounds=50):
    """EM over single candidates of one kind, with dictionaries."""
    n = len(instances)
    weight = n / 50 + 1
    clip = lambda x, low, high: min(high, max(low, x))
    q = [clip(0.5 + 0.2 * sum(v), 0.05, 0.95) for v in instances]
    for _ in range(rounds):
        prior = clip(sum(q) / n, 0.1, 0.9)
        seen = [{(1, True): 0.8 * weight, (-1, True): 0.2 * weight, (-1, False): 0.8 * weight, (1, False): 0.2 * weight} for _ in instances[0]]
        for votes, p in zip(instances, q):
            for j, v in enumerate(votes):
                if v:
                    seen[j][v, True] += p
                    seen[j][v, False] += 1 - p
        sure = [(clip(s[1, True] / (s[1, True] + s[-1, True]), 0.7, 0.99), clip(s[-1, False] / (s[1, False] + s[-1, False]), 0.7, 0.99)) for s in seen]
        q = []
        for votes in instances:
            yes, no = prior, 1 - prior
            for v, (a, b) in zip(votes, sure):
                if v:
                    yes, no = yes * (a if v == 1 else 1 - a), no * (b if v == -1 else 1 - b)
            q.append(yes / (yes + no))
    return q


def test_reliabilities_are_those_of_a_plain_em():
    rng = random.Random(1)
    right = (0.9, 0.8, 0.7, 0.6, 0.85)
    instances = []
    for _ in range(600):
        truth = rng.random() < 0.6
        instances.append(tuple(0 if rng.random() < 0.3 else (1 if truth else -1) * (1 if rng.random() < r else -1) for r in right))
    counts = Counter(instances)
    got, tables = pii.reliabilities([("card", v, n) for v, n in sorted(counts.items())])
    want = dict(zip(instances, plain_em(instances)))
    assert all(abs(got["card", v] - p) < 1e-9 for v, p in want.items())
    assert tables["card"].shape == (5, 2) and tables["card"][0][0] > 0.85  # the first labeler is right nine times of ten


def test_one_vote_against_is_heard_where_all_others_agree():
    posterior, _ = pii.reliabilities([("secret", (0, 0, 1, 0, 0), 500), ("secret", (0, 0, -1, 0, 0), 1)])
    assert posterior["secret", (0, 0, 1, 0, 0)] > 0.95 > pii.ADD_FROM > posterior["secret", (0, 0, -1, 0, 0)]


def iban(rng, country="DE"):
    body = "".join(rng.choice("0123456789") for _ in range(pii.IBAN_CHARS[country] - 4))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02d}{body}"


@pytest.fixture(scope="module")
def planted(spark):
    """(kind, whether it is one, text, what is to be found) of texts with one span each."""
    rng = random.Random(2)
    hexed = lambda n: hashlib.sha512(str(rng.random()).encode()).hexdigest()[:n]
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = []
    for i in range(60):
        good, bad = iban(rng), iban(rng)
        bad = bad[:10] + str((int(bad[10]) + 1) % 10) + bad[11:]
        token, commit = hexed(40), hexed((32, 40, 64)[i % 3])
        phone = f"0{rng.randrange(150, 180)} {digits(7)}"
        area = f"{rng.randrange(1, 600):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}"
        six = ":".join(["2001", "db9", *(f"{rng.randrange(65536):x}" for _ in range(6))])
        key = f"sk-{hashlib.md5(str(rng.random()).encode()).hexdigest()}"
        out += [
            ("iban", True, f"pay to IBAN {good} today", good), ("iban", False, f"part number {bad} in stock", bad),
            ("secret", True, f'token = "{token}" here', token), ("secret", False, f"see md5 commit {commit} for this", commit),
            ("secret", False, f"sha checksum: {commit} of the file", commit), ("secret", True, f"api key {key}", key),
            ("phone", True, f"call me, phone {phone}, bye", phone), ("phone", False, f"order {digits(3)} {digits(7)} items", None),
            ("ssn", True, f"his SSN {area} is on file", area), ("ssn", False, f"part 000-{digits(2)}-{digits(4)}", None),
            ("ipv6", True, f"the host {six} answers", six), ("email", True, f"mail to jo{i} (at) example (dot) com please", f"jo{i} (at) example (dot) com"),
            ("secret", True, f"password: hunter{i}!x now", f"password: hunter{i}!x"),
            ("email", True, f"mail a{i}@b.com", f"a{i}@b.com"), ("card", False, f"invoice 1234567890123{(0, 2, 4, 5, 6, 8, 9)[i % 7]}", None)]
    df = spark.createDataFrame([(i, x[2]) for i, x in enumerate(out)], "doc_id long, text string")
    return out, df, {r.doc_id: r.spans for r in pii.find(df).collect()}


def test_planted_spans_are_added_and_accidents_are_not(planted):
    out, _, found = planted
    caught, total = Counter(), Counter()
    for i, (kind, real, text, span) in enumerate(out):
        total[kind, real] += 1
        if real:
            start = text.index(span)
            caught[kind, real] += any(s.s <= start and s.e >= start + len(span) for s in found[i])
        else:
            caught[kind, real] += any(s.kind == kind for s in found[i])
    print({k: (caught[k], n) for k, n in total.items()})
    for (kind, real), n in total.items():
        assert caught[kind, real] >= 0.95 * n if real else caught[kind, real] <= 0.05 * n, (kind, real, caught[kind, real], n)


def test_the_classifier_is_its_formula(spark, planted):
    _, df, found = planted
    seen = pii.detect(df).cache()
    weights = pii.fit(seen)
    rows = seen.select("id", F.explode("found").alias("x")).select("id", "x.*", pii.probability(weights, F.col("x")).alias("p")).collect()
    assert len(rows) > 500
    for r in rows:
        z = weights[0] + sum(w for (name, value), w in zip(pii._cells(), weights[1:], strict=True) if (r.kind if name == "kind" else r.v[name]) == value)
        assert abs(r.p - 1 / (1 + np.exp(-z))) < 1e-9
        assert all(0 <= r.v[name] < values for name, values in pii.FEATURES.items())
    # Added are the candidates from the limit on, and no others.
    want = {(r.id, r.kind, r.s, r.e) for r in rows if r.base or r.p >= pii.ADD_FROM}
    assert {(i, s.kind, s.s, s.e) for i, spans in found.items() for s in spans} == want


def test_candidates_against_patterns(spark, planted):
    """Loose candidates are the matches of their pattern that touch no base span."""
    out, df, _ = planted
    got = {}
    for r in pii.detect(df).select("id", F.explode("found").alias("x")).where("x.base = false").select("id", "x.kind", "x.s", "x.e").collect():
        got.setdefault(r.id, set()).add((r.kind, r.s, r.e))
    base = {}
    for r in pii.detect(df).select("id", F.explode("found").alias("x")).where("x.base").select("id", "x.s", "x.e").collect():
        base.setdefault(r.id, []).append((r.s, r.e))
    for kind in ("iban", "ssn", "card", "email"):
        pattern = re.compile(pii.LOOSE[kind])
        for i, (*_, text, _) in enumerate(out):
            want = {(kind, *m.span()) for m in pattern.finditer(text) if not any(s < m.end() and m.start() < e for s, e in base.get(i, []))}
            assert {x for x in got.get(i, set()) if x[0] == kind} == want, text


def test_checks(spark):
    rng = random.Random(3)
    rows = [(iban(rng, c), True) for c in ("DE", "FR", "GB", "NO") for _ in range(5)]
    rows += [(x[:-1] + str((int(x[-1]) + 1) % 10), False) for x, _ in rows if x[-1].isdigit()]
    out = spark.createDataFrame(rows, "x string, ok boolean").select("ok", pii.iban_check(F.col("x")).alias("got")).collect()
    assert all(r.ok == r.got for r in out)


NAMES = ["found", "spans", "_t", "_email", "_ip", "_card", "_phone", "_loose", "_base", "doc", "id", "cleaned", "t", "base", "loose", "base_email"]


def test_redaction_keeps_columns_of_any_name(spark):
    row = (1, "to a@b.com", 10, *(f"mine {n}" for n in NAMES))
    df = spark.createDataFrame([row, (None, None, None, *([None] * len(NAMES)))], "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES))
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "to [EMAIL]" and out[1].n_chars == 10 and pii.redact(df).schema == df.schema
    assert all(out[1][n] == f"mine {n}" and out[None][n] is None for n in NAMES) and out[None].text is None

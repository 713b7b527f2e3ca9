"""As-of and interval joins, sessions, ranks, bags and cubes against loops, with hot keys and small chunks."""

import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from vitrine.operators import bags, ordering, ranks, temporal

T0 = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_place_counts_bounds(spark):
    bounds = [3, 5, 5, 9]
    got = {r.x: r.p for r in spark.range(12).select(F.col("id").alias("x"), ordering.place(F.col("id"), bounds).alias("p")).collect()}
    assert got == {x: sum(b <= x for b in bounds) for x in range(12)}
    assert spark.range(3).select(ordering.place(F.col("id"), []).alias("p")).distinct().collect()[0].p == 0


@pytest.mark.parametrize("chunk_rows", [5, 10**6])
def test_asof_join_with_a_hot_key(spark, chunk_rows):
    rng = random.Random(1)
    key = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b", "only_left", None])
    left = [(i, key(), rng.choice([rng.randrange(300), rng.randrange(300), None]) if i % 9 == 0 else rng.randrange(300)) for i in range(300)]
    right = [(1000 + i, "right" if i % 20 == 0 else key(), None if i % 17 == 0 else rng.randrange(60) * 5, None if i % 11 == 0 else i) for i in range(120)]
    right = [r for r in right if r[1] != "only_left"]
    a = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "id long, k string, t timestamp")
    b = spark.createDataFrame([(i, k, at(t), v) for i, k, t, v in right], "id long, k string, t timestamp, v int")
    out = temporal.asof_join(a, b, ["k"], "t", "t", {"found": "id", "v": "v"}, tie=["id"], chunk_rows=chunk_rows)
    got = {r.id: (r.found, r.v) for r in out.collect()}
    assert len(got) == len(left) == out.count()
    for i, k, t in left:
        best = max(((u, j, v) for j, kk, u, v in right if k is not None and t is not None and kk == k and u is not None and u <= t), key=lambda r: r[:2], default=(None, None, None))
        assert got[i] == best[1:], (i, k, t)
    assert temporal.asof_join(a, b.limit(0), ["k"], "t", "t", {"found": "id"}).where("found IS NOT NULL").count() == 0
    assert temporal.asof_join(a.limit(0), b, ["k"], "t", "t", {"found": "id"}).count() == 0


def test_asof_window_is_cut_into_chunks(spark):
    a = spark.createDataFrame([("hot", at(i)) for i in range(400)], "k string, t timestamp")
    out = temporal.asof_join(a, a.withColumnRenamed("t", "u"), ["k"], "t", "u", {"found": "u"}, chunk_rows=20)
    assert out.where("found = t").count() == 400
    chunks = a.select(temporal.time_chunk([(a, "t")], F.col("t"), 20).alias("c")).groupBy("c").count()
    assert chunks.count() > 10 and chunks.agg(F.max("count")).first()[0] < 120


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_interval_join_over_many_bins(spark, width):
    rng = random.Random(2)

    def spans(n):
        out = []
        for i in range(n):
            start = rng.randrange(-500, 500)
            long = rng.choice([0, 0, rng.randrange(5), rng.randrange(60), rng.randrange(1500)])
            out.append((i, rng.choice(["hot", "hot", "hot", "a", None]), None if rng.random() < 0.03 else start, start + long - (2 if rng.random() < 0.05 else 0)))
        return out

    left, right = spans(150), spans(130)
    a, b = (spark.createDataFrame(x, "id long, k string, s long, e long") for x in (left, right))
    met = temporal.interval_join(a, b, ["k"], ("s", "e"), ("s", "e"), width)
    got = Counter((r.left.id, r.right.id) for r in met.collect())
    want = Counter()
    for x, y in product(left, right):
        if None in (x[1], x[2], y[1], y[2]) or x[1] != y[1] or x[2] > x[3] or y[2] > y[3]:
            continue
        if x[2] <= y[3] and y[2] <= x[3]:
            want[x[0], y[0]] += 1
    assert got == want and len(want) > 500
    assert "NestedLoop" not in plan(met) and "Cartesian" not in plan(met)
    points = temporal.interval_join(a, b, [], ("s", "e"), ("s", "s"), width)
    assert points.count() == sum(x[2] <= y[2] <= x[3] for x, y in product(left, right) if None not in (x[2], y[2]))


def test_a_long_interval_has_few_copies(spark):
    """One span over a million bins: two copies on its level, and as many rows as pairs."""
    a = spark.createDataFrame([(0, 1_000_000)], "s long, e long")
    b = spark.range(0, 1_000_000, 1000).select(F.col("id").alias("s"), F.col("id").alias("e"))
    assert temporal.interval_join(a, b, [], ("s", "e"), ("s", "e"), 1).count() == 1000


@pytest.mark.parametrize("chunk_rows", [6, 10**6])
def test_sessions_of_a_hot_user(spark, chunk_rows):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(500):
        t += rng.choice([0, 1, 5, 9, 10, 11, 40])
        rows.append(("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), t, i))
    rows += [("gone", None, 1), ("one", 7, 7), ("burst", 1, 1), *(("burst", 1 + 9 * i, i) for i in range(60))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, at(s), v) for k, s, v in rows], "k string, t timestamp, v int")
    got = sorted(temporal.sessions(df, ["k"], "t", "10 seconds", "v", chunk_rows).collect(), key=str)
    want = []
    for k in {r[0] for r in rows}:
        own = sorted((s, v) for kk, s, v in rows if kk == k and s is not None)
        group = []
        for s, v in own:
            if group and s - group[-1][0] >= 10:
                want.append((k, group))
                group = []
            group.append((s, v))
        if group:
            want.append((k, group))
    want = sorted(((k, at(g[0][0]), at(g[-1][0]), len(g), max(v for _, v in g), min(v for _, v in g)) for k, g in want), key=lambda r: str(r))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("chunk_rows", [9, 10**6])
def test_ranks_against_counts(spark, chunk_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, 1, 1, 1, 1, rng.randrange(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v int")
    low = lambda v: -1 if v is None else v
    for keys in (["k"], []):
        out = ranks.neighbours(ranks.ranked(df, keys, "v", "id", 7, chunk_rows), keys, "row_number", {"back": ("id", -3), "on": ("id", 2)}, max(chunk_rows, 3)).collect()
        assert len(out) == len(rows)
        for k in {r[1] for r in rows} if keys else {0}:
            own = sorted(((low(v), i) for i, kk, v in rows if not keys or kk == k))
            values, n = [v for v, _ in own], len(own)
            sizes = [n // 7 + (i < n % 7) for i in range(7)]
            tiles = [i + 1 for i, s in enumerate(sizes) for _ in range(s)]
            for r in (r for r in out if not keys or r.k == k):
                place = own.index((low(r.v), r.id))
                below, same = sum(v < low(r.v) for v in values), values.count(low(r.v))
                assert (r.row_number, r["rank"], r.dense_rank, r.ntile) == (place + 1, below + 1, len({v for v in values if v < low(r.v)}) + 1, tiles[place])
                assert abs(r.percent_rank - (below / (n - 1) if n > 1 else 0)) < 1e-12 and abs(r.cume_dist - (below + same) / n) < 1e-12
                assert r.back == (own[place - 3][1] if place >= 3 else None) and r.on == (own[place + 2][1] if place + 2 < n else None)
    assert ranks.ranked(df.limit(0), ["k"], "v", "id").count() == 0


def test_no_window_over_all_rows(spark):
    """Whole-table ranks: every window that meets rows is dealt by chunk; only the chunks' totals share a task."""
    df = spark.range(2000).select("id", (F.col("id") * 37 % 1009).alias("v"))
    text = ranks.ranked(df, [], "v", "id", 4, 100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if " Window [" in line or line.lstrip(":+- ").startswith("Window [")]
    assert windows and all("_chunk" in line or "sum(_n#" in line for line in windows)  # _n are totals of chunks


def test_bags_count_copies(spark):
    rng = random.Random(5)
    pick = lambda n: [(rng.choice([1, 2, None]), rng.choice(["x", None])) for _ in range(n)] + [(9, "y")] * 25
    one, two = pick(60), pick(40)
    a, b = (spark.createDataFrame(x, "n int, s string") for x in (one, two))
    count = lambda df: Counter(tuple(r) for r in df.collect())
    assert count(bags.intersect_all(a, b)) == Counter(one) & Counter(two)
    assert count(bags.except_all(a, b)) == Counter(one) - Counter(two)
    assert count(bags.except_all(a, b.limit(0))) == Counter(one) and bags.intersect_all(a.limit(0), b).count() == 0
    assert count(bags.expanded(bags.counted(a, b), F.col("in_left"), block=4)) == Counter(one)


def test_grouping_sets_against_loops(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, *range(6)]), rng.randrange(100)) for _ in range(300)]
    df = spark.createDataFrame(rows, "x string, y int, d int, v int")
    out = bags.cube(df, ["x", "y"], "d", "v")
    want = {}
    for r in rows:
        for gid in range(4):
            want.setdefault((gid, None if gid & 2 else r[0], None if gid & 1 else r[1]), []).append(r)
    got = {(r.grouping_id, r.x, r.y): (r.rows, r.distinct_count, r.highest, r.lowest) for r in out.collect()}
    assert got == {k: (len(g), len({r[2] for r in g} - {None}), max(r[3] for r in g), min(r[3] for r in g)) for k, g in want.items()}
    assert "SinglePartition" not in plan(out)

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import cluster, groups, history


def frame(spark, rows):
    return spark.createDataFrame([(f, i, [float(x) for x in v]) for f, i, v in rows], "folder long, idx long, v array<double>")


def unit(v):
    v = np.asarray(v, dtype=float)
    return v / np.linalg.norm(v)


def partition(rows):
    out = {}
    for r in rows:
        out.setdefault((r["folder"], r["label"]), set()).add(r["idx"])
    return {frozenset((f, i) for i in ids) for (f, _), ids in out.items()}


def average_linkage(v, t):
    """Straight from the definition: mean distance over all pairs of two clusters."""
    dist = np.clip(1 - v @ v.T, 0, 2)
    parts = [[i] for i in range(len(v))]
    while len(parts) > 1:
        best = min(((dist[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j))
        if best[0] >= t:
            break
        parts[best[1]] += parts.pop(best[2])
    return {frozenset(p) for p in parts}


def test_small_cases(spark):
    toy = [unit(v) for v in ((1, 0, 0), (0.9, 0.1, 0), (0, 1, 0), (0, 0.9, 0.1))]
    rows = [(0, i, v) for i, v in enumerate(toy)] + [(1, 0, unit((1, 2, 3)))] + [(2, i, unit((1, 1, 0))) for i in range(5)]
    rows += [(3, i, np.eye(3)[i]) for i in range(3)]
    out = cluster.cluster(frame(spark, rows), 0.1).collect()
    count = {f: len({r["label"] for r in out if r["folder"] == f}) for f in range(4)}
    assert count == {0: 2, 1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("threshold", [0.1, 0.35, 0.6])
def test_linkage_like_the_definition(spark, threshold):
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for folder in range(6):
        centre = rng.normal(size=(4, 6))
        v = np.array([unit(centre[rng.integers(0, 4)] + 0.4 * rng.normal(size=6)) for _ in range(25)])
        v[5:9] = v[4]  # copies
        rows += [(folder, i, x) for i, x in enumerate(v)]
        want |= {frozenset((folder, i) for i in p) for p in average_linkage(v, threshold)}
    assert partition(cluster.cluster(frame(spark, rows), threshold).collect()) == want


def test_random_vectors_at_the_extremes(spark):
    v = np.random.default_rng(42).normal(size=(10, 608))
    rows = [(0, i, unit(x)) for i, x in enumerate(v)]
    out = cluster.sweep(frame(spark, rows), [0.1, 1.5]).collect()
    count = {t: len({r["label"] for r in out if r["threshold"] == t}) for t in {r["threshold"] for r in out}}
    assert count[0.1] == 10 and set(count) == {0.1, 0.8}


def test_big_albums_are_split_first(spark):
    rng = np.random.default_rng(3)
    centre = np.eye(12)
    v = [unit(centre[i % 12] + 0.02 * rng.normal(size=12)) for i in range(700)]
    copies = [v[0]] * 300  # one image makes up a third of the album
    rows = [(0, i, x) for i, x in enumerate(v + copies)] + [(1, i, x) for i, x in enumerate(v[:201])] + [(2, i, x) for i, x in enumerate(v[:200])]
    df = frame(spark, rows)
    leaves = cluster.leaves(df, 0.35).groupBy("folder", "leaf").count().collect()
    assert max(r["count"] for r in leaves) <= 200
    assert sum(r["folder"] == 2 for r in leaves) == 1 and sum(r["folder"] == 1 for r in leaves) > 1
    out = cluster.cluster(df, 0.35).collect()
    assert len(out) == len(rows)
    where = {(r["folder"], r["idx"]): r["label"] for r in out}
    assert len({where[(0, i)] for i in [0, *range(700, 1000)]}) == 1
    for parts in partition(out):
        ids = [(f, i) for f, i in parts]
        assert len({(i % 12 if i < 700 else 0) for _, i in ids}) == 1  # never mixes far-apart images


def test_coarse_k(spark):
    df = spark.createDataFrame([(201, 0.35), (500, 0.1), (500, 0.8), (5000, 0.1)], "n int, t double")
    want = [int(max(2, n // 50) + (1 - (t - 0.1) / (0.8 - 0.1)) * (min(n // 5, 200) - max(2, n // 50))) for n, t in ((201, 0.35), (500, 0.1), (500, 0.8), (5000, 0.1))]
    assert [r[0] for r in df.select(cluster.coarse_k(F.col("n"), F.col("t"))).collect()] == want


def test_split_batch(spark):
    rows = [(0, 0, [1, 0]), (0, 1, [0, 1]), (1, 0, [1, 0]), (2, 0, [1, 0]), (2, 1, [1])]
    folders = spark.createDataFrame([(i,) for i in range(4)], "folder long")
    done = spark.createDataFrame([(1,)], "folder long")
    out = {r["folder"]: r for r in cluster.split_batch(folders, frame(spark, rows), done).collect()}
    assert (out[0]["image_count"], out[0]["group_count"], out[0]["skipped"]) == (2, 2, False)
    assert (out[1]["image_count"], out[1]["group_count"], out[1]["skipped"]) == (1, 0, True)
    assert out[2]["error"] and out[2]["group_count"] == 0 and out[3]["image_count"] == 0
    forced = {r["folder"]: r for r in cluster.split_batch(folders, frame(spark, rows), done, force=True).collect()}
    assert forced[1]["group_count"] == 1


def test_members_and_edits(spark):
    df = spark.createDataFrame([("f", i, lab) for i, lab in enumerate((5, 5, 9, 9))], "folder string, idx long, label long")
    out = groups.members(df).orderBy("idx").collect()
    assert [(r["group_id"], r["member"], r["group_name"]) for r in out] == [(0, 0, "配色_1"), (0, 1, "配色_1"), (1, 0, "配色_2"), (1, 1, "配色_2")]
    mem = groups.members(df).withColumn("image_id", F.col("idx"))
    moves = spark.createDataFrame([("f", 0, 4)], "folder string, image_id long, target_group long")
    gone = spark.createDataFrame([("f", 0)], "folder string, group_id long")
    got = groups.apply_edits(mem, moves, gone).orderBy("image_id").collect()
    assert [r["new_group_id"] for r in got] == [1, 0, 0, 0]
    assert groups.next_group_id(mem).first()["new_group_id"] == 2
    # Every group listed for deletion: one stays.
    both = spark.createDataFrame([("f", 0), ("f", 1)], "folder string, group_id long")
    assert {r["new_group_id"] for r in groups.apply_edits(mem, None, both).collect()} == {0}


def test_group_checks(spark):
    rows = [("ok", 1, "a"), ("ok", 2, "b"), ("bad", 0, "a"), ("bad", 1, "a"), ("bad", 1, None), ("bad", 1, "")]
    got = groups.violations(spark.createDataFrame(rows, "folder string, size int, group_name string")).collect()
    assert [tuple(r) for r in got] == [("bad", 1, 2, 2)]


def test_history(spark):
    h = spark.createDataFrame([(1, "a", "2024-01-01", 2, 4, False), (2, "b", "2024-01-02", 1, 1, False)], "history_id long, folder string, split_time string, group_count int, image_count int, has_features boolean")
    g = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "history_id long, group_id long, group_name string")
    i = spark.createDataFrame([(1, 0, "p"), (2, 0, "q")], "history_id long, group_id long, file_path string")
    new = spark.createDataFrame([(0, "a", "2024-02-01", 1, 1, False), (1, "a 1", "2024-02-01", 1, 1, False)], "row long, folder string, split_time string, group_count int, image_count int, has_features boolean")
    ng = spark.createDataFrame([(0, 0, "z")], "row long, group_id long, group_name string")
    ni = spark.createDataFrame([(0, 0, "r")], "row long, group_id long, file_path string")
    h2, g2, i2 = history.write(h, g, i, new, ng, ni, "row")
    assert {(r["history_id"], r["folder"]) for r in h2.collect()} == {(2, "b"), (3, "a"), (4, "a 1")}
    assert {(r["history_id"], r["group_name"]) for r in g2.collect()} == {(2, "y"), (3, "z")}
    assert {r["file_path"] for r in i2.collect()} == {"q", "r"}
    assert history.newest_first(h2).first()["folder"] == "a 1"


def test_move_plan(spark):
    rows = [(0, "dl/alb", 0, "one", 0, "dl/alb/a.jpg"), (0, "dl/alb", 0, "one", 1, "dl/alb/x/a.jpg"), (0, "dl/alb", 1, "two", 2, "dl/alb/b.jpg")]
    df = spark.createDataFrame(rows, "folder_row long, folder string, group_id long, group_name string, idx long, path string")
    there = spark.createDataFrame([("dl", "alb two")], "parent string, target string")
    got = {r["path"]: r["dest"] for r in groups.move_plan(df, there).collect()}
    assert got == {"dl/alb/a.jpg": "dl/alb one/a.jpg", "dl/alb/x/a.jpg": "dl/alb one/a_1.jpg", "dl/alb/b.jpg": "dl/alb two_2/b.jpg"}

"""What a task holds, copies or sends must not grow faster than its input."""

import tracemalloc

import numpy as np
import pytest

from vitrine.operators import blocks, radius


def frame(spark, vectors, key="qid"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], f"{key} long, v array<double>")


def unit(rng, n, d):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_visits_that_do_not_pay_are_not_written(spark):
    v = unit(np.random.default_rng(3), 300, 24)
    balls = radius.build(frame(spark, enumerate(v)), frame(spark, enumerate(v), "id"), 0.85)
    assert not balls.pays and balls.visits.inputFiles() == []


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("earlier", [False, True])
def test_tiles_give_the_best_of_all_products(copies, earlier):
    rng = np.random.default_rng(5)
    q, v = unit(rng, 1100, 8), unit(rng, 5000, 8)
    if copies:
        v[1000:], q[::3] = v[0], v[0]
    ids, qid = rng.permutation(6000)[:5000], rng.permutation(6000)[:1100]
    sims = np.round(q @ v.T, 9)
    if earlier:
        sims[ids[None, :] >= qid[:, None]] = -np.inf
    want = {(int(qid[i]), int(ids[j])) for i in range(len(q)) for j in np.lexsort((ids, -sims[i]))[:5] if sims[i, j] > -np.inf}
    r, c, s = blocks.tiled_best_k(q, qid, v, ids, 5, earlier)
    assert {(int(qid[a]), int(ids[b])) for a, b in zip(r, c)} == want and np.allclose(s, sims[r, c], atol=1e-9)
    near = (np.round(q @ v.T, 9) >= 0.85) & (ids[None, :] < qid[:, None])
    assert (blocks.tiled_any(q, qid, v, ids, 0.85) == near.any(axis=1)).all()


def test_products_of_large_blocks_are_held_tile_by_tile():
    rng = np.random.default_rng(6)
    q, v = unit(rng, 4096, 16), unit(rng, 8192, 16)
    tracemalloc.start()
    blocks.tiled_best_k(q, np.arange(4096), v, np.arange(8192), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 < q.shape[0] * v.shape[0] * 8


def test_no_join_of_the_feature_pipeline_goes_through_the_driver(spark):
    from pyspark.sql import functions as F

    from vitrine.operators import features, pixels

    data = np.random.default_rng(1).integers(0, 256, (12, 10, 3), dtype=np.uint8).tobytes()
    images = spark.range(6).select(
        F.concat(F.lit("i"), "id").alias("key"), F.col("id").cast("double").alias("mtime"), F.lit(12).alias("height"), F.lit(10).alias("width"), F.lit(3).alias("nChannels"), F.lit(data).alias("data"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    store = images.where("mtime < 2").select("key", F.lit("combined").alias("namespace"), "mtime", now.alias("written_at"), F.array(F.lit(0.5).cast("float")).alias("feature"))
    looked = features.lookup(images.select("key", F.lit("combined").alias("namespace"), "mtime"), store, now)
    assert "Broadcast" not in looked._jdf.queryExecution().executedPlan().toString()
    both, rows = pixels.feature_pipeline(images, store, now)
    # Nothing computed is computed again: what is handed on is read from tables.
    assert "MapIn" not in both._jdf.queryExecution().executedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    got = {r["key"]: (r["cached"], len(r["feature"])) for r in both.collect()}
    assert got == {f"i{i}": (i < 2, 1 if i < 2 else 608) for i in range(6)} and rows.count() == 4


def test_pictures_are_worked_off_a_few_at_a_time():
    import pyarrow as pa

    from vitrine.operators import pixels

    batch = pa.RecordBatch.from_pydict({"height": [2] * 1000, "width": [1] * 1000, "nChannels": [3] * 1000, "data": [b"\1\2\3\4\5\6"] * 999 + [None]})
    parts = list(pixels._slices([batch]))
    assert max(p.num_rows for p, _ in parts) <= 256 and sum(p.num_rows for p, _ in parts) == 1000
    assert parts[0][1][0].shape == (2, 1, 3) and parts[-1][1][-1] is None


def test_only_contested_names_take_part_in_the_rounds(spark):
    from vitrine.operators import naming

    df = spark.createDataFrame([(0, "p", "x"), (1, "p", "x_2"), (2, "p", "y"), (3, "q", "x_2"), (4, "q", "z"), (5, "q", "z")], "row long, g string, _base string")
    rows = naming._parts(df, "_base", False)
    pick = lambda taken: {tuple(r) for r in naming._contested(rows, taken, ["g"], 2, False, 100).select("g", "_base").collect()}
    assert pick(None) == {("p", "x"), ("p", "x_2")}
    assert ("q", "z") in pick(spark.createDataFrame([("q", "z_7")], "g string, _name string"))
    assert naming._contested(rows.where("row > 1"), None, ["g"], 2, False, 100) is None


def test_pages_are_numbered_in_chunks_of_few_documents(spark):
    from pyspark.sql import functions as F

    from vitrine.sources import pages

    df = spark.range(60_000).select(F.col("id"), F.lit("u").alias("url"), F.lit("<p>").alias("html"))
    found, _ = pages.listing_pages(df, "id")
    assert "_chunk" in found._jdf.queryExecution().optimizedPlan().toString() and "CASE WHEN (id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("page <> place + 1").count() == 0


def test_rounds_of_k_means_leave_the_points_where_they_are(spark, monkeypatch):
    from vitrine import settings as S
    from vitrine.operators import cluster

    monkeypatch.setattr(S, "BLOCK_ROWS", 150)
    v = unit(np.random.default_rng(9), 300, 4)
    points = frame(spark, enumerate(v), "idx").selectExpr("7L AS folder", "0L AS leaf", "idx", "v", "1L AS weight")
    sizes = spark.createDataFrame([(7, 0, 300, 4)], "folder long, leaf long, size long, k int")
    seeds = {r["c"]: np.array(r["cv"]) for r in cluster._seeds(points, sizes).collect()}
    cv, before, rounds = np.array([seeds[c] for c in sorted(seeds)]), -np.inf, 0
    while True:
        fit = 2 * v @ cv.T - (cv**2).sum(1)
        near, now = fit.argmax(1), fit.max(1).sum()
        rounds += 1
        cv = np.array([v[near == j].mean(0) for j in range(len(cv))])
        if not now > before + cluster.STILL * len(v):
            break
        before = now
    want = (2 * v @ cv.T - (cv**2).sum(1)).argmax(1)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    tag = "k-means"
    spark.sparkContext.setJobGroup(tag, "")
    out = cluster.split_leaves(points, sizes)
    used = len(jobs(tag))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r["idx"]: sorted(seeds).index(r["part"]) for r in out.collect()}
    assert [got[i] for i in range(300)] == list(want)
    # A look at the centres, their broadcast, the round itself; and what is done once.
    assert rounds > 4 and used <= 6 * rounds + 12


def test_centres_too_large_to_send_meet_their_blocks(spark, monkeypatch):
    from vitrine import settings as S
    from vitrine.operators import cluster

    rng = np.random.default_rng(4)
    rows = [(f, i, [float(x) for x in v]) for f in range(2) for i, v in enumerate(unit(rng, 210, 3))]
    images = spark.createDataFrame(rows, "folder long, idx long, v array<double>")
    want = {(r["folder"], r["idx"]): r["label"] for r in cluster.cluster(images).collect()}
    monkeypatch.setattr(S, "BLOCK_ROWS", 90)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    got = {(r["folder"], r["idx"]): r["label"] for r in cluster.cluster(images).collect()}
    assert len(got) == 420 and got == want


def test_places_between_split_points_are_found_by_halving(spark):
    from vitrine.operators import ordering

    df = spark.createDataFrame([(f"w{i:03d}",) for i in range(200)] + [(None,)], "w string")
    bounds = ordering.split_points(df, "w", 16)
    chunk = ordering.sampled_chunk(df, "w", 16)
    plan = df.select(chunk.alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert len(bounds) > 4 and "lambda" not in plan
    got = {r["w"]: r["c"] for r in df.select("w", chunk.alias("c")).collect()}
    assert got == {None: 0} | {f"w{i:03d}": sum(b <= f"w{i:03d}" for b in bounds) for i in range(200)}


def test_pages_of_one_file_are_parsed_by_all_cores(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from vitrine.streaming import ingest, tables

    html = [(p, f'<html><a class="album__main" href="/photos/x/albums/{p}"></a></html>') for p in range(40)]
    spark.createDataFrame(html, "page long, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    parts, albums = [], ingest.html.albums

    def seen(pages, base):
        parts.append(pages.select(F.spark_partition_id().alias("p")).distinct().count())
        return albums(pages, base)

    monkeypatch.setattr(ingest.html, "albums", seen)
    stream = tables.file_stream(spark, str(tmp_path / "pages"), "page bigint, html string")
    got = ingest.ingest_albums(stream, "https://x", str(tmp_path / "albums"), str(tmp_path / "progress")).collect()
    assert sorted(int(r["album_id"]) for r in got) == list(range(40)) and parts[0] > 1


def test_quantised_scores_are_held_tile_by_tile():
    from vitrine.operators import cells

    rng = np.random.default_rng(8)
    book, q, near = rng.normal(size=(4, 16, 2)), rng.normal(size=(4000, 8)), rng.normal(size=4000)
    codes, ids = rng.integers(0, 16, (4096, 4)), rng.permutation(4096)
    tracemalloc.start()
    r, c, s = cells.best_coded(q, near, np.arange(4000), codes, ids, book, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 4096 * 8
    for i in range(0, 4000, 400):
        sums = np.round(near[i] + sum((book[t] @ q[i, 2 * t : 2 * t + 2])[codes[:, t]] for t in range(4)), 9)
        assert list(np.sort(s[r == i])[::-1]) == pytest.approx(list(np.sort(sums)[::-1][:5]), abs=1e-8)
        assert sums[c[r == i]] == pytest.approx(s[r == i], abs=1e-8)


@pytest.mark.parametrize("search", [lambda *sides: blocks.tiled_best_k(*sides, 5), lambda *sides: blocks.tiled_any(*sides, 0.85)])
def test_blocks_are_put_in_order_in_single_precision_only(search):
    rng, peaks = np.random.default_rng(12), []
    for n in (8192, 16_384):
        q, v, qid, ids = unit(rng, n, 64), unit(rng, n, 64), rng.permutation(n), rng.permutation(n)
        tracemalloc.start()
        search(q, qid, v, ids)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    # What is held besides the two blocks grows by less than they do.
    assert peaks[1] - peaks[0] < q.nbytes


def test_blocks_are_written_once_however_many_they_meet(spark, monkeypatch):
    from vitrine.operators import similarity

    # Blocks of twenty vectors, in pieces of five.
    monkeypatch.setattr(blocks, "ROW_BYTES", 400)
    rng = np.random.default_rng(14)
    q, v = unit(rng, 90, 8), unit(rng, 200, 8)
    v[50:150] = q[0]
    queries, items = frame(spark, enumerate(q)), frame(spark, enumerate(v), "id")
    sims = np.round(q @ v.T, 9)
    for earlier in (False, True):
        s = np.where(np.arange(200)[None, :] >= np.arange(90)[:, None], -np.inf, sims) if earlier else sims
        found = similarity.top_k(queries, items, 3, earlier_only=earlier, block_rows=20)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "explode" not in plan and "CartesianProduct" in plan
        got = {(r["qid"], r["rank"], r["id"]) for r in found.collect()}
        assert got == {(i, n + 1, int(j)) for i in range(90) for n, j in enumerate(np.lexsort((np.arange(200), -s[i]))[:3]) if s[i, j] > -np.inf}
    near = similarity.with_match(queries, items, 0.8, block_rows=20)
    assert "explode" not in near._jdf.queryExecution().executedPlan().toString()
    want = ((sims >= 0.8) & (np.arange(200)[None, :] < np.arange(90)[:, None])).any(axis=1)
    assert {r["qid"] for r in near.collect()} == set(np.flatnonzero(want).tolist())


def test_leaves_of_a_few_blocks_go_through_their_rounds_in_one_task(spark, monkeypatch):
    from vitrine import settings as S
    from vitrine.operators import cluster

    # More than a block each, but not more than one task holds.
    monkeypatch.setattr(S, "BLOCK_ROWS", 60)
    v = unit(np.random.default_rng(19), 800, 4)
    leaf_of = np.array([0] * 400 + [1] * 250 + [2] * 150)
    rows = [(7, int(f), i, [float(y) for y in x], 1 + i % 3) for i, (f, x) in enumerate(zip(leaf_of, v))]
    points = spark.createDataFrame(rows, "folder long, leaf long, idx long, v array<double>, weight long")
    sizes = spark.createDataFrame([(7, 0, 400, 6), (7, 1, 250, 4), (7, 2, 150, 3)], "folder long, leaf long, size long, k int")
    seeds = cluster._seeds(points, sizes).collect()
    want, most = {}, 0
    for leaf in range(3):
        at, own = np.flatnonzero(leaf_of == leaf), sorted((r["c"], r["cv"]) for r in seeds if r["leaf"] == leaf)
        x, w, cv, before, rounds = v[at], 1 + at % 3, np.array([c[1] for c in own]), -np.inf, 0
        while True:
            fit = 2 * x @ cv.T - (cv**2).sum(1)
            near, now, rounds = fit.argmax(1), fit.max(1) @ w, rounds + 1
            cv = np.array([np.average(x[near == j], axis=0, weights=w[near == j]) for j in range(len(cv))])
            if not now > before + cluster.STILL * w.sum():
                break
            before = now
        want |= {int(i): own[j][0] for i, j in zip(at, (2 * x @ cv.T - (cv**2).sum(1)).argmax(1))}
        most = max(most, rounds)
    tag = "k-means in tasks"
    spark.sparkContext.setJobGroup(tag, "")
    out = cluster.split_leaves(points, sizes)
    used = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["idx"]: r["part"] for r in out.collect()} == want
    assert most > 12 and used < 2 * most

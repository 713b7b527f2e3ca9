import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.vectors import hamming
from vitrine.operators import cell_tree, cells, dedup, phash, radius, similarity


def frame(spark, vectors, key="qid"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], f"{key} long, v array<double>")


def at_similarity(s):
    return [s, np.sqrt(1 - s * s)]


def scan_one_by_one(candidates, registry, k=5, dup=0.92, review=0.85):
    """Statuses of an ordinary loop over the candidates."""
    index = [(i, np.array(v)) for i, v in registry]
    out = {}
    for qid, v in sorted(candidates):
        sims = sorted((-round(float(np.dot(v, w)), 9), abs(i)) for i, w in index)[:k]
        best = -sims[0][0] if sims else None
        status = "new" if best is None or best < review else "duplicate" if best >= dup else "review"
        out[qid] = (status, best)
        if status == "new":
            index.append((-1 - qid, np.array(v)))
    return out


def test_thresholds_are_inclusive(spark):
    queries = frame(spark, [(i, at_similarity(s)) for i, s in enumerate((0.92, 0.919999, 0.85, 0.849999))])
    stock = frame(spark, [(7, [1.0, 0.0])], "id")
    out = dedup.decide(queries.drop("v"), similarity.top_k(queries, stock)).orderBy("qid").collect()
    assert [r["status"] for r in out] == ["duplicate", "review", "review", "new"]
    assert [len(r["matches"]) for r in out] == [1, 1, 1, 1]


def test_new_keeps_all_matches_and_others_only_close_ones(spark):
    stock = frame(spark, [(1, [1, 0]), (2, at_similarity(0.9)), (3, [0, 1])], "id")
    queries = frame(spark, [(0, [1, 0]), (1, [-1, 0])])
    out = {r["qid"]: r for r in dedup.decide(queries.drop("v"), similarity.top_k(queries, stock)).collect()}
    assert [m["id"] for m in out[0]["matches"]] == [1, 2] and out[0]["status"] == "duplicate"
    assert len(out[1]["matches"]) == 3 and out[1]["status"] == "new"
    none = dedup.decide(queries.drop("v"), similarity.top_k(queries, stock.where("false")))
    assert {r["status"] for r in none.collect()} == {"new"} and {len(r["matches"]) for r in none.collect()} == {0}


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_like_numpy(spark, block):
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(90, 8)), rng.normal(size=(70, 8))
    v[10:30] = v[5]  # equal vectors tie: the lower id wins
    got = similarity.top_k(frame(spark, enumerate(q)), frame(spark, enumerate(v), "id"), 5, block_rows=block)
    sims = np.round(q @ v.T, 9)
    for r in got.collect():
        order = sorted(range(70), key=lambda j: (-sims[r["qid"], j], j))
        assert r["id"] == order[r["rank"] - 1] and r["sim"] == pytest.approx(sims[r["qid"], r["id"]])


@pytest.mark.parametrize("block", [4096, 40])
def test_batch_scan_like_a_loop(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    # A third are exact copies of one item, others drift away step by step.
    rows = [base[0]] * 60 + [base[i % 60] + 0.35 * rng.normal(size=6) for i in range(120)]
    step = base[1].copy()
    for _ in range(40):
        step = step + 0.25 * rng.normal(size=6)
        rows.append(step.copy())
    order = rng.permutation(len(rows))
    unit = [(int(i), rows[j] / np.linalg.norm(rows[j])) for i, j in enumerate(order)]
    stock = [(i, v / np.linalg.norm(v)) for i, v in enumerate(base[:10] + 0.1)]
    want = scan_one_by_one(unit, stock)
    got = dedup.batch_scan(frame(spark, unit), frame(spark, stock, "id"), block_rows=block).collect()
    assert len(got) == len(unit)
    for r in got:
        status, best = want[r["qid"]]
        assert r["status"] == status
        assert r["best_sim"] == pytest.approx(best, abs=1e-8)


def test_chain_inside_a_batch(spark):
    turn = [(i, [np.cos(a), np.sin(a)]) for i, a in enumerate((0.0, 0.45, 0.9))]  # A~B, B~C, not A~C
    got = dedup.batch_scan(frame(spark, turn), frame(spark, [(1, [-1.0, 0.0])], "id")).orderBy("qid").collect()
    assert [r["status"] for r in got] == ["new", "review", "new"] and got[1]["best_id"] == -1


def test_product_without_usable_image_is_an_error(spark):
    img = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [3.0, 4.0]), ("b", [0.0, 0.0])], "folder string, v array<double>")
    vecs = dedup.product_vectors(img, "folder")
    rows = {r["folder"]: r for r in vecs.collect()}
    assert rows["a"]["vector"] == pytest.approx([0.6, 0.8]) and rows["a"]["n_images"] == 1
    assert rows["b"]["vector"] == [0.0, 0.0] and rows["b"]["n_images"] == 0
    products = spark.createDataFrame([("a",), ("b",), ("c",)], "folder string")
    decided = spark.createDataFrame([("a", "review", 4, 0.9)], "folder string, status string, best_id long, best_sim double")
    out = {r["folder"]: (r["status"], r["error"]) for r in dedup.scan_folders(products, vecs, decided, "folder").collect()}
    assert out == {"a": ("review", None), "b": ("new", "no usable image"), "c": ("new", "no images")}


def clustered(n, centres, seed=2, noise=0.05, dim=16):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    v = c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [4096, 50])
def test_cells_recall(spark, block):
    v = clustered(600, 12)
    stock, queries = frame(spark, enumerate(v), "id"), frame(spark, enumerate(v[:60]))
    centres = cells.train_cells(stock, 20)
    placed = cells.assign(stock, centres)
    exact = {(r["qid"], r["id"]) for r in similarity.top_k(queries, stock).collect()}
    found = {(r["qid"], r["id"]) for r in cells.search(queries, placed, centres, probes=8, block_rows=block).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    every = {(r["qid"], r["id"]) for r in cells.search(queries, placed, centres, probes=20, block_rows=block).collect()}
    assert every == exact


def test_quantised_recall(spark):
    v = clustered(800, 16)
    stock, queries = frame(spark, enumerate(v), "id"), frame(spark, enumerate(v[:40]))
    assert cells.pq_shape(608, 10**6) == (32, 8) and cells.pq_shape(10, 100, 32) == (10, 6)
    centres = cells.train_cells(stock, 10)
    rest = cells.residuals(cells.assign(stock, centres), centres)
    book = cells.train_codebooks(rest, 8, 6)
    exact = {(r["qid"], r["id"]) for r in similarity.top_k(queries, stock).collect()}
    found = cells.pq_search(queries, cells.encode(rest, book), centres, book, probes=10, items=stock, refine=8)
    assert len(exact & {(r["qid"], r["id"]) for r in found.collect()}) >= 0.8 * len(exact)
    rough = cells.pq_search(queries, cells.encode(rest, book), centres, book, probes=10)
    assert rough.count() == 200


def test_stored_cells(spark, tmp_path):
    v = clustered(100, 4)
    stock = frame(spark, enumerate(v), "id")
    centres = cells.train_cells(stock, 4)
    path = str(tmp_path / "cells")
    cells.write(stock, centres, path, "2024-01-01")
    with pytest.raises(ValueError):
        cells.read(spark, path, 17)
    more = frame(spark, [(1000, v[0])], "id")
    cells.append(path, more, centres)
    gone = spark.createDataFrame([(0,), (1,)], "id long")
    cells.remove_stored(path, gone)
    stored, back, meta = cells.read(spark, path, 16)
    assert {r["id"] for r in stored.select("id").collect()} == set(range(2, 100)) | {1000}
    assert np.allclose(back, centres) and meta["trained"] == 100


def test_cells_are_trained_anew_on_drift(spark, tmp_path):
    v = clustered(100, 4)
    path = str(tmp_path / "cells")
    first = frame(spark, enumerate(v[:80]), "id")
    cells.write(first, cells.train_cells(first, 4), path, "a")
    same, anew = cells.extend(path, frame(spark, [(i, v[i]) for i in range(80, 90)], "id"), 16, "b")
    assert (same, anew) == (path, False)
    fresh, anew = cells.extend(path, frame(spark, [(i, v[i]) for i in range(90, 100)], "id"), 16, "c")
    stored, _, meta = cells.read(spark, fresh, 16)
    assert anew and fresh != path and meta["trained"] == 100
    assert sorted(r["id"] for r in stored.select("id").collect()) == list(range(100))


def test_training_rows_do_not_depend_on_partitions(spark):
    stock = frame(spark, enumerate(clustered(300, 4)), "id")
    drawn = [{r["id"] for r in cells._drawn(stock.repartition(n), 60, 300).collect()} for n in (1, 7)]
    assert drawn[0] == drawn[1] and 30 < len(drawn[0]) < 100


def random_hashes(seed=9, n=120):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, size=(30, 4), dtype=np.int64)
    base[:12, 0] = 0  # many share their first digits
    out = []
    for i in range(n):
        h = base[rng.integers(0, 30)].copy()
        for bit in rng.choice(256, rng.integers(0, 9), replace=False):
            h[bit // 64] ^= np.int64(np.uint64(1 << int(bit % 64)).astype(np.int64))
        out.append((i, [int(x) for x in h]))
    return out + [(n + i, out[3][1]) for i in range(n // 2)]  # a third are copies


def distance(a, b):
    return sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))


@pytest.mark.parametrize("limit", [4096, 3])
def test_hash_neighbours_and_covers_like_a_loop(spark, monkeypatch, limit):
    whole = phash.band_keys
    monkeypatch.setattr(phash, "band_keys", lambda df, t=8: whole(df, t, limit))
    rows = random_hashes()
    df = spark.createDataFrame(rows, "row long, hash array<bigint>")
    want, kept, dup = {}, [], {}
    for i, h in rows:
        near = [j for j, g in rows[:i] if distance(h, g) <= 8]
        if near:
            want[i] = (near[0], distance(h, rows[near[0]][1]))
        hit = next((j for j, g in kept if distance(h, g) <= 8), None)
        if hit is None:
            kept.append((i, h))
        else:
            dup[i] = hit
    assert {r["row"]: (r["match_row"], r["distance"]) for r in phash.first_neighbour(df).collect()} == want
    assert {r["row"]: r["match_row"] for r in phash.cover_duplicates(df).collect()} == dup


def test_eight_bits_match_and_nine_do_not(spark):
    df = spark.createDataFrame([(0, [0, 0, 0, 0]), (1, [255, 0, 0, 0]), (2, [0, 0, 0, 511])], "row long, hash array<bigint>")
    assert [(r["row"], r["match_row"]) for r in phash.cover_duplicates(df).collect()] == [(1, 0)]
    assert df.select(hamming("hash", "hash")).distinct().first()[0] == 0


def test_album_duplicates(spark):
    rows = [
        (0, "a", None, [0, 0, 0, 0]), (1, "a", None, [7, 7, 7, 7]), (2, "b", "done", [1, 0, 0, 0]), (3, "c", None, [3, 0, 0, 0]),
        (4, "d", None, None), (5, "e", None, [7, 7, 7, 7]),
    ]
    df = spark.createDataFrame(rows, "row long, title string, status string, hash array<bigint>")
    out = {r["row"]: (r["reason"], r["match_row"]) for r in phash.album_duplicates(df).collect()}
    assert out == {0: (None, None), 1: ("title", 0), 2: (None, None), 3: ("cover", 0), 4: (None, None), 5: (None, None)}
    every = {r["row"]: r["match_row"] for r in phash.album_duplicates(df, skip_flagged=False).collect()}
    assert every[2] == 0


def test_hot_cell_is_cut_into_blocks(spark):
    v = clustered(300, 3)
    items = frame(spark, enumerate(v), "id").withColumn("cell", F.lit(0))
    q = frame(spark, enumerate(v[:20])).withColumn("cell", F.lit(0))
    hot = similarity.top_k(q, items, 5, "cell", block_rows=32)
    want = similarity.top_k(frame(spark, enumerate(v[:20])), frame(spark, enumerate(v), "id"), 5)
    assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, want.collect()))


def test_torn_and_null_vectors_are_refused():
    import pyarrow as pa
    import pytest

    from vitrine.operators.blocks import matrix

    assert matrix(pa.chunked_array([[[1.0, 2.0]], [[3.0, 4.0]]])).shape == (2, 2)
    for rows in ([[1.0] * 64, [2.0] * 60], [[1.0] * 4, None, [2.0] * 2]):
        with pytest.raises(ValueError):
            matrix(pa.chunked_array([rows], type=pa.list_(pa.float64())))


@pytest.mark.parametrize("block", [64, 4096])
def test_distances_inside_albums_of_any_size(spark, block):
    rng = np.random.default_rng(11)
    sizes = {"big": 450, "limit": 200, "small": 7, "one": 1, None: 3}
    rows = [(a, i, [float(x) for x in v / np.linalg.norm(v)]) for a, n in sizes.items() for i, v in enumerate(rng.standard_normal((n, 5)))]
    df = spark.createDataFrame(rows, "album string, idx long, v array<double>")
    out = similarity.within_groups(df, ["album"], block_rows=block).collect()
    assert len(out) == len({(r.album, r.i, r.j) for r in out}) == sum(n * (n - 1) // 2 for n in sizes.values())
    vectors = {(a, i): np.array(v) for a, i, v in rows}
    assert all(r.i < r.j and abs(r.distance - (1 - vectors[r.album, r.i] @ vectors[r.album, r.j])) < 1e-9 for r in out)


def found_pairs(df):
    return {(r["qid"], r["id"]) for r in df.collect()}


def test_cells_on_two_levels(spark):
    """More fine cells than any task sees: few coarse ones, each with its own."""
    v = clustered(1200, 60)
    stock, queries = frame(spark, enumerate(v), "id"), frame(spark, enumerate(v[:80]))
    tree = cell_tree.train(stock, 90)
    shares = {r["cell"]: r["count"] for r in tree.shares().collect()}
    assert len(tree.coarse) == 10 and 60 <= sum(shares.values()) <= 130
    assert max(shares.values()) < 0.5 * sum(shares.values())
    placed = cell_tree.place(stock, tree)
    assert placed.count() == 1200 and {r["cell"] for r in placed.collect()} <= {r["id"] for r in tree.fine.collect()}
    exact = found_pairs(similarity.top_k(queries, stock))
    assert len(exact & found_pairs(cell_tree.search(queries, placed, tree, probes=8, coarse_probes=3))) >= 0.9 * len(exact)
    every = cell_tree.search(queries, placed, tree, probes=500, coarse_probes=10, block_rows=70)
    assert found_pairs(every) == exact
    # A vector meets the centroids of its coarse cells, not all of them.
    assert sum(sorted(shares.values())[-3:]) < 0.7 * sum(shares.values())


def test_a_hot_cell_has_more_fine_cells(spark):
    v = np.vstack([clustered(900, 1, noise=0.3), clustered(100, 9, seed=5)])
    stock = frame(spark, enumerate(v), "id")
    tree = cell_tree.train(stock, 64)
    coarse = {r["cell"]: r["count"] for r in cells.assign(stock, tree.coarse).groupBy("cell").count().collect()}
    shares = {r["cell"]: r["count"] for r in tree.shares().collect()}
    assert set(shares) == set(coarse)
    assert sum(shares[c] for c in shares if coarse[c] >= 100) >= 0.6 * sum(shares.values())
    one = cell_tree.train(frame(spark, [(1, [0.0, 1.0])], "id"))
    assert cell_tree.search(frame(spark, [(7, [0.0, 1.0])]), cell_tree.place(frame(spark, [(1, [0.0, 1.0])], "id"), one), one).count() == 1


def test_quantised_recall_over_the_tree(spark):
    v = clustered(800, 16)
    stock, queries = frame(spark, enumerate(v), "id"), frame(spark, enumerate(v[:40]))
    tree = cell_tree.train(stock, 10)
    rest = cell_tree.residuals(cell_tree.place(stock, tree), tree)
    book = cells.train_codebooks(rest, 8, 6)
    exact = found_pairs(similarity.top_k(queries, stock))
    coded = cells.encode(rest, book)
    found = cell_tree.pq_search(queries, coded, tree, book, probes=10, items=stock, refine=8)
    assert len(exact & found_pairs(found)) >= 0.8 * len(exact)
    assert cell_tree.pq_search(queries, coded, tree, book, probes=10).count() == 200


def test_cell_numbers_have_no_cap():
    assert cells.cell_count(10**12) == 10**6 and cells.cell_count(10**4, quantised=True) == 100 and cells.cell_count(390, quantised=True) == 10 and cells.cell_count(3, True) == 1


@pytest.mark.parametrize("block", [4096, 16])
def test_hashes_that_share_keys_but_are_not_near(spark, monkeypatch, block):
    """All digits but a few are common, so first and second keys are shared by all; pairs stay in blocks."""
    whole = phash.band_keys
    monkeypatch.setattr(phash, "band_keys", lambda df, t=8: whole(df, t, 8))
    rng = np.random.default_rng(21)
    rows = [(i, [int(rng.integers(0, 2**12)), 0, 0, int(rng.integers(0, 2**10))]) for i in range(150)]
    df = spark.createDataFrame(rows, "row long, hash array<bigint>")
    want, kept, dup = {}, [], {}
    for i, h in rows:
        near = [j for j, g in rows[:i] if distance(h, g) <= 8]
        if near:
            want[i] = (near[0], distance(h, rows[near[0]][1]))
        hit = next((j for j, g in kept if distance(h, g) <= 8), None)
        if hit is None:
            kept.append((i, h))
        else:
            dup[i] = hit
    assert len(kept) > 5
    assert {r["row"]: (r["match_row"], r["distance"]) for r in phash.first_neighbour(df, limit=block).collect()} == want
    assert {r["row"]: r["match_row"] for r in phash.cover_duplicates(df, limit=block).collect()} == dup
    keyed, hot = phash._marked(phash.band_keys(phash.distinct_hashes(df)), 16)
    assert hot and keyed.where("hot").groupBy("key").count().agg(F.max("count")).first()[0] > 100
    once = phash._earlier(keyed, keyed, "row", 8, True, 16)
    # A row leaves a hot key once per block, not once per pair.
    assert once.count() <= keyed.where("hot").count() * 12 + phash._earlier(keyed.where("NOT hot"), keyed.where("NOT hot"), "row", 8).count()


def test_cells_with_a_radius_lose_no_match(spark):
    v = np.vstack([clustered(500, 25, noise=0.03), clustered(60, 60, seed=9), [np.zeros(16), np.full(16, 0.5)]])
    items, queries = frame(spark, enumerate(v), "id"), frame(spark, enumerate(v))
    balls = radius.build(queries, items, 0.85, 90)
    want = {r["qid"] for r in similarity.with_match(queries, items, 0.85).collect()}
    got = {r["qid"] for r in similarity.with_match(balls.visits, balls.items, 0.85, 64, "cell").collect()}
    assert got == want and len(want) > 400
    # Fewer comparisons than all, and fewer blocks of 16 by 16.
    assert balls.pays and balls.compared < 0.4 * balls.every == 0.4 * len(v) ** 2
    sizes = lambda df: {r["cell"]: -(-r["count"] // 16) for r in df.groupBy("cell").count().collect()}
    asked, held = sizes(balls.visits), sizes(balls.items)
    assert sum(asked[c] * held.get(c, 0) for c in asked) < 0.5 * (-(-len(v) // 16)) ** 2
    # Every pair from the limit on is compared: its query visits the cell of its item.
    sims = np.round(v @ v.T, 9)
    cell = {r["id"]: r["cell"] for r in balls.items.collect()}
    visits = {(r["qid"], r["cell"]) for r in balls.visits.collect()}
    assert all((int(a), cell[int(b)]) in visits for a, b in zip(*np.nonzero(sims >= 0.85)))


def test_vectors_without_neighbours_are_compared_in_plain_blocks(spark):
    v = np.random.default_rng(3).normal(size=(300, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert not radius.build(frame(spark, enumerate(v)), frame(spark, enumerate(v), "id"), 0.85).pays
    assert radius.build(frame(spark, enumerate(v)).limit(0), frame(spark, enumerate(v), "id").limit(0), 0.85).every == 0

import numpy as np
from pyspark.sql import functions as F

from tests.test_html import BASE, GALLERY, LIST, pages
from vitrine.operators import listing, registry, state, zero_shot
from vitrine.plans import crawl, products, variants
from vitrine.sources import state_files
from vitrine.streaming import ingest, register, tables


def test_crawl(spark):
    log = spark.createDataFrame([("u:70035", "done", "Second"), ("u:70021", "partial", "kept")], "key string, status string, folder string")
    out = crawl.albums_to_fetch(pages(spark, LIST, GALLERY), BASE, "u", log)
    got = {r["album_id"]: r["picked"] for r in out.collect()}
    assert got == {"70021": True, "70035": False, "70112": True}
    text = '<div class="showalbum__children"><img data-src="https://h/{}/small.png"></div>'
    detail = spark.createDataFrame([("70021", text.format(1) + text.format(2)), ("70112", text.format(3))], "album_id string, html string")
    there = spark.createDataFrame([("kept",), ("Third &last",)], "folder string")
    plan = {(r["folder"], r["file"]): r["image_url"] for r in crawl.download_plan(out, detail, there).collect()}
    assert plan == {
        ("kept", "01.png"): "https://h/1/big.png", ("kept", "02.png"): "https://h/2/big.png", ("Third &last_2", "01.png"): "https://h/3/big.png"
    }


def test_download_status_needs_every_image(spark):
    rows = [("a", "success"), ("a", "skipped"), ("b", "success"), ("b", "failed")]
    df = spark.createDataFrame(rows, "key string, outcome string")
    got = {r["key"]: (r["status"], r["downloaded"]) for r in crawl.log_entries(df).collect()}
    assert got == {"a": ("done", 2), "b": ("partial", 1)}


def test_products(spark):
    stock = spark.createDataFrame([(1, "old", "s", "f0", [1.0, 0.0]), (2, "none", "s", "f9", None)], "id long, name string, store string, folder string, embedding array<double>")
    folders = spark.createDataFrame([(0, "f0"), (1, "f1"), (2, "f2"), (3, "f3"), (4, "f4"), (5, "f5")], "row long, folder string")
    v = [("f1", [1.0, 0.0]), ("f2", [0.0, 1.0]), ("f2", [0.0, 0.0]), ("f3", [0.1, 0.9]), ("f4", [0.0, 0.0])]
    out = products.scan(folders, spark.createDataFrame(v, "folder string, v array<double>"), stock)
    got = {r["folder"]: (r["status"], r["error"], r["best_id"]) for r in out.collect()}
    assert got == {
        "f1": ("duplicate", None, 1), "f2": ("new", None, 1), "f3": ("duplicate", None, -3), "f4": ("new", "no usable image", None), "f5": ("new", "no images", None)
    }
    handled = spark.createDataFrame([], "folder string")
    added, conflicts = products.register(out, stock, handled)
    assert [(r["folder"], r["id"]) for r in added.collect()] == [("f2", 3)] and conflicts.count() == 0


def test_products_with_torn_vectors(spark):
    stock = spark.createDataFrame([(1, "old", "s", "f0", [1.0, 0.0]), (2, "torn", "s", "f9", [1.0, 0.0, 0.0])], "id long, name string, store string, folder string, embedding array<double>")
    folders = spark.createDataFrame([(0, "f1"), (1, "f2"), (2, "f3"), (3, "f4")], "row long, folder string")
    v = [("f1", [1.0, 0.0]), ("f1", [9.0]), ("f2", [1.0, 0.0, 0.0]), ("f3", None), ("f4", [0.0, 1.0]), ("f4", [0.1, 0.9])]
    out = products.scan(folders, spark.createDataFrame(v, "folder string, v array<double>"), stock)
    got = {r["folder"]: (r["status"], r["error"]) for r in out.collect()}
    assert got == {"f1": ("duplicate", None), "f2": ("new", "no usable image"), "f3": ("new", "no usable image"), "f4": ("new", None)}
    assert {(r["row"], r["match_id"], r["name"], r["folder"]) for r in products.matched(out, stock).collect()} == {(0, 1, "old", "f0"), (3, 1, "old", "f0")}


def test_a_split_ends_in_moves_and_history(spark):
    red, blue = [1.0, 0.0], [0.0, 1.0]
    rows = [(f"d/{a}", i, f"d/{a}/{i}.jpg", red if i < 2 else blue) for a in "ab" for i in range(3)]
    images = spark.createDataFrame(rows, "folder string, idx long, path string, v array<double>")
    past = spark.createDataFrame([(4, "d/old", 1, 1), (7, "d/a", 1, 9)], "history_id long, folder string, group_count long, image_count int")
    past = past.withColumn("split_time", F.lit("2024-01-01").cast("timestamp")).withColumn("has_features", F.lit(True))
    old_groups = spark.createDataFrame([(4, 0, "g"), (7, 0, "h")], "history_id long, group_id long, group_name string")
    old_images = spark.createDataFrame([(7, 0, "p")], "history_id long, group_id long, file_path string")
    folders = spark.createDataFrame([(0, "d/a"), (1, "d/b")], "folder_row long, folder string")
    members = variants.split(images, past, force=True)
    plan, (top, named, files) = variants.finish(members, folders, F.lit("2024-05-05").cast("timestamp"), past, old_groups, old_images)
    assert {r["dest"] for r in plan.collect()} == {f"d/{a} 配色_{g}/{i}.jpg" for a in "ab" for g, i in ((1, 0), (1, 1), (2, 2))}
    got = {r["folder"]: (r["history_id"], r["group_count"], r["image_count"]) for r in top.collect()}
    assert got == {"d/old": (4, 1, 1), "d/a": (8, 2, 3), "d/a 配色_1": (9, 1, 2), "d/a 配色_2": (10, 1, 1), "d/b": (11, 2, 3), "d/b 配色_1": (12, 1, 2), "d/b 配色_2": (13, 1, 1)}
    assert {(r["history_id"], r["group_id"]) for r in named.collect()} == {(4, 0), (8, 0), (8, 1), (11, 0), (11, 1)}
    assert {(r["history_id"], r["file_path"]) for r in files.collect()} == {(h, f"d/{a}/{i}.jpg") for h, a in ((8, "a"), (11, "b")) for i in range(3)}


def test_registry_append_refuses_known_and_repeated_folders(spark):
    stock = spark.createDataFrame([(5, "a")], "id long, folder string")
    batch = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "row long, folder string")
    added, conflicts = registry.append(batch, stock, "row")
    assert {(r["folder"], r["id"]) for r in added.collect()} == {("b", 6), ("c", 7)}
    assert {r["row"] for r in conflicts.collect()} == {1, 2}


def test_variants_and_listings(spark):
    red, blue = [1.0, 0.0], [0.0, 1.0]
    rows = [("d/a", i, f"d/a/{i}.jpg", red if i < 6 else blue) for i in range(8)] + [("d/done", 0, "d/done/0.jpg", red)]
    images = spark.createDataFrame(rows, "folder string, idx long, path string, v array<double>")
    done = spark.createDataFrame([("d/done",)], "folder string")
    words = spark.createDataFrame([("category", "shoes", 0, red), ("category", "hat", 1, blue), ("colour", "red", 0, [0.15, 0.0]), ("style", "old", 0, red)], "kind string, label string, pos int, v array<double>")
    labels = zero_shot.label_table(words)
    out = variants.split(images, done, labels=labels).collect()
    assert {(r["group_id"], r["group_name"]) for r in out} == {(0, "shoes old"), (1, "hat")}  # floors are strict
    folders = spark.createDataFrame([(0, "d/a"), (1, "d/empty"), (2, "d/done")], "row long, folder string")
    feed = variants.listings(folders, images.select("folder", "path"), images.select("folder", "path", "v"), labels, 10.0, 20.0).collect()
    assert [r["folder"] for r in feed] == ["d/empty", "d/a", "d/done"] and feed[0]["title"] == "(空文件夹)"
    assert len(feed[1]["main_images"]) == 5 and len(feed[1]["detail_images"]) == 3 and "shoes" in feed[1]["title"]
    assert all(10 <= r["price"] <= 20 for r in feed[1:])


def test_main_and_detail_do_not_overlap(spark):
    df = spark.createDataFrame([("f", f"{i:03d}.jpg") for i in range(130)] + [("g", f"{i:02d}.jpg") for i in range(20)], "folder string, path string")
    got = {r["folder"]: r for r in listing.listing_images(df).collect()}
    assert got["g"]["main_images"] == [f"{i:02d}.jpg" for i in range(5)] and len(got["g"]["detail_images"]) == 15
    assert len(got["f"]["detail_images"]) == 100 and not set(got["f"]["main_images"]) & set(got["f"]["detail_images"])


def test_zero_vectors_get_the_default_category(spark):
    labels = {"category": (["a", "b"], np.eye(2))}
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, -1.0])], "id long, vector array<double>")
    assert [r["category"] for r in zero_shot.categories(df, labels, "id").orderBy("id").collect()] == ["商品", "a"]


def test_state_files(spark):
    raw = spark.createDataFrame([('{"d": {"f": "2024-01-02T03:04:05", "g": "x"}}',), ("broken",)], "raw string")
    marks = state_files.load_marks(raw)
    assert {(r["parent_dir"], r["folder"], str(r["marked_at"])) for r in marks.collect()} == {("d", "f", "2024-01-02 03:04:05"), ("d", "g", "None")}
    one = spark.createDataFrame([("d", "f")], "parent_dir string, folder string")
    assert [r["folder"] for r in state.clear_marks(marks, one).collect()] == ["g"]
    urls = spark.createDataFrame([('["b", "a"]',)], "raw string")
    assert [(r["pos"], r["url"]) for r in state_files.load_history(urls).collect()] == [(0, "b"), (1, "a")]


def test_streams_do_not_depend_on_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"f{i % 40}") for i in range(100)], "row long, folder string")
    stock = spark.createDataFrame([(7, "f3")], "id long, folder string")
    results = []
    for n in (1, 4):
        src, out = str(tmp_path / f"src{n}"), str(tmp_path / f"out{n}")
        rows.repartition(n, "folder").write.parquet(src)
        added, conflicts = register.register(tables.file_stream(spark, src, rows.schema), stock, "row", out, f"{out}/progress")
        ids = [r["id"] for r in added.collect()]
        assert len(set(ids)) == len(ids) == 39 and min(ids) == 8
        results.append(sorted(r["folder"] for r in added.collect()))
        assert register.summary(added, conflicts).first().asDict() == {"registered": 39, "errors": 61}
    assert results[0] == results[1]
    # A batch that runs again replaces its rows.
    tables.put(rows.limit(5), str(tmp_path / "again"), 0)
    tables.put(rows.limit(3), str(tmp_path / "again"), 0)
    assert tables.get(spark, str(tmp_path / "again"), rows.schema).count() == 3


def test_log_stream(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [("a", "success", 1), ("a", "failed", 2), ("b", "skipped", 3), ("b", "success", 4)]
    df = spark.createDataFrame(rows, "key string, outcome string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.repartition(2, "s").write.parquet(src)
    log = ingest.download_log(tables.file_stream(spark, src, df.schema), str(tmp_path / "log"), str(tmp_path / "progress"))
    assert {r["key"]: (r["status"], r["downloaded"], r["image_count"]) for r in log.collect()} == {"a": ("partial", 1, 2), "b": ("done", 2, 2)}

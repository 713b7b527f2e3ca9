import random

from pyspark.sql import functions as F

from vitrine.operators import naming, ordering


def one_by_one(rows, existing=(), first=2, files=False):
    """The names an ordinary loop gives."""
    taken, out = set(existing), {}
    for row, base in sorted(rows):
        stem, dot, ext = base.rpartition(".") if files else (base, "", "")
        name, n = base, first
        while name in taken:
            name = f"{stem}_{n}{dot}{ext}"
            n += 1
        taken.add(name)
        out[row] = name
    return out


def test_numbered_in_chunks(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(rows, "row long, k string")
    out = ordering.numbered(df, ["k"], [F.col("row")], "n", ordering.row_chunk("row", 7))
    seen = {}
    for r in sorted(out.collect()):
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        assert r["n"] == seen[r["k"]]
    every = ordering.numbered(df, [], [F.col("row")], "n", ordering.row_chunk("row", 7))
    assert [r["n"] for r in every.orderBy("row").collect()] == list(range(1, 301))


def test_sampled_chunk_keeps_order(spark):
    words = [f"{i % 97:03d}/{i:05d}" for i in range(1500)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    chunk = ordering.sampled_chunk(df, "w", 16)
    got = [r["c"] for r in df.select("w", chunk.alias("c")).orderBy("w").collect()]
    assert got == sorted(got) and len(set(got)) > 8


def test_previous_mean(spark, monkeypatch):
    monkeypatch.setattr(ordering.S, "CHUNK_ROWS", 5)
    df = spark.createDataFrame([(i, float(i * i)) for i in range(40)], "i long, v double")
    for r in ordering.previous_mean(df, "i", "v", "m", 4).collect():
        before = [x * x for x in range(max(0, r["i"] - 4), r["i"])]
        assert r["m"] == (sum(before) / len(before) if before else None)


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), "id")
    top = ordering.top_per_key(df, ["k"], [F.col("id").desc()], 3)
    assert {r["id"] for r in top.where("k = 0").collect()} == {897, 898, 899}
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_unique_folder_cases(spark):
    df = spark.createDataFrame([(0, "album")], "row long, title string")
    for existing, want in ((set(), "album"), ({"album"}, "album_2"), ({"album", "album_2", "album_3"}, "album_4")):
        there = spark.createDataFrame([(e,) for e in existing], "folder_name string")
        assert naming.unique_folders(df, "row", "title", existing=there).first()["folder_name"] == want


def test_unique_names_like_a_loop(spark):
    rng = random.Random(11)
    pool = ["x", "x_2", "x_3", "x_2_2", "x_4", "y", "y_3", "z_02", "y_1"]
    for seed in range(3):
        rows = [(i, rng.choice(pool)) for i in range(120)]
        existing = [n for n in ("x", "x_5", "x_6", "y_2", "x_2_3", "x_9") if rng.random() < 0.7]
        df = spark.createDataFrame(rows, "row long, base string")
        there = spark.createDataFrame([(e,) for e in existing], "name string")
        # Tiny chunks take the chunked path as well.
        got = naming.unique_names(df, "row", "base", "name", existing=there, chunk_rows=10 if seed else 10**6)
        assert {r["row"]: r["name"] for r in got.collect()} == one_by_one(rows, existing)


def test_a_number_too_large_rejects_its_row_alone(spark):
    df = spark.createDataFrame([(i, "x") for i in range(5)] + [(5, "y")], "row long, base string")
    got = naming.unique_names(df, "row", "base", "name", max_suffix=4)
    assert [r["name"] for r in got.orderBy("row").collect()] == ["x", "x_2", "x_3", "x_4", None, "y"]


def test_unique_files_like_a_loop(spark):
    rng = random.Random(5)
    pool = ["a.jpg", "a_1.jpg", "a_2.jpg", "b.tar.gz", "b.tar_1.gz", "noext", "a.png"]
    rows = [(i, rng.choice("pq"), rng.choice(pool)) for i in range(100)]
    df = spark.createDataFrame(rows, "row long, g string, name string")
    got = {r["row"]: r["dest_name"] for r in naming.unique_files(df, "row", "name", ["g"]).collect()}
    for g in "pq":
        part = [(i, n) for i, k, n in rows if k == g]
        want, taken = {}, set()
        for i, n in part:
            stem, dot, ext = n.rpartition(".") if "." in n else (n, "", "")
            name, c = n, 1
            while name in taken:
                name, c = f"{stem}_{c}{dot}{ext}", c + 1
            taken.add(name)
            want[i] = name
        assert {i: got[i] for i, _ in part} == want


def test_reorder_main(spark):
    files = [("f", "f/001_a.jpg"), ("f", "f/b.jpg"), ("f", "f/c.jpg"), ("g", "g/d.jpg")]
    df = spark.createDataFrame(files, "folder string, path string")
    out = naming.reorder_main(df, "folder", "path", F.col("path") == "f/c.jpg")
    assert {r["path"]: r["new_name"] for r in out.collect()} == {
        "f/c.jpg": "001_c.jpg", "f/001_a.jpg": "002_a.jpg", "f/b.jpg": "003_b.jpg", "g/d.jpg": "001_d.jpg"
    }

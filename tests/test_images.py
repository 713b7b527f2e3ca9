import colorsys
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import features, pixels
from vitrine.sources import files as fs


def png(path, rgb):
    """A plain PNG file of (h, w, 3 or 4) bytes."""
    h, w, c = rgb.shape

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def solid(h, w, colour):
    return np.tile(np.array(colour, np.uint8), (h, w, 1))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pics")
    (d / "a").mkdir()
    (d / "b").mkdir()
    png(d / "a" / "wide.png", solid(10, 20, (255, 0, 0)))
    png(d / "a" / "tall.png", solid(20, 10, (255, 255, 255)))
    png(d / "a" / "square.png", solid(10, 10, (0, 0, 255)))
    framed = solid(40, 40, (255, 255, 255))
    framed[10:30, 10:30] = (255, 0, 0)
    png(d / "a" / "framed.png", framed)
    png(d / "a" / "clear.png", solid(4, 8, (10, 20, 30, 0)))
    (d / "a" / "broken.png").write_bytes(b"<html>")
    (d / "b" / "notes.txt").write_text("x")
    return d


def test_file_and_folder_scan(spark, folder):
    listing = fs.listing(spark, str(folder), recursive=True).select("path", "length", "content")
    names = [r["path"].split("/")[-1] for r in fs.image_files(listing).collect()]
    assert names == sorted(names) and "notes.txt" not in names and len(names) == 6
    got = fs.image_folders(listing.select("path"), base=f"file:{folder}").collect()
    assert [(r["folder"].split("/")[-1], r["image_count"]) for r in got] == [("a", 6)]
    assert fs.valid_images(listing).count() == 5


@pytest.fixture(scope="module")
def images(spark, folder):
    rows = pixels.flat(fs.pixels(spark, str(folder / "a")))
    return rows.withColumn("origin", F.substring_index("origin", "/", -1)).cache()


def test_pixels_and_padding(images):
    sizes = {r["origin"]: (r["height"], r["width"], r["nChannels"]) for r in images.collect()}
    assert sizes["wide.png"] == (10, 20, 3) and sizes["broken.png"][0] == -1 and sizes["clear.png"][2] == 4
    out = {r["origin"]: r for r in pixels.pad_square(images).collect()}
    assert {k: r["outcome"] for k, r in out.items()} == {
        "wide.png": "processed", "tall.png": "processed", "square.png": "skipped", "framed.png": "skipped", "clear.png": "processed", "broken.png": "failed"
    }
    wide = np.frombuffer(out["wide.png"]["data"], np.uint8).reshape(20, 20, 3)
    assert (wide[:5] == 255).all() and (wide[15:] == 255).all() and (wide[5:15] == (0, 0, 255)).all()
    clear = np.frombuffer(out["clear.png"]["data"], np.uint8)
    assert (clear == 255).all()  # transparent pixels show the fill colour
    black = {r["origin"]: r["data"] for r in pixels.pad_square(images, fill=(0, 0, 0)).collect()}
    assert np.frombuffer(black["wide.png"], np.uint8).reshape(20, 20, 3)[0].max() == 0


def test_white_background(images):
    got = {r["origin"]: r["is_white"] for r in pixels.white_backgrounds(images).collect()}
    assert got == {"wide.png": False, "tall.png": True, "square.png": False, "framed.png": True, "clear.png": False, "broken.png": False}


def test_hsv_close_to_the_float_formula():
    px = np.random.default_rng(0).integers(0, 256, (50, 50, 3)).astype(np.uint8)
    h, s, v = np.moveaxis(pixels.hsv(px), -1, 0)
    for y in range(0, 50, 7):
        for x in range(50):
            b, g, r = px[y, x] / 255.0
            fh, fs_, fv = colorsys.rgb_to_hsv(r, g, b)
            assert abs(int(v[y, x]) - fv * 255) < 0.51 and abs(int(s[y, x]) - fs_ * 255) < 0.6
            gap = abs(int(h[y, x]) - fh * 180)
            assert min(gap, 180 - gap) < 0.6


def test_histograms(images):
    got = {r["origin"]: np.array(r["hsv"]) for r in pixels.hsv_histograms(images).collect()}
    assert all(len(v) == 96 for v in got.values()) and not got["broken.png"].any()
    assert np.linalg.norm(got["wide.png"]) == pytest.approx(1)
    assert np.count_nonzero(got["framed.png"]) == 1  # the white border is background
    assert np.count_nonzero(got["tall.png"]) == 1  # all white: nothing else to count


def test_hash_survives_small_changes():
    # Patches of colour: a smooth ramp would have no frequencies to compare.
    patches = np.random.default_rng(0).integers(0, 250, (18, 24, 3))
    px = np.kron(patches, np.ones((5, 5, 1), int)).astype(np.uint8)
    bits = lambda p: np.unpackbits(np.array(pixels.phash_words(p), dtype=">i8").view(np.uint8))
    noisy = np.clip(px.astype(int) + np.random.default_rng(1).integers(-2, 3, px.shape), 0, 255).astype(np.uint8)
    assert len(bits(px)) == 256 and (bits(px) != bits(noisy)).sum() <= 8
    assert (bits(px) != bits(px[::-1, ::-1])).sum() > 60


def test_embedder_is_pluggable(images):
    def make():
        def model(px):
            if px.shape[0] == 10:
                raise ValueError("no")
            return np.array([3.0, 4.0])
        return model

    got = {r["origin"]: r["vector"] for r in pixels.embed(images, make=make, dim=2).collect()}
    assert got["tall.png"] == pytest.approx([0.6, 0.8]) and got["wide.png"] == [0, 0] and got["broken.png"] == [0, 0]


def test_feature_store_rules(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    day = 86400
    at = lambda s: F.timestamp_seconds(F.unix_seconds(now) - s)
    base = spark.createDataFrame([("hit", 1.0, 90 * day), ("old", 1.0, 90 * day + 1), ("changed", 1.0, 0)], "key string, mtime double, age long")
    store = base.select("key", F.lit("").alias("namespace"), "mtime", at(F.col("age")).alias("written_at"), F.array(F.lit(1.0)).alias("feature"))
    wanted = spark.createDataFrame([("hit", "", 1.0), ("old", "", 1.0), ("changed", "", 2.0), ("hit", "combined", 1.0), ("none", "", 1.0)], "key string, namespace string, mtime double")
    out = features.lookup(wanted, store, now)
    assert [(r["key"], r["namespace"]) for r in out.where("hit").collect()] == [("hit", "")] and out.count() == 5
    assert {r["key"] for r in features.unexpired(store, now).collect()} == {"hit", "changed"}
    new = store.where("key = 'hit'").withColumn("mtime", F.lit(9.0))
    after = {r["key"]: r["mtime"] for r in features.upsert(store, new).collect()}
    assert after == {"hit": 9.0, "old": 1.0, "changed": 1.0}
    assert features.clear(store).count() == 0 and features.clear(store, "combined").count() == 3


def test_feature_pipeline_computes_only_the_missing(spark, images):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    rows = images.withColumn("key", F.col("origin")).withColumn("mtime", F.lit(1.0))
    store = spark.createDataFrame([("tall.png", "combined", 1.0, [0.5])], "key string, namespace string, mtime double, feature array<float>").withColumn("written_at", now)
    found, new = pixels.feature_pipeline(rows, store, now)
    assert {r["key"] for r in found.where("cached").collect()} == {"tall.png"} and found.count() == 6
    assert {r["key"]: len(r["feature"]) for r in new.collect()} == {k: 608 for k in ("wide.png", "square.png", "framed.png", "clear.png", "broken.png")}


def test_pictures_of_one_shape_are_embedded_together(monkeypatch):
    import pyarrow as pa

    from vitrine.operators import blocks

    rng = np.random.default_rng(7)
    shapes = [(12, 14, 3), (5, 9, 1), (20, 8, 4), (1, 1, 3), (300, 400, 3)]
    some = [rng.integers(0, 256, shapes[i % 4], dtype=np.uint8) for i in range(60)] + [rng.integers(0, 256, shapes[4], dtype=np.uint8), None, solid(6, 6, (0, 0, 0))]
    calls, many = [], pixels.layout_features_many
    monkeypatch.setattr(pixels, "layout_features_many", lambda px: calls.append(px.shape) or many(px))
    got = pixels._unit_layouts(some, 512)
    # Fifteen pictures of each small shape, and one of each other, in one call per shape.
    assert sorted(calls) == sorted([(15, *s) for s in shapes[:4]] + [(1, *shapes[4]), (1, 6, 6, 3)])
    for px, v in zip(some, got):
        if px is None or not px.any():
            assert not v.any()
            continue
        # The definition, plane by plane.
        h, w, c = px.shape
        b, g, r = (px[..., i if c > 1 else 0] / 255.0 for i in range(3))
        grey = b if c == 1 else np.rint((0.299 * r + 0.587 * g + 0.114 * b) * 255) / 255.0
        edges = [np.abs(np.diff(grey, axis=0, prepend=grey[:1])), np.abs(np.diff(grey, axis=1, prepend=grey[:, :1]))]
        mean = lambda a: pixels._weights(h, 8) @ a @ pixels._weights(w, 8).T
        want = np.stack([*map(mean, (b, g, r)), *(np.sqrt(np.clip(mean(a * a) - mean(a) ** 2, 0, None)) for a in (b, g, r)), *map(mean, edges)]).ravel()
        assert v == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    assert blocks.matrix(pa.chunked_array([blocks.list_column(got)])).shape == (63, 512)


def test_slices_of_many_pictures_are_bounded_by_their_bytes(monkeypatch):
    import pyarrow as pa

    batch = lambda n, size: pa.RecordBatch.from_pydict({"height": [size] * n, "width": [1] * n, "nChannels": [3] * n, "data": [bytes(3 * size)] * n})
    rows = lambda b: [p.num_rows for p, _ in pixels._slices([b], pixels.MANY_ROWS)]
    assert rows(batch(5000, 2)) == [2048, 2048, 904]
    big = rows(batch(2000, 5000))
    assert sum(big) == 2000 and max(big) == 279  # 4 MiB of 15,000 bytes each
    assert max(rows(batch(600, 50_000))) == 256  # never fewer than before

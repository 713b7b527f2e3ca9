"""Files written and read: bitmaps through the image source, listing pages in order."""

import os
import random

import numpy as np
import pytest

from vitrine.session import scratch_path
from vitrine.sources import files, pages, pictures


def test_bitmaps_come_back(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for i, (h, w, c) in enumerate([(1, 1, 3), (3, 5, 3), (4, 2, 1), (7, 6, 4), (2, 9, 3)]):
        px = rng.integers(0, 256, (h, w, c), dtype=np.uint8)
        rows.append((i, h, w, c, px.tobytes()))
        want[i] = (h, w, (np.repeat(px, 3, axis=2) if c == 1 else px[:, :, :3]).tobytes())
    rows += [(10, -1, -1, -1, b"<html>"), (11, 2, 2, 3, b"short"), (12, None, None, None, None)]
    folder = scratch_path(spark, "bitmaps")
    df = spark.createDataFrame(rows, "id long, height int, width int, nChannels int, data binary")
    for _ in range(2):  # writing again replaces the files
        done = {r.id: r.n_bytes for r in pictures.write(df, "id", folder).collect()}
    assert done[0] == 58 and done[10] == 6 and done[12] == 0
    got = {int(r.origin.rpartition("/")[2][:-4]): r for r in files.pixels(spark, folder).select("image.*").collect()}
    assert {i: (r.height, r.width, bytes(r.data)) for i, r in got.items() if i < 10} == want
    assert all(got[i].height == -1 for i in (10, 11)) and len(got) in (7, 8)
    assert {r.image.height for r in files.pixels(spark, folder, drop_invalid=True).collect()} == {1, 3, 4, 7, 2}


def test_pages_are_numbered_in_order(spark):
    rng = random.Random(1)
    rows = [(i * 3, f"u{i}", rng.choice(["<p>x", "", "  ", None, "y"])) for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, url string, html string")
    for chunk in (7, 10**6):
        found, blank = pages.listing_pages(df, "id", chunk_rows=chunk)
        kept = sorted(r for r in rows if (r[2] or "").strip())
        assert [tuple(r) for r in found.orderBy("page").collect()] == [(n + 1, *r) for n, r in enumerate(kept)]
        assert blank.count() == 100 - len(kept)
    assert pages.listing_pages(df.limit(0), "id")[0].count() == 0


def test_packed_bitmaps_are_what_the_image_source_reads(spark):
    rng = np.random.default_rng(3)
    rows = [(i, h, w, c, rng.integers(0, 256, h * w * c, dtype=np.uint8).tobytes()) for i, (h, w, c) in enumerate([(1, 1, 3), (3, 5, 3), (4, 2, 1), (7, 6, 4), (2, 9, 3)])]
    rows += [(10, -1, -1, -1, b"<html>"), (11, 2, 2, 3, b"short"), (12, 1, 1, 3, b"BM")]
    df = spark.createDataFrame(rows, "id long, height int, width int, nChannels int, data binary")
    folder = scratch_path(spark, "bitmaps")
    pictures.write(df, "id", folder).collect()
    plain = lambda images: {r.image.origin.rpartition("/")[2]: (*r.image[1:5], bytes(r.image.data)) for r in images.collect()}
    stored = pictures.packed(df, "id")
    for drop in (False, True):
        want = plain(files.pixels(spark, folder, drop))
        assert len(want) == (5 if drop else 8) and plain(pictures.decoded(stored, drop)) == want
    assert plain(pictures.decoded(files.listing(spark, folder, recursive=True))) == plain(files.pixels(spark, folder))


def test_pictures_that_are_no_bitmaps_are_not_taken_for_corrupt():
    whole = pictures.bitmap(2, 2, 3, bytes(range(12)))
    assert pictures.bitmap_pixels(whole) == (2, 2, bytes(range(12)))
    flipped = whole[:22] + (-2).to_bytes(4, "little", signed=True) + whole[26:]  # rows from top to bottom
    assert pictures.bitmap_pixels(flipped) == (2, 2, bytes(range(6, 12)) + bytes(range(6)))
    assert pictures.bitmap_pixels(whole[:-1]) is None and pictures.bitmap_pixels(b"") is None
    for other in (b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", whole[:28] + b"\x08" + whole[29:]):
        with pytest.raises(ValueError, match="image source"):
            pictures.bitmap_pixels(other)


def test_a_scan_of_pictures_writes_no_file_per_picture(spark):
    import __spark_entry__ as entry
    from vitrine.session import checkpoint_dir

    root = checkpoint_dir(spark).removeprefix("file:")
    held = lambda: {os.path.join(d, n) for d, _, names in os.walk(root) for n in names if not n.endswith(".crc")}
    before = held()
    assert entry.queries()["image_pixel_scan"](spark, "/root/testdata/sf0.001").count() == 200
    assert len(held() - before) < 20

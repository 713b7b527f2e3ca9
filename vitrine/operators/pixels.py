"""Jobs on decoded images: rows of the ``image`` source struct, BGR or BGRA bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..session import cut
from .blocks import list_column

FIELDS = ("height", "width", "nChannels", "data")
#: Pictures that a task works off at once, whatever the batches it is handed hold.
SLICE_ROWS = 256
#: Pictures, and bytes of them, that the default embedder is handed at once, and pixels that it works on at once.
MANY_ROWS, MANY_BYTES, MANY_PIXELS = 2048, 4 << 20, 1 << 16
DOUBLES = pa.list_(pa.float64())
_STEPS = np.arange(1, 256)
#: Fixed-point divisors of saturation and hue.
_SDIV = np.concatenate([[0], np.rint((255 << 12) / _STEPS)]).astype(np.int64)
_HDIV = np.concatenate([[0], np.rint((180 << 12) / (6.0 * _STEPS))]).astype(np.int64)


def flat(images: DataFrame) -> DataFrame:
    """The fields of the source's ``image`` column; a corrupt file has height -1."""
    return images.select("image.origin", *(f"image.{f}" for f in FIELDS))


def _bgr(height, width, channels, data) -> np.ndarray | None:
    """Pixels as (h, w, channels), or None for a corrupt image."""
    if height is None or height < 1 or width < 1 or data is None or len(data) != height * width * channels:
        return None
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def _slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A few rows at a time, and their pixels; more than ``SLICE_ROWS`` only while the pictures are small."""
    for b in batches:
        start = 0
        while start < b.num_rows:
            part = b.slice(start, most)
            if most > SLICE_ROWS and part.num_rows > SLICE_ROWS:
                held = pc.cumulative_sum(pc.fill_null(pc.binary_length(part["data"]), 0).cast(pa.int64())).to_numpy()
                part = part.slice(0, max(SLICE_ROWS, int(np.searchsorted(held, MANY_BYTES, side="right"))))
            yield part, [_bgr(*r) for r in zip(*(part[f].to_pylist() for f in FIELDS))]
            start += part.num_rows


def _map(df: DataFrame, key: str, one: Callable, fields: dict[str, pa.DataType], kinds: str) -> DataFrame:
    """Apply ``one`` (pixels or None -> tuple) to every image."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pictures in _slices(batches):
            made = zip(*(one(px) for px in pictures))
            columns = [pa.array(list(c), t) for c, t in zip(made, fields.values())]
            yield pa.RecordBatch.from_arrays([part[key], *columns], names=[key, *fields])

    return df.select(key, *FIELDS).mapInArrow(run, f"{key} {kind}, {kinds}")


def hsv(bgr: np.ndarray) -> np.ndarray:
    """8-bit hue (0..179), saturation and value, in fixed-point arithmetic."""
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    v = np.maximum(np.maximum(b, g), r)
    diff = v - np.minimum(np.minimum(b, g), r)
    s = (diff * _SDIV[v] + (1 << 11)) >> 12
    side = np.where(v == r, g - b, np.where(v == g, b - r + 2 * diff, r - g + 4 * diff))
    h = (side * _HDIV[diff] + (1 << 11)) >> 12
    return np.stack([np.where(h < 0, h + 180, h), s, v], axis=-1)


def hsv_counts(bgr: np.ndarray) -> np.ndarray:
    """Pixels per colour bin, background left out unless hardly anything else is there."""
    h, s, v = np.moveaxis(hsv(bgr[..., :3]), -1, 0)
    grey = s < S.HSV_GREY_S
    front = ~(grey & (v >= S.HSV_WHITE_V)) & ~(grey & (v < S.HSV_BLACK_V))
    if np.count_nonzero(front) < S.HSV_MIN_FOREGROUND * front.size:
        front = np.ones_like(front)
    hb, sb, vb = S.HSV_BINS
    bins = ((h * hb // 180) * sb + s * sb // 256) * vb + v * vb // 256
    return np.bincount(bins[front], minlength=hb * sb * vb)


def _unit_hsv(px: np.ndarray | None) -> np.ndarray:
    """Unit colour histogram; zeros for a corrupt image."""
    counts = np.zeros(int(np.prod(S.HSV_BINS))) if px is None else hsv_counts(px).astype(np.float64)
    n = np.linalg.norm(counts)
    return counts / n if n > 0 else counts


def hsv_histograms(images: DataFrame, key: str = "origin") -> DataFrame:
    """Unit colour histogram per image; a corrupt image has the zero vector."""
    return _map(images, key, lambda px: (_unit_hsv(px),), {"hsv": DOUBLES}, "hsv array<double>")


def hsv_columns(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """``hsv`` as column arithmetic, for tables with a row per pixel."""
    v = F.greatest(r, g, b)
    diff = v - F.least(r, g, b)
    whole = lambda c: c.cast("bigint")
    sdiv = F.when(v > 0, whole(F.rint(F.lit(255 << 12) / v))).otherwise(0)
    hdiv = F.when(diff > 0, whole(F.rint(F.lit(180 << 12) / (diff * 6.0)))).otherwise(0)
    s = F.shiftright(diff * sdiv + (1 << 11), 12)
    side = F.when(v == r, g - b).when(v == g, b - r + diff * 2).otherwise(r - g + diff * 4)
    h = F.shiftright(side * hdiv + (1 << 11), 12)
    return F.when(h < 0, h + 180).otherwise(h), s, v


def hsv_bins(pixels: DataFrame, key: str) -> DataFrame:
    """(key, bin, value) of the unit colour histogram from (key, r, g, b) rows.

    Pixels are counted per bin before anything is shuffled, so an image of any size can be
    spread over many tasks.
    """
    hb, sb, vb = S.HSV_BINS
    h, s, v = hsv_columns(F.col("r"), F.col("g"), F.col("b"))
    number = (F.floor(h * hb / 180) * sb + F.floor(s * sb / 256)) * vb + F.floor(v * vb / 256)
    back = (s < S.HSV_GREY_S) & ((v >= S.HSV_WHITE_V) | (v < S.HSV_BLACK_V))
    bins = pixels.groupBy(key, number.cast("int").alias("bin")).agg(
        F.count_if(~back).alias("_front"), F.count(F.lit(1)).alias("_all")
    )
    per = Window.partitionBy(key)
    few = F.sum("_front").over(per) < F.sum("_all").over(per) * S.HSV_MIN_FOREGROUND
    kept = bins.withColumn("_n", F.when(few, F.col("_all")).otherwise(F.col("_front")))
    length = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(per))
    return kept.select(key, "bin", (F.col("_n") / length).alias("value")).where("value > 0")


def edge_white_ratio(bgr: np.ndarray, level: int = S.WHITE_LEVEL, share: float = S.EDGE_SHARE) -> float:
    """Share of white pixels in the bands along the four edges."""
    h, w = bgr.shape[:2]
    my, mx = max(1, int(h * share)), max(1, int(w * share))
    y, x = np.ogrid[:h, :w]
    # A pixel counts once per band it lies in: thin images have overlapping bands.
    times = (y < my).astype(int) + (y >= h - my)
    inner = (y >= my) & (y < h - my)
    times = times + inner * ((x < mx).astype(int) + (x >= w - mx))
    white = (bgr[..., :3] >= level).all(axis=-1)
    return float((white * times).sum() / times.sum())


def white_backgrounds(images: DataFrame, key: str = "origin", ratio: float = S.WHITE_RATIO) -> DataFrame:
    out = _map(images, key, lambda px: (None if px is None else edge_white_ratio(px),), {"white_ratio": pa.float64()}, "white_ratio double")
    return out.withColumn("is_white", F.coalesce(F.col("white_ratio") >= ratio, F.lit(False)))


def pad_geometry(width: Column, height: Column) -> dict[str, Column]:
    """Canvas size and where the image sits on it."""
    size = F.greatest(width, height)
    return {
        "size": size,
        "offset_x": F.floor((size - width) / 2).cast("int"),
        "offset_y": F.floor((size - height) / 2).cast("int"),
    }


def pad_square(images: DataFrame, key: str = "origin", fill: tuple[int, int, int] = S.SQUARE_FILL) -> DataFrame:
    """Images on square canvases: a new table, with the outcome of each.

    Transparent pixels are laid over the fill colour (RGB). An image that is square
    already is passed on as it is, and a corrupt one is reported as failed.
    """
    paint = np.array(fill[::-1], dtype=np.uint8)

    def one(px):
        if px is None:
            return ("failed", -1, 0, b"")
        h, w, c = px.shape
        if h == w:
            return ("skipped", h, c, px.tobytes())
        if c == 4:
            alpha = px[..., 3:].astype(np.int64)
            mixed = px[..., :3].astype(np.int64) * alpha + paint.astype(np.int64) * (255 - alpha)
            px = ((mixed + 127) // 255).astype(np.uint8)
        elif c == 1:
            px = np.repeat(px, 3, axis=2)
        n = max(h, w)
        canvas = np.broadcast_to(paint, (n, n, 3)).copy()
        y, x = (n - h) // 2, (n - w) // 2
        canvas[y : y + h, x : x + w] = px
        return ("processed", n, 3, canvas.tobytes())

    fields = {"outcome": pa.string(), "size": pa.int32(), "nChannels": pa.int32(), "data": pa.binary()}
    return _map(images, key, one, fields, "outcome string, size int, nChannels int, data binary")


def _grey(px: np.ndarray) -> np.ndarray:
    if px.shape[2] == 1:
        return px[..., 0].astype(np.float64)
    b, g, r = (px[..., i].astype(np.float64) for i in range(3))
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b)


#: Weights made before, by the lengths: pictures of few sizes need few of them.
_WEIGHTS: dict[tuple[int, int], np.ndarray] = {}
MOST_WEIGHTS = 256


def _weights(m: int, n: int) -> np.ndarray:
    """Shares of m pixels in each of n equal parts."""
    found = _WEIGHTS.get((m, n))
    if found is None:
        edges = np.linspace(0, m, n + 1)
        lo, hi = np.arange(m), np.arange(1, m + 1)
        w = np.clip(np.minimum(edges[1:, None], hi) - np.maximum(edges[:-1, None], lo), 0, None)
        found = w / w.sum(axis=1, keepdims=True)
        if len(_WEIGHTS) >= MOST_WEIGHTS:
            _WEIGHTS.clear()
        _WEIGHTS[(m, n)] = found
    return found


def _resize(a: np.ndarray, n: int) -> np.ndarray:
    """Area-weighted resize of a plane, or of planes at once, to n × n."""
    return _weights(a.shape[-2], n) @ a @ _weights(a.shape[-1], n).T


def phash_words(px: np.ndarray, size: int = S.PHASH_SIZE) -> list[int]:
    """Signs of the low cosine frequencies against their median, as 64-bit words."""
    n = size * 4
    grid = _resize(_grey(px), n)
    basis = np.cos(np.pi * np.arange(size)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))
    low = basis @ grid @ basis.T
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).view(">i8").astype(np.int64).tolist()


def phashes(images: DataFrame, key: str = "origin") -> DataFrame:
    """256-bit perceptual hash per image; NULL for a corrupt one."""
    return _map(images, key, lambda px: (None if px is None else phash_words(px),), {"hash": pa.list_(pa.int64())}, "hash array<bigint>")


def _resize_many(a: np.ndarray, n: int) -> np.ndarray:
    """``_resize`` of planes (k, h, w) of many pictures, in two products."""
    k, h, w = a.shape
    narrow = (a.reshape(k * h, w) @ _weights(w, n).T).reshape(k, h, n)
    return np.matmul(_weights(h, n), narrow.transpose(1, 0, 2).reshape(h, k * n)).reshape(n, k, n).transpose(1, 0, 2)


def layout_features_many(px: np.ndarray, cells: int = 8) -> np.ndarray:
    """``layout_features`` of pictures of one shape, (n, h, w, channels), a row each."""
    n, h, w, c = px.shape
    planes = px[..., list(range(3)) if c > 1 else [0, 0, 0]].transpose(3, 0, 1, 2).astype(np.float64)
    grey = (planes[0] if c == 1 else np.rint(0.299 * planes[2] + 0.587 * planes[1] + 0.114 * planes[0])) / 255.0
    planes /= 255.0
    dy, dx = np.abs(np.diff(grey, axis=1, prepend=grey[:, :1])), np.abs(np.diff(grey, axis=2, prepend=grey[:, :, :1]))
    small = _resize_many(np.concatenate([planes, planes * planes, dy[None], dx[None]]).reshape(8 * n, h, w), cells).reshape(8, n, cells, cells)
    small[3:6] = np.sqrt(np.clip(small[3:6] - small[:3] ** 2, 0, None))
    return small.transpose(1, 0, 2, 3).reshape(n, -1)


def layout_features(px: np.ndarray, cells: int = 8) -> np.ndarray:
    """Default embedder: colour mean and spread and edge strength on an 8 × 8 grid (512)."""
    return layout_features_many(px[None], cells)[0]


def _unit_layouts(pictures: list[np.ndarray | None], dim: int) -> np.ndarray:
    """Unit embeddings of the default embedder, a row each; pictures of one shape are worked on together."""
    out = np.zeros((len(pictures), dim))
    shapes: dict[tuple[int, ...], list[int]] = {}
    for i, px in enumerate(pictures):
        if px is not None:
            shapes.setdefault(px.shape, []).append(i)
    for (h, w, _), rows in shapes.items():
        step = max(1, MANY_PIXELS // (h * w))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            out[some] = layout_features_many(np.stack([pictures[i] for i in some]))
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, lengths, out=out, where=lengths > 0)


def _unit_embedding(model: Callable[[np.ndarray], np.ndarray], px: np.ndarray | None, dim: int) -> np.ndarray:
    """Unit embedding; zeros for a corrupt image or one that the model fails on."""
    try:
        v = np.zeros(dim) if px is None else np.asarray(model(px), dtype=np.float64)
    except (ValueError, ArithmeticError):
        v = np.zeros(dim)
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def embed(
    images: DataFrame, key: str = "origin", make: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None, dim: int = S.CLIP_DIM
) -> DataFrame:
    """Unit embedding per image from a model built once per Python worker.

    ``make()`` returns a function from BGR pixels to a vector; a corrupt image, or one the
    model fails on, gets the zero vector.
    """
    return vectors(images, key, make, dim, with_hsv=False)


def vectors(
    images: DataFrame, key: str = "origin", make: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None, dim: int = S.CLIP_DIM, with_hsv: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(key, vector, hsv): embedding and colour histogram of each image, from one pass over its pixels; ``keep`` names columns to pass on."""
    passed = [key, *keep]
    kinds = ", ".join(f"{c} {images.schema[c].dataType.simpleString()}" for c in passed)
    made = ["vector", "hsv"] if with_hsv else ["vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make() if make else None
        for part, pictures in _slices(batches, SLICE_ROWS if make or dim != S.CLIP_DIM else MANY_ROWS):
            if model is None and dim == S.CLIP_DIM:
                columns = [list_column(_unit_layouts(pictures, dim))]
            else:
                columns = [pa.array([_unit_embedding(model or layout_features, px, dim) for px in pictures], DOUBLES)]
            if with_hsv:
                columns.append(pa.array([_unit_hsv(px) for px in pictures], DOUBLES))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in passed), *columns], names=[*passed, *made])

    return images.select(*passed, *FIELDS).mapInArrow(run, ", ".join([kinds, *(f"{c} array<double>" for c in made)]))


def feature_pipeline(images: DataFrame, store: DataFrame, now: Column, key: str = "key", make=None, namespace: str = "combined"):
    """Combined feature per image: stored ones are reused, the others computed.

    ``images`` has ``key``, mtime and the pixel fields. Returns the features and the store
    rows to write. Pixels of images found in the store are not read again: the missing
    ones are picked before any Python runs. What was looked up and what was computed are
    written once each, and no join sends pixels or features through the driver.
    """
    from ..functions.vectors import combine
    from . import features as feat

    wanted = images.select(F.col(key).alias("key"), F.lit(namespace).alias("namespace"), "mtime")
    looked = cut(feat.lookup(wanted, store, now))
    hits = looked.where("hit").select("key", "mtime", F.col("feature").cast("array<double>").alias("feature"))
    absent = looked.where("NOT hit").select(F.col("key").alias(key))
    missing = images.join(absent.hint("merge"), key, "left_semi")
    computed = cut(vectors(missing, key, make, keep=("mtime",)).select(
        F.col(key).alias("key"), "mtime", combine(F.col("vector"), F.col("hsv")).alias("feature")
    ))
    both = hits.withColumn("cached", F.lit(True)).unionByName(computed.withColumn("cached", F.lit(False)))
    rows = computed.select(
        "key", F.lit(namespace).alias("namespace"), "mtime", now.alias("written_at"), F.col("feature").cast("array<float>").alias("feature")
    )
    return both, rows

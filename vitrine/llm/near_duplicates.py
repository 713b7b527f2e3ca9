"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

1. Each text becomes the set of its word shingles and one signature: the 64-bit hashes are
   split by their top bits into bins, a bin's value is its smallest hash, and an empty bin
   takes the value of the first filled bin in its own random order (optimal densification).
2. Texts with equal sets are one class, named by its smallest id; only classes go on.
3. A band hashes a few bins. In each bucket, however large, the members are candidates of
   its smallest member only: a star, as many pairs as members.
4. Stars are confirmed on the full sets, and joined to components.
5. A bucket whose members ended in different components may hide links that no star
   tested. Those members, and no others, are compared by signature in blocks; what may be
   similar is confirmed on full sets in the same blocks. So no link inside a bucket is lost, and a
   bucket of near copies of one text, which is one component, costs nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import SHINGLE_WORDS, SIMILARITY_PERCENT, mix, shingle_hashes, slices, texts, tokenize
from .graph import components

BIN_BITS = 7
BANDS = 32
BLOCK_ROWS = 512
#: Signatures of pairs at the limit agree in this share of bins or more (four deviations).
ESTIMATE_SLACK = 0.16


def signature(hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Smallest hash per bin of sorted distinct hashes, empty bins densified."""
    bins = len(probes)
    place = (hashes >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    filled = np.zeros(bins, dtype=bool)
    filled[place[first]] = True
    out = np.zeros(bins, dtype=np.uint64)
    out[place[first]] = hashes[first]
    if len(first) < bins:
        empty = np.flatnonzero(~filled)
        order = probes[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def probe_orders(bins: int) -> np.ndarray:
    """For each bin its own order in which an empty bin looks for a filled one."""
    rng = np.random.default_rng(20_240_601)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def sketches(docs: DataFrame, key: str, bin_bits: int = BIN_BITS, bands: int = BANDS, k: int = SHINGLE_WORDS) -> DataFrame:
    """key, n (set size), digest of the set, one hash per band, and eight bits per bin."""
    bins = 1 << bin_bits
    probes = probe_orders(bins)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for part in slices(batches, "text"):
            h, ends = tokenize(part["text"])
            rows = []
            for i in range(len(part)):
                s = shingle_hashes(h[ends[i] : ends[i + 1]], k)
                if len(s) == 0:
                    rows.append((0, None, None, None))
                    continue
                sig = signature(s, probes)
                band = salt.copy()
                for column in sig.reshape(bands, -1).T:
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + column)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rows.append((len(s), digest, band.view(np.int64), (mix(sig) & np.uint64(255)).astype(np.uint8).tobytes()))
            out = pd.DataFrame(rows, columns=["n", "digest", "bands", "sig"])
            out.insert(0, key, part[key].to_numpy())
            yield out

    kind = dict(docs.dtypes)[key]
    return docs.mapInPandas(run, f"{key} {kind}, n long, digest binary, bands array<long>, sig binary")


def shingle_set(text: str, k: int) -> set:
    w = text.encode().lower().split()
    return set(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def similar(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, pool: DataFrame, key: str, percent: int = SIMILARITY_PERCENT, k: int = SHINGLE_WORDS) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, worked out from the texts."""
    a = pool.select(F.col(key).alias("a"), F.col("text").alias("_ta"))
    b = pool.select(F.col(key).alias("b"), F.col("text").alias("_tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_set = None, set()
        for batch in batches:
            hit = np.zeros(len(batch), dtype=bool)
            for i, (ta, tb) in enumerate(zip(batch["_ta"], batch["_tb"], strict=True)):
                if ta != last:
                    last, last_set = ta, shingle_set(ta, k)
                hit[i] = similar(last_set, shingle_set(tb, k), percent)
            yield batch.loc[hit, ["a", "b"]]

    return pairs.join(b, "b").join(a, "a").mapInPandas(run, "a long, b long")


def agreements(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many of its 8 * w bytes each row has in common with ``row``."""
    lanes = (rows == row).view(np.uint64).sum(axis=1, dtype=np.uint64)
    return lanes.view(np.uint8).reshape(len(rows), 8).sum(axis=1, dtype=np.int64)


def hidden_links(members: DataFrame, comps: DataFrame, reps: DataFrame, pool: DataFrame, key: str, percent: int, k: int,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links inside buckets whose members are in different components.

    A bucket's main component is that of its star's centre. Its members are compared with
    the rest of the bucket, and the rest with each other, by signature, in blocks of
    ``block_rows``; a pair counts in the first bucket it shares. Only members with a possible
    partner then fetch their texts into the block, where the pairs are confirmed. Blocks
    give back links, never pairs that only may be one.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = members.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    at = at.select("band", "rep", "center", F.coalesce("component", "rep").alias("comp"))
    mixed = at.groupBy("band").agg(
        F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.max(F.expr("if(rep = center, comp, null)")).alias("main")
    ).where("_lo <> _hi").select("band", "main")
    # The centre itself was tested with every member already.
    odd = cut(at.where("rep <> center").join(mixed, "band").select("band", "rep", "comp", (F.col("comp") != F.col("main")).cast("int").alias("minor")))
    blocks = lambda kind: F.ceil(F.sum(F.expr(f"int(minor = {kind})")) / block_rows).cast("int")
    sizes = odd.groupBy("band").agg(blocks(0).alias("_km"), blocks(1).alias("_kr")).where("_kr > 0")
    rows = odd.join(sizes, "band").join(reps.select("rep", "n", "bands", "sig"), "rep")
    own = rows.withColumn("blk", F.pmod(F.xxhash64("rep"), F.when(F.col("minor") == 1, F.col("_kr")).otherwise(F.col("_km"))).cast("int"))
    # Block i of the rest meets every main block (side 0) and every block j >= i of the rest (side 1).
    none = F.expr("cast(array() as array<struct<i:int,side:int,j:int,left:boolean>>)")
    place = lambda i, side, j, left: F.struct(i.cast("int").alias("i"), F.lit(side).alias("side"), j.cast("int").alias("j"), F.lit(left).alias("left"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    main = F.transform(upto("_kr"), lambda i: place(i, 0, F.col("blk"), False))
    with_main = F.when(F.col("_km") > 0, F.transform(upto("_km"), lambda j: place(F.col("blk"), 0, j, True))).otherwise(none)
    as_left = F.transform(F.sequence(F.col("blk"), F.col("_kr") - 1), lambda j: place(F.col("blk"), 1, j, True))
    as_right = F.transform(F.sequence(F.lit(0), F.col("blk")), lambda i: place(i, 1, F.col("blk"), False))
    spread = own.withColumn("_p", F.explode(F.when(F.col("minor") == 1, F.concat(with_main, as_left, as_right)).otherwise(main)))
    group = ["band", "i", "side", "j"]
    spread = spread.select("band", "_p.*", "rep", "n", "comp", "bands", "sig").repartition(parts, *group)
    least = percent / 100 - ESTIMATE_SLACK

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g["left"]], g[~g["left"]]
        found: dict[int, list[int]] = {}
        if len(x) and len(y):
            sx, sy = (np.frombuffer(b"".join(t["sig"]), np.uint8).reshape(len(t), -1) for t in (x, y))
            bx, by = np.stack(x["bands"]), np.stack(y["bands"])
            band = g["band"].iat[0]
            nx, ny, cx, cy = (c.to_numpy() for c in (x["n"], y["n"], x["comp"], y["comp"]))
            ix, iy = x["rep"].to_numpy(), y["rep"].to_numpy()
            for i in range(len(x)):
                fit = np.flatnonzero((cy != cx[i]) & (100 * np.minimum(ny, nx[i]) >= percent * np.maximum(ny, nx[i])))
                if len(fit):
                    fit = fit[agreements(sy[fit], sx[i]) >= least * sy.shape[1]]
                if len(fit):
                    shared = by[fit] == bx[i]
                    fit = fit[bx[i][shared.argmax(axis=1)] == band]
                    for j in iy[fit]:
                        found.setdefault(int(ix[i]), []).append(int(j))
                        found.setdefault(int(j), [])
        out = pd.DataFrame({"rep": np.array(list(found), dtype=np.int64), "partners": pd.Series(list(found.values()), dtype=object)})
        for c in reversed(group):
            out.insert(0, c, g[c].iat[0])
        return out

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        sets = {r: shingle_set(t, k) for r, t in zip(g["rep"], g["text"], strict=True)}
        out = [(a, b) for a, ps in zip(g["rep"], g["partners"], strict=True) for b in ps if b in sets and similar(sets[a], sets[b], percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    maybe = cut(spread.groupBy(*group).applyInPandas(compare, "band long, i int, side int, j int, rep long, partners array<long>"))
    full = maybe.join(pool.select(F.col(key).alias("rep"), "text"), "rep").repartition(parts, *group)
    return full.groupBy(*group).applyInPandas(settle, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", percent: int = SIMILARITY_PERCENT, k: int = SHINGLE_WORDS) -> DataFrame:
    """key, n_shingles, component_id and kept, one row for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links (100 * common shingles >=
    ``percent`` * shingles in either), ``kept`` marks it. Texts without words, null or empty,
    have no shingles and are components of their own. Rows that repeat an id are one
    document whose texts share its links; all of them are returned. Rows without an id are
    linked with nothing: their component is null and they are kept. Keys are longs.
    """
    src = texts(docs, key)
    base = cut(sketches(src, key, k=k))
    reps = cut(
        base.where(F.col("n") > 0).where(F.col(key).isNotNull())
        .groupBy("digest").agg(F.min(F.struct(F.col(key).alias("rep"), "n", "bands", "sig")).alias("r"))
        .select("digest", "r.*")
    )
    banded = reps.select("rep", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.min("rep").alias("center"), F.max("rep").alias("_last")).where("center <> _last")
    members = cut(banded.join(stars.select("band", "center"), "band"))
    pool = cut(src.join(members.select(F.col("rep").alias(key)).distinct(), key, "left_semi"))
    tested = cut(members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct())
    links = cut(confirm(tested, pool, key, percent, k))
    comps = components(links)
    more = cut(hidden_links(members, comps, reps, pool, key, percent, k))
    if not more.isEmpty():
        comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    classes = reps.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("digest", F.coalesce("component", "rep").alias("_c"))
    return (
        base.select(key, "n", "digest").join(classes, "digest", "left")
        .withColumn("component_id", F.when(F.col(key).isNotNull(), F.coalesce("_c", key)))
        .select(key, F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"))
    )

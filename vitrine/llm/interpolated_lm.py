"""Language-model scores by deleted interpolation of n-gram estimates.

Maximum-likelihood estimates of all orders and a uniform one are mixed, with weights that
depend on how often the context was seen (buckets by powers of two). The weights come from
expectation-maximisation on a part of the training documents whose own counts are deleted;
the final counts cover all training documents.

Texts are packed into blocks. A block sends each of its distinct n-grams once, as packed
sorted 64-bit hashes parted by hash; every part adds up the counts of all blocks and sends
each block the counts of its own n-grams back. So what moves is one entry per distinct
n-gram and block, a frequent n-gram is no heavier than a rare one, and no table of counts
has to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import fold, mix, texts, word_hashes

ORDER = 2
BLOCK_CHARS = 8_000_000
PART_KEYS = 2_000_000
#: Width of the bins of log2 ratios in which the weights are learned.
RATIO_STEP = 0.25
END, START = np.uint64(0x5E3D), np.uint64(0xA11CE)
TEST, DEV, TRAIN = 0, 1, 2


def _pack(docs: DataFrame, key: str, folds: int) -> DataFrame:
    """Blocks of whole texts of one kind: block, kind, ids, lens, blob."""
    number = fold(F.col(key), folds)
    kind = F.when(number == 0, TEST).when(number == 1, DEV).otherwise(TRAIN)
    src = texts(docs, key).withColumn("kind", kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, at = 0, TaskContext.get().partitionId()
        for batch in batches:
            for what, rows in batch.groupby("kind"):
                for _, part in rows.groupby(rows["text"].str.len().to_numpy().cumsum() // BLOCK_CHARS):
                    raw = [t.encode().lower() for t in part["text"]]
                    ids = [None if pd.isna(i) else int(i) for i in part[key]]
                    yield pd.DataFrame({"block": [at * 1_000_000_000 + made], "kind": [what], "ids": [ids], "lens": [[len(r) for r in raw]],
                                        "blob": [pa.compress(b"".join(raw), codec="zstd", asbytes=True)]})
                    made += 1

    return src.mapInPandas(run, "block long, kind int, ids array<long>, lens array<int>, blob binary")


def _grams(lens: np.ndarray, blob: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each token, for each order, and each text's first token.

    An end token closes every text. Contexts before a text's start are start tokens.
    """
    raw = pa.decompress(blob, decompressed_size=int(lens.sum()), codec="zstd", asbytes=True) if lens.sum() else b""
    tokens, counts, at = [], np.empty(len(lens), dtype=np.int64), 0
    for i, n in enumerate(lens):
        own = raw[at : at + n].split()
        tokens += own
        counts[i] = len(own) + 1
        at += n
    first = np.concatenate([[0], counts.cumsum()[:-1]])
    last = counts.cumsum() - 1
    one = np.empty(int(counts.sum()), dtype=np.uint64)
    inner = np.ones(len(one), dtype=bool)
    inner[last] = False
    one[inner] = word_hashes(tokens) if tokens else np.empty(0, np.uint64)
    one[last] = END
    grams = [one]
    for k in range(2, order + 1):
        before = np.roll(grams[-1], 1)
        before[first] = START + np.uint64(k)
        grams.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + one + np.uint64(k)))
    return grams, first


def _squeeze(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.uint64).tobytes(), codec="zstd", asbytes=True)


def _spread(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint64).astype(np.int64) if n else np.empty(0, np.int64)


def _counts(blocks: DataFrame, order: int, part_bits: int, parts: int) -> DataFrame:
    """block, kind, part, and per order the counts of the block's n-grams in sorted order.

    ``c`` counts all training texts, ``r`` those without the DEV part (for DEV blocks only).
    The first row of a part carries its number of distinct training tokens and their sum.
    """
    names = [f"{a}{k}" for k in range(1, order + 1) for a in ("k", "n")]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                grams, _ = _grams(np.asarray(row.lens, dtype=np.int64), row.blob, order)
                cols = {}
                for k, g in enumerate(grams, 1):
                    keys, n = np.unique(g, return_counts=True)
                    edges = np.searchsorted(keys, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)) if part_bits else np.empty(0, np.int64)
                    cols[f"k{k}"] = [x.tobytes() for x in np.split(keys, edges)]
                    cols[f"n{k}"] = [_squeeze(x) for x in np.split(n, edges)]
                yield pd.DataFrame({"part": range(1 << part_bits), "block": row.block, "kind": row.kind, **cols})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        out = {"part": group["part"].to_numpy(), "block": group["block"].to_numpy(), "kind": group["kind"].to_numpy()}
        kinds = out["kind"]
        distinct, total = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for k in range(1, order + 1):
            keys = [np.frombuffer(b, np.uint64) for b in group[f"k{k}"]]
            sizes = np.array([len(x) for x in keys])
            n = np.concatenate([_spread(b, m) for b, m in zip(group[f"n{k}"], sizes, strict=True)])
            known, place = np.unique(np.concatenate(keys), return_inverse=True)
            of = np.repeat(kinds, sizes)
            every = np.bincount(place, weights=n * (of != TEST), minlength=len(known)).astype(np.int64)
            dev = np.bincount(place, weights=n * (of == DEV), minlength=len(known)).astype(np.int64)
            edges = sizes.cumsum()[:-1]
            out[f"c{k}"] = [_squeeze(x) for x in np.split(every[place], edges)]
            out[f"r{k}"] = [_squeeze(x) if kind == DEV else None for kind, x in zip(kinds, np.split((every - dev)[place], edges), strict=True)]
            out[f"m{k}"] = sizes
            if k == 1:
                distinct[0], total[0] = int((every > 0).sum()), int(every.sum())
                rest = int((every - dev).sum())
        out |= {"distinct": distinct, "total": total, "rest": np.where(np.arange(len(group)) == 0, rest, 0)}
        return pd.DataFrame(out)

    sent = blocks.select("block", "kind", "lens", "blob").mapInPandas(send, "part int, block long, kind int, " + ", ".join(f"{n} binary" for n in names))
    back = ", ".join(f"c{k} binary, r{k} binary, m{k} int" for k in range(1, order + 1))
    return sent.repartition(parts, "part").groupBy("part").applyInPandas(add, f"part int, block long, kind int, {back}, distinct long, total long, rest long")


def _lookup(block: pd.DataFrame, counts: pd.DataFrame, order: int, column: str):
    """Per order each token's n-gram count and its context's; then each text's first token."""
    row = block.iloc[0]
    grams, first = _grams(np.asarray(row["lens"], dtype=np.int64), row["blob"], order)
    counts = counts.sort_values("part")
    values = []
    for k, g in enumerate(grams, 1):
        _, place = np.unique(g, return_inverse=True)
        values.append(np.concatenate([_spread(b, m) for b, m in zip(counts[f"{column}{k}"], counts[f"m{k}"], strict=True)])[place])
    ends = np.concatenate([first[1:], [len(grams[0])]]) - 1
    texts_seen = int(values[0][ends[0]])  # the count of the end token is that of training texts
    contexts = []
    for k in range(1, order):
        before = np.roll(values[k - 1], 1)
        before[first] = texts_seen
        contexts.append(before)
    return row, values, contexts, first


def _estimates(values, contexts, total: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates (tokens x components: uniform, unigram, bigram ...) and the bucket of the context."""
    p = [np.full(len(values[0]), 1.0 / (words + 1)), values[0] / max(total, 1)]
    p += [v / np.maximum(c, 1) for v, c in zip(values[1:], contexts, strict=True)]
    context = contexts[-1] if contexts else np.zeros(len(values[0]))
    return np.stack(p, axis=1), np.log2(context + 1).astype(np.int64)


def _learn(histogram: list, components: int, rounds: int = 40) -> dict[int, np.ndarray]:
    """Mixture weights per bucket by EM over (bucket, log ratios to the uniform estimate, count)."""
    weights = {}
    for bucket in {h[0] for h in histogram}:
        own = [h for h in histogram if h[0] == bucket]
        ratio = np.array([[1.0] + [0.0 if r is None else 2.0 ** (r * RATIO_STEP) for r in h[1]] for h in own])
        n = np.array([h[2] for h in own], dtype=float)
        w = np.full(components, 1 / components)
        for _ in range(rounds):
            post = ratio * w
            post /= post.sum(axis=1, keepdims=True)
            w = (n @ post + 0.01) / (n.sum() + 0.01 * components)
        weights[bucket] = w
    return weights


def score(docs: DataFrame, key: str = "doc_id", order: int = ORDER, folds: int = 10) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Held out are the texts of fold 0 (crc32 of the key); fold 1 gives the mixture weights;
    all but fold 0 give the counts. Rows without a key count as training texts. Null and
    empty texts have the end token only. ``score`` is the log10 probability of the text.
    """
    spark = docs.sparkSession
    blocks = cut(_pack(docs, key, folds))
    chars = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    # A power of two of parts, of some PART_KEYS keys each.
    part_bits = max(0, int(np.ceil(np.log2(max(1, chars / 6 * order / PART_KEYS)))))
    parts = max(1 << part_bits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = cut(_counts(blocks, order, part_bits, min(parts, 1 << part_bits)))
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "total", "rest"))).first()
    vocabulary, total, rest = sums["distinct"], sums["total"], sums["rest"]
    names = [f"q{k}" for k in range(1, order + 1)]

    def tally(_key, block: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        _, values, contexts, _ = _lookup(block, mine, order, "r")
        p, bucket = _estimates(values, contexts, rest, vocabulary)
        with np.errstate(divide="ignore"):
            q = np.rint(np.log2(p[:, 1:] / p[:, :1]) / RATIO_STEP)
        out = pd.DataFrame(np.where(np.isfinite(q), q, -32768).astype(np.int64), columns=names)
        out["bucket"] = bucket
        return out.groupby(["bucket", *names]).size().reset_index(name="n")

    cogroup = lambda b, c: b.groupBy("block").cogroup(c.groupBy("block"))
    slim = counts.drop("distinct", "total", "rest", "kind")
    seen = cogroup(blocks.where(F.col("kind") == DEV).drop("kind", "ids"), slim.join(blocks.where(F.col("kind") == DEV).select("block"), "block", "left_semi")).applyInPandas(
        tally, ", ".join(f"{n} long" for n in names) + ", bucket long, n long")
    # As many rows as there are buckets and bins of ratios, whatever the size of the corpus.
    table = seen.groupBy("bucket", *names).agg(F.sum("n").alias("n")).collect()
    weights = _learn([(r["bucket"], [None if r[n] == -32768 else r[n] for n in names], r["n"]) for r in table], order + 1)
    known = max(weights, default=0)
    mixture = np.stack([weights.get(b, np.full(order + 1, 1 / (order + 1))) for b in range(known + 1)]) if weights else np.full((1, order + 1), 1 / (order + 1))

    def rate(_key, block: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        row, values, contexts, first = _lookup(block, mine, order, "c")
        p, bucket = _estimates(values, contexts, total, vocabulary)
        logs = np.log10((p * mixture[np.minimum(bucket, known)]).sum(axis=1))
        base = np.log10((values[0] + 0.1) / (total + 0.1 * (vocabulary + 1)))
        sizes = np.diff(np.append(first, len(logs)))
        return pd.DataFrame({
            key: pd.array(list(row["ids"]), dtype="Int64"), "held_out": row["kind"] == TEST, "n_tokens": sizes,
            "n_known": np.add.reduceat((values[0] > 0).astype(np.int64), first), "train_tokens": total,
            "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(logs, first),
        })

    return cogroup(blocks, slim.select(*[c for c in slim.columns if not c.startswith("r")])).applyInPandas(
        rate, f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

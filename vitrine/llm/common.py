"""What the operators share: reading inputs, fold numbers, words and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
#: The ASCII white space that separates words: \x20 and \x09 to \x0D.
SPACE = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, null texts as empty ones; other columns cannot clash."""
    return docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null keys fall into fold -1."""
    return F.coalesce((F.crc32(key.cast("string").cast("binary")) % parts).cast("int"), F.lit(-1))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def words(text: Column) -> Column:
    """The maximal runs without ASCII white space, A-Z in lower case."""
    return F.filter(F.split(lower_ascii(text), SPACE, -1), lambda w: w != "")


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """One 0/1 label per document: rows with a null are left out, the larger of two wins."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("label"))
    )


def slices(batches: Iterator[pd.DataFrame], column: str, most_bytes: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """The batches again, cut so that the texts of one piece stay near ``most_bytes`` characters."""
    for batch in batches:
        if batch.empty:
            continue
        total = batch[column].str.len().to_numpy().cumsum()
        piece = total // most_bytes
        if piece[-1] == piece[0]:
            yield batch
            continue
        for _, part in batch.groupby(piece, sort=True):
            yield part


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The Arrow batches again, cut so that the texts of one piece stay near ``most_bytes``. Keys keep their type, nulls or not."""
    for batch in batches:
        if not len(batch):
            continue
        piece = pc.binary_length(batch[column]).to_numpy(zero_copy_only=False).astype(np.int64).cumsum() // most_bytes
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
            yield batch.slice(start, end - start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, each distinct word hashed once."""
    import pyarrow as pa
    import xxhash

    coded = pa.array(tokens, type=pa.binary()).dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    known = np.fromiter(map(h, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)]


def tokenize(batch: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words start (n + 1 bounds).

    bytes.lower and bytes.split treat ASCII letters and ASCII white space only, which is
    the word rule of these operators.
    """
    tokens: list[bytes] = []
    ends = np.zeros(len(batch) + 1, dtype=np.int64)
    for i, text in enumerate(batch):
        tokens += text.encode().lower().split()
        ends[i + 1] = len(tokens)
    return word_hashes(tokens) if tokens else np.empty(0, np.uint64), ends


def shingle_hashes(h: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes, sorted, of the k-word shingles; a shorter text is one shingle."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)

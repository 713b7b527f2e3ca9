"""SentencePiece encoding and decoding through tables of distinct chunks.

A chunk is a run of space markers and the characters up to the next marker. When no piece
of the vocabulary has a marker after another character, no merge can cross from one chunk
into the next, so a text's ids are the ids of its chunks in order. Each Arrow slice builds
the table of its distinct chunks, segments each once, and joins ids and decoded text back
by position. The table lives in the task: a table for the whole corpus would have to move
one row per word of the corpus through two shuffles, many times the size of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of distinct chunks that a task remembers before it starts a new table.
TABLE_CHARS = 16_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Distinct chunks with their ids and decoded text; bounded, for one task."""

    def __init__(self, model: bytes, most_chars: int = TABLE_CHARS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses a space marker: texts cannot be cut into chunks")
        if self.sp.encode("a  b") == self.sp.encode("a b") or self.sp.encode("b") != self.sp.encode("a b")[1:]:
            raise ValueError("the model drops spaces or adds no marker: texts cannot be cut into chunks")
        # A marker that ends a text is a chunk of its own, which the library cannot be given alone.
        self.alone = {MARK: ([self.sp.piece_to_id(MARK)], "")}
        self.most, self.chars, self.known = most_chars, 0, dict(self.alone)

    def add(self, chunks: set[str]) -> None:
        fresh = [c for c in chunks if c not in self.known]
        size = sum(map(len, fresh))
        if self.chars and self.chars + size > self.most:
            self.known, self.chars, fresh = dict(self.alone), 0, list(chunks - {MARK})
            size = sum(map(len, fresh))
        # The library puts one marker before a text, so a chunk goes in without its first one.
        ids = self.sp.encode([c[1:] for c in fresh], num_threads=1)
        # The first chunk of a sentence loses one leading space when decoded; the rest keep it.
        back = self.sp.decode(ids, num_threads=1) if fresh else []
        self.known.update(zip(fresh, zip(ids, back, strict=True), strict=True))
        self.chars += size

    def code(self, batch: pd.Series) -> tuple[list[list[int]], list[str]]:
        """Ids and decoded text of each text."""
        cut = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in batch]
        self.add(set(chain.from_iterable(cut)))
        known, all_ids, all_back = self.known, [], []
        for chunks in cut:
            found = [known[c] for c in chunks]
            all_ids.append(list(chain.from_iterable(f[0] for f in found)))
            all_back.append(" ".join(f[1] for f in found))
        return all_ids, all_back


def encode_decode(docs: DataFrame, model_path: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, ids (array<int>) and decoded (the library's decode of the ids), one row per row.

    Null and empty texts give no ids and an empty decoded text. Repeated rows stay. Other
    columns of ``docs`` are not looked at. The model file is read once, by the driver.
    """
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    src = texts(docs, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks = ChunkTable(model)
        for part in slices(batches, "text", 2_000_000):
            ids, back = chunks.code(part["text"])
            yield pd.DataFrame({key: part[key].to_numpy(), "ids": ids, "decoded": back})

    kind = src.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return src.mapInPandas(run, schema)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

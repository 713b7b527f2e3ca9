"""Secrets in texts: exact patterns, and random strings by their token efficiency.

The patterns (assignments, access keys, long hexadecimal runs) give the base spans, which stay.
Then every other run of at least ``LEAST_CHARS`` key characters is cut into tokens of a byte-pair
vocabulary. Words and names consist of frequent pieces, three characters a token and more; a
random string falls into pieces of one or two. Runs below ``MOST_RATIO`` characters a token are
added with the kind ``random``, unless they are known digests (by length and alphabet, or named
as such just before) or identifiers (numbers, dates, UUIDs, words joined by separators or humps).

The whole of every run is cut into tokens, in pieces of ``PIECE_CHARS``, since one run can be as
long as a text. The vocabulary is a parameter: a rank file, read once by the driver.

Null and empty texts have no spans. Repeated rows stay, rows without a key too; other columns are
not looked at. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_slices, texts

KINDS = ("assign", "access", "hex")
ADDED = "random"
LEAST_CHARS = 20
MOST_RATIO = 1.8
PIECE_CHARS = 1_000

# The patterns of the base spans and the least lengths of their matches. A repeat
# with a least length finds what a plain one finds before short matches fall away, save for
# assignments, where a failing match also takes its characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 8
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{32,}")

RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_CHARS)
HEX_DIGEST_CHARS = (16, 32, 40, 48, 56, 64, 96, 128)  # 64-bit sums, MD5, SHA-1, Tiger, SHA-2
BASE64_DIGEST_CHARS = (22, 27, 38, 43, 64, 86)  # MD5, SHA-1, SHA-2, without padding
HEX_ONLY = re.compile("[0-9a-f]+|[0-9A-F]+")
DIGEST_NAME = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512)|commit|checksum|digest|etag|integrity|fingerprint|hash)[\"'`]?[\x20:=(#-]{0,3}[\"'`]?$", re.I | re.A)
DIGEST_PREFIX = re.compile(r"(?:md5|sha(?:1|224|256|384|512))[-_](?=.)", re.I | re.A)
UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile("[0-9][0-9TZ_/+-]*")
_PART = "(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)++[0-9]{0,4}+|[A-Za-z][0-9]{0,4}+|[0-9]{1,4}+)"
NAME = re.compile(f"[+/_-]*+{_PART}(?:[+/_-]++{_PART})*+[+/_-]*+")
NAME_CHARS = 24  # characters before a run that may name it a digest


def is_digest(run: str, before: str) -> bool:
    """Whether a run has the shape of a known digest, ``before`` being what stands before it."""
    bare = run.rstrip("=")
    prefix = DIGEST_PREFIX.match(bare)
    rest = bare[prefix.end() :] if prefix else bare
    if HEX_ONLY.fullmatch(rest) and len(rest) in HEX_DIGEST_CHARS:
        return True
    return len(rest) in BASE64_DIGEST_CHARS and bool(prefix or DIGEST_NAME.search(before))


def is_identifier(run: str) -> bool:
    """Whether a run is a number, a date, a UUID, or words joined by separators or humps."""
    bare = run.rstrip("=")
    return bool(UUID.fullmatch(bare) or NUMBER.fullmatch(bare) or NAME.fullmatch(bare))


def base_spans(text: str, low: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; ``low`` is the text in lower case, ``runs`` its runs of key characters."""
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    for start, end in runs:  # a long hexadecimal run lies in a run of key characters
        if end - start >= 32:
            out += [(*m.span(), "hex") for m in HEX.finditer(text, start, end)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def outside(start: int, end: int, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The parts of a run that no taken span covers."""
    for s, e, _ in sorted(taken):
        if s < end and e > start:
            if s > start:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


class Scanner:
    """The scan of one text, with a vocabulary."""

    def __init__(self, ranks: bytes, most_ratio: float = MOST_RATIO):
        import base64

        import public_tokenizers
        import tiktoken

        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.tokens = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.most = most_ratio

    def ratio(self, run: str) -> float:
        """Characters per token."""
        return len(run) / sum(len(self.tokens(run[i : i + PIECE_CHARS])) for i in range(0, len(run), PIECE_CHARS))

    def scan(self, text: str) -> list[dict]:
        """start, end, kind, base and (for added spans) ratio, by start, then kind."""
        runs = [m.span() for m in RUN.finditer(text)]
        base = base_spans(text, text.lower(), runs)
        out = [{"start": s, "end": e, "kind": k, "base": True, "ratio": None} for s, e, k in base]
        for run in runs:
            for start, end in outside(*run, base) if base else [run]:
                piece = text[start:end]
                if end - start < LEAST_CHARS or is_identifier(piece) or is_digest(piece, text[max(0, start - NAME_CHARS) : start]):
                    continue
                ratio = self.ratio(piece)
                if ratio < self.most:
                    out.append({"start": start, "end": end, "kind": ADDED, "base": False, "ratio": ratio})
        return sorted(out, key=lambda s: s["start"]) if len(out) > len(base) else out


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def find(docs: DataFrame, ranks_path: str | None = None, key: str = "doc_id", most_ratio: float = MOST_RATIO) -> DataFrame:
    """key and spans (array of start, end, kind, base, ratio), a row per row."""
    with open(ranks_path or default_ranks(), "rb") as f:
        ranks = f.read()
    src = texts(docs, key)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("ratio", T.DoubleType())])
    schema = T.StructType([T.StructField(key, src.schema[key].dataType), T.StructField("spans", T.ArrayType(span))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ranks, most_ratio)
        for part in arrow_slices(batches, "text"):
            spans = [scanner.scan(t) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part[key].cast(arrow.field(0).type), pa.array(spans, type=arrow.field(1).type)], schema=arrow)

    return src.mapInArrow(run, schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(key, *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

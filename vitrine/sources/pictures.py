"""Pictures as files: bitmaps written by tasks, one by one for the image source, or packed as the rows of a table."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folders that the files of one table are spread over.
FOLDERS = 256
#: Bytes of file content that a task decodes at once, unless one file is larger.
SLICE_BYTES = 4 << 20
#: How files begin that are pictures, but no bitmaps.
OTHER_KINDS = (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF8", b"RIFF")
#: The image column of Spark's image source.
IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
IMAGE_TYPE = pa.struct([
    ("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())
])
#: OpenCV's number for three channels of 8 bits.
BGR_MODE = 16


def bitmap(height: int, width: int, channels: int, data: bytes) -> bytes:
    """An uncompressed 24-bit bitmap file of BGR rows from top to bottom, as the image source gives them.

    Grey pictures are written with three equal channels; a fourth channel is left out.
    """
    rows = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rows = np.repeat(rows, 3, axis=2) if channels == 1 else rows[:, :, :3]
    padded = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)  # rows end on four bytes
    padded[:, : 3 * width] = rows.reshape(height, 3 * width)
    body = padded[::-1].tobytes()  # rows are stored from the bottom up
    # Both headers, 14 and 40 bytes.
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def bitmap_pixels(content: bytes) -> tuple[int, int, bytes] | None:
    """Height, width and BGR rows from top to bottom of an uncompressed 24-bit bitmap; None if it is corrupt.

    Pictures of other kinds are refused, since they are not corrupt: the image source reads those.
    """
    if content.startswith(OTHER_KINDS):
        raise ValueError("a picture, but no bitmap: it is to be read by the image source")
    if len(content) < 54 or content[:2] != b"BM":
        return None
    start, head, width, height, _, bits, packing = struct.unpack_from("<10xIIiiHHI", content)
    if head < 40 or width < 1 or height == 0:
        return None
    if bits != 24 or packing:
        raise ValueError(f"a bitmap of {bits} bits and compression {packing}: it is to be read by the image source")
    n, step = abs(height), -(-3 * width // 4) * 4
    if start < 54 or len(content) < start + n * step:
        return None
    rows = np.frombuffer(content, np.uint8, n * step, start).reshape(n, step)[:, : 3 * width]
    return n, width, (rows[::-1] if height > 0 else rows).tobytes()


def _content(height: int | None, width: int | None, channels: int | None, data: bytes) -> bytes:
    """The file of a picture; one that was not decoded is written as the bytes it has."""
    whole = (height or 0) > 0 and (width or 0) > 0 and channels in (1, 3, 4) and len(data) == height * width * channels
    return bitmap(height, width, channels, data) if whole else data


def _placed(pictures: DataFrame, key: str) -> DataFrame:
    place = F.concat(F.hex(F.pmod(F.xxhash64(key), F.lit(FOLDERS))), F.lit("/"), F.col(key).cast("string"), F.lit(".bmp"))
    return pictures.select(key, "height", "width", "nChannels", F.coalesce("data", F.lit(b"")).alias("data"), place.alias("path"))


def _contents(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (_content(*row) for row in zip(*(batch[c].to_pylist() for c in ("height", "width", "nChannels", "data")), strict=True))


def packed(pictures: DataFrame, key: str) -> DataFrame:
    """The files of ``write`` as rows (path, length, content), as the binaryFile source gives them.

    Written as a table they are a few large files: nothing is opened, listed or planned per
    picture. ``decoded`` reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = list(_contents(batch))
            sizes = pa.array([len(c) for c in contents], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["path"], sizes, pa.array(contents, pa.binary())], names=["path", "length", "content"])

    return _placed(pictures, key).mapInArrow(run, "path string, length long, content binary")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[bytes]]]:
    """Paths and contents, about ``SLICE_BYTES`` of them at a time."""
    paths, contents, held = [], [], 0
    for path, content in zip(batch["path"], batch["content"]):
        paths.append(path.as_py())
        contents.append(content.as_py() or b"")
        held += len(contents[-1])
        if held >= SLICE_BYTES:
            yield paths, contents
            paths, contents, held = [], [], 0
    if paths:
        yield paths, contents


def decoded(files: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """``image`` of bitmaps (path, content), as the image source gives it: a corrupt one has height -1 unless dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paths, contents in _parts(batch):
                found = [bitmap_pixels(c) for c in contents]
                rows = [
                    {"origin": p, "height": x[0], "width": x[1], "nChannels": 3, "mode": BGR_MODE, "data": x[2]} if x
                    else {"origin": p, "height": -1, "width": -1, "nChannels": -1, "mode": -1, "data": b""}
                    for p, x in zip(paths, found) if x or not drop_invalid
                ]
                yield pa.RecordBatch.from_arrays([pa.array(rows, IMAGE_TYPE)], names=["image"])

    return files.select("path", "content").mapInArrow(run, IMAGE)


def write(pictures: DataFrame, key: str, folder: str) -> DataFrame:
    """Write one file per picture below a folder that all machines share; returns (key, path, n_bytes).

    ``pictures`` has height, width, nChannels and data. A picture that was not decoded (height
    below 1, or data of another length) is written as the bytes it has. A file appears whole or
    not at all, and a task that is run again replaces its own files. The result is a plan: the
    files are written when it is.
    """
    kind = pictures.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            sizes = []
            for content, path in zip(_contents(batch), batch["path"].to_pylist(), strict=True):
                target = f"{base}/{path}"
                if (parent := target.rpartition("/")[0]) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                # Names that begin with an underscore are not read by file sources.
                pending = f"{parent}/_{uuid.uuid4().hex}"
                with store.open_output_stream(pending) as out:
                    out.write(content)
                store.move(pending, target)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch[key], batch["path"], pa.array(sizes, pa.int64())], names=[key, "path", "n_bytes"])

    return _placed(pictures, key).mapInArrow(run, f"{key} {kind}, path string, n_bytes long")

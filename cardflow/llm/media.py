"""Media columns: texts stored losslessly as baseline JPEGs, read back with dimensions and thumbnail hashes.

Null and empty texts become one MCU of spaces. Equal texts give equal bytes and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cardflow.llm import jpeg
from cardflow.llm.common import extend, utf8

# Text bytes that are stored or read together.
TOGETHER = 1 << 20


def payloads(texts: pa.Array) -> Iterator[np.ndarray]:
    raw, bounds = utf8(texts)
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        size = max(1, -(-(end - start) // jpeg.MCU)) * jpeg.MCU
        payload = np.full(size, 32, np.uint8)
        payload[: end - start] = raw[start:end]
        yield payload


def store_as_media(docs: DataFrame, media: str = "media") -> DataFrame:
    """All columns and a binary JPEG that holds the text's UTF-8 bytes, space-padded to whole MCUs."""
    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(jpeg.pack(list(payloads(texts))), pa.binary())]

    return extend(docs, [T.StructField(media, T.BinaryType())], compute, limit=TOGETHER)


FEATURES = [
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("thumbnail_hash", T.StringType()),
    T.StructField("feature", T.StringType()),
]
# What parsing raises on bytes that are no baseline JPEG.
UNREADABLE = (ValueError, IndexError, KeyError, OverflowError, struct.error)


def _describe(streams: list[bytes]) -> list[tuple]:
    images = [jpeg.parse(s) for s in streams]
    jobs = [(image, scan) for image in images for scan in image.scans]
    decoded = iter(jpeg.decode_scans(jobs))
    rows = []
    for stream, image in zip(streams, images, strict=True):
        coefficients = [next(decoded) for _ in image.scans]
        pixels = jpeg.thumbnail(image, coefficients)
        name = f"{jpeg.difference_hash(pixels):016x}"
        payload = jpeg.unpack(image, coefficients) if image.comment.startswith(jpeg.TAG) else None
        digest = hashlib.sha256(pixels.tobytes()).hexdigest()[:16]
        rows.append((
            *((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
              if payload is not None else (None, None, None)),
            len(stream), hashlib.sha256(stream).hexdigest(), image.width, image.height, name,
            f"{image.width}x{image.height}:{name}:{digest}"))
    return rows


def read_media(docs: DataFrame, media: str = "media") -> DataFrame:
    """All columns and what the stored bytes tell: payload digest, dimensions, DC thumbnail hashes.

    A null, or bytes that are no baseline JPEG, give nulls; a JPEG without a payload gives null payload columns.
    """
    def compute(column: pa.Array) -> list[pa.Array]:
        rows: list[tuple] = [(None,) * len(FEATURES)] * len(column)
        streams = column.to_pylist()
        present = [i for i, s in enumerate(streams) if s is not None]
        try:
            found = _describe([streams[i] for i in present])
        except UNREADABLE:
            found = []
            for i in present:
                try:
                    found += _describe([streams[i]])
                except UNREADABLE:
                    found.append((None,) * len(FEATURES))
        for i, row in zip(present, found, strict=True):
            rows[i] = row
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]

    return extend(docs, FEATURES, compute, text=media, limit=TOGETHER)

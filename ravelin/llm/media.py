"""Media columns: payloads kept as lossless WebP images, and features of the pixels that are read back.

`store` turns a text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, into gray images of 192 samples
a row. A payload of more rows than an image can have becomes several images, one after the other in the same column.
`read_back` knows only the stored bytes: it decodes the images and describes their samples. Both work row by row, so
memory is bounded by the longest text of a batch part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm import webp
from ravelin.llm.common import arrow_columns, texts_of

UNIT = 192
#: Samples of one image.
MOST = UNIT * webp.MAX_SIDE


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(payload, bytes of the text)."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def encode_payload(payload: bytes) -> bytes:
    return b"".join(webp.encode_gray(payload[at : at + MOST], UNIT) for at in range(0, len(payload), MOST))


def split_files(media: bytes) -> list[bytes]:
    """The files that stand one after the other."""
    out, at = [], 0
    while at < len(media):
        (size,) = struct.unpack("<I", media[at + 4 : at + 8])
        out.append(media[at : at + 8 + size])
        at += 8 + size
    return out


def decode_samples(media: bytes) -> np.ndarray:
    """The rows of gray samples of all images of a column value."""
    return np.concatenate([webp.decode(x)[..., 1] for x in split_files(media)])


def feature_of(samples: np.ndarray) -> str:
    """Mean, entropy in bits, number of sample values and a difference hash of a 9 x 8 thumbnail."""
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    entropy = max(0.0, float(-(share * np.log2(share)).sum()))
    mean = float(counts @ np.arange(256)) / samples.size
    rows = np.linspace(0, samples.shape[0], 9).astype(np.int64)
    bands = np.array([samples[a : max(b, a + 1)].mean(axis=0) for a, b in zip(np.minimum(rows[:-1], samples.shape[0] - 1), rows[1:], strict=True)])
    across = np.linspace(0, samples.shape[1], 10).astype(np.int64)
    small = np.add.reduceat(bands, across[:-1], axis=1) / np.diff(across)
    bits = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    return f"{mean:.3f};{entropy:.4f};{len(share)};{bits}"


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """docs with media_col (binary) and size_col (bytes of the text) in place of text_col.

    A null text counts as empty. Columns with the new names are replaced; rows, repeated ones too, stay as they are.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            made = [payload_of(t) for t in texts_of(batch, text_col)]
            return {media_col: pa.array([encode_payload(p) for p, _ in made], pa.binary()), size_col: pa.array([n for _, n in made], pa.int64())}

        return work

    return arrow_columns(docs, make, [T.StructField(media_col, T.BinaryType()), T.StructField(size_col, T.LongType())], drop=(text_col,), rows=256)


def read_back(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with what its images hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, width,
    height and feature. A null image gives null columns; a broken one ends the job with a ValueError."""
    fields = [
        T.StructField(n, k())
        for n, k in (("payload_bytes", T.LongType), ("payload_sha256", T.StringType), ("tail_crc32", T.LongType), ("media_bytes", T.LongType), ("media_sha256", T.StringType), ("width", T.IntegerType), ("height", T.IntegerType), ("feature", T.StringType))
    ]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        samples = decode_samples(data)
        payload = samples.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), samples.shape[1], samples.shape[0], feature_of(samples))

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = [one(x) for x in batch.column(batch.schema.get_field_index(media_col)).to_pylist()]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            return {f.name: pa.array([r[k] for r in rows], kind) for k, (f, kind) in enumerate(zip(fields, kinds, strict=True))}

        return work

    return arrow_columns(media, make, fields, rows=256)


def pixels(media: DataFrame, media_col: str = "media", out_col: str = "pixels") -> DataFrame:
    """media with out_col: struct(width, height, rgba binary) for each file that a value holds, in order."""
    kind = T.ArrayType(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType())]))

    def make():
        arrow = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())]))

        def one(data: bytes | None):
            if data is None:
                return None
            return [{"width": x.shape[1], "height": x.shape[0], "rgba": x.tobytes()} for x in map(webp.decode, split_files(data))]

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {out_col: pa.array([one(x) for x in batch.column(batch.schema.get_field_index(media_col)).to_pylist()], arrow)}

        return work

    return arrow_columns(media, make, [T.StructField(out_col, kind)], rows=64)


def media_digest(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id with what its stored text gives when it is read back."""
    stored = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return read_back(stored.select("doc_id", "n_bytes", "media")).drop("media")

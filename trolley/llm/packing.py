"""Texts as compressed bytes while they move between tasks.

A shuffle compresses rows of many texts in small blocks with a fast codec;
compressing each text by itself first moves about a third less.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import CHUNK_BYTES


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def pack(df: DataFrame, text: str = "_text") -> DataFrame:
    """df with its column ``text`` replaced by _z (compressed, null for null) and _zn (bytes it had)."""
    rest = [c for c in df.columns if c != text]

    def run(batches):
        codec = _codec()
        for b in batches:
            small, sizes = [], []
            for t in b.column(text):
                raw = t.as_py()
                raw = raw if raw is None else raw.encode("utf-8", "surrogatepass")
                small.append(raw if not raw else codec.compress(raw, asbytes=True))
                sizes.append(len(raw or b""))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in rest] + [pa.array(small, pa.binary()), pa.array(sizes, pa.int64())], names=[*rest, "_z", "_zn"]
            )

    fields = [T.StructField(c, df.schema[c].dataType) for c in rest]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("_z", T.BinaryType()), T.StructField("_zn", T.LongType())]))


def unpack(batch: pa.RecordBatch, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about max_bytes each, as large strings that may hold nulls."""
    codec = _codec()
    z, sizes = batch.column("_z"), batch.column("_zn").to_pylist()
    row, total, some = 0, 0, []
    for i, n in enumerate(sizes):
        if some and total + n > max_bytes:
            yield row, pa.array(some, pa.large_string())
            row, total, some = i, 0, []
        raw = z[i].as_py()
        some.append(raw if raw is None else codec.decompress(raw, n, asbytes=True).decode("utf-8", "surrogatepass") if n else "")
        total += n
    if some:
        yield row, pa.array(some, pa.large_string())

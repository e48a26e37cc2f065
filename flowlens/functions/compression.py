"""Decompression as a Column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from flowlens.codecs.compression import decompress

#: About so many bytes are handed on at once, so a task holds one batch of payloads and that much of what comes out of them.
PIECE = 4 << 20


@F.arrow_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("detail", T.StringType())]))
def decompressed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(status, data, detail) of a payload with this content encoding."""

    def piece(rows: list[tuple]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.string()))], ["status", "data", "detail"])

    for data, encoding in batches:
        rows, held = [], 0
        for d, e in zip(data, encoding, strict=True):
            rows.append(decompress(d.as_py(), e.as_py()))
            held += len(rows[-1][1] or b"")
            if held >= PIECE:
                yield piece(rows)
                rows, held = [], 0
        if rows or not len(data):
            yield piece(rows)

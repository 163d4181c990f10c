"""Token tables: documents as id strings with a running start, for packing and for coding."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.tokens import encoder


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SLICE = 1000


def tokenized(
    docs: DataFrame,
    path: str,
    spaces: bool,
    keys: Callable[[list[np.ndarray]], np.ndarray] | None = None,
) -> DataFrame:
    """doc_id, tie (CRC of the text), n_tokens and the ids as little-endian 16-bit integers.

    Null text is empty. Every text ends with the end id. ``keys`` may add a number per document,
    from the ids, as ``key``; it runs in the same worker. Vocabularies of more than 65,536 ids are
    not supported.
    """
    schema = "doc_id long, tie long, n_tokens long, ids binary" + ", key long" * (keys is not None)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaces)
        if enc.dtype.itemsize != 2:
            raise ValueError("ids must fit 16 bits")
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                texts = batch.column("text").to_pylist()
                ids = [enc.encode(text) for text in texts]
                columns = [
                    batch.column("doc_id"),
                    pa.array([zlib.crc32((t or "").encode()) for t in texts], pa.int64()),
                    pa.array([len(i) // 2 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ]
                if keys is not None:
                    found = keys([np.frombuffer(i, "<u2") for i in ids])
                    columns.append(pa.array(found, pa.int64()))
                names = [part.split()[0] for part in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def write_tokens(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_starts(df: DataFrame, bucket: str = "bucket") -> tuple[dict[int, int], int]:
    """Tokens before each bucket, and all tokens. One number per bucket comes to the driver."""
    totals = df.groupBy(bucket).agg(F.sum("n_tokens").alias("n")).orderBy(bucket).collect()
    starts, at = {}, 0
    for row in totals:
        starts[row[bucket]] = at
        at += row["n"]
    return starts, at


def wide_ids(ids: bytes) -> bytes:
    """16-bit ids as 32-bit ids."""
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()

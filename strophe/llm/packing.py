"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import cut_points, load, part_of
from strophe.llm.token_tables import bucket_starts, tokenized, tokenizer_path, wide_ids, write_tokens
from strophe.session import scratch_path

LENGTH = 2048
#: Hashed vector width, dimensions and bits of the curve. Key and tie-break fit a double exactly,
#: so that quantiles of the sort value are exact cut points.
WIDTH, DIMENSIONS, BITS, TIE_BITS = 256, 3, 8, 29
SPREAD = 6.0


def projection(seed: int = 7) -> np.ndarray:
    """Fixed random directions; constant vectors, which all documents share, are projected out."""
    rows = np.random.default_rng(seed).standard_normal((WIDTH, DIMENSIONS))
    rows -= rows.mean(axis=0)
    return rows / np.linalg.norm(rows, axis=0)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows of coordinates below 2**bits).

    From the highest bit down, a set bit reflects the lower bits of the first coordinate and a
    clear one exchanges them with the own coordinate's; the Gray code of the result is undone and
    its bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            flip = (x[i] >> b) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        carry ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents: hashed id counts, damped and scaled to length one, projected."""
    slots = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56))
    owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    cell = owner * WIDTH + slots[np.concatenate(ids)].astype(np.int64)
    vectors = np.sqrt(np.bincount(cell, minlength=len(ids) * WIDTH).reshape(len(ids), WIDTH))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    place = 0.5 + 0.5 * np.tanh(SPREAD * (vectors @ directions))
    return hilbert_key(np.minimum(place * (1 << BITS), (1 << BITS) - 1))


def _pieces(starts: np.ndarray, sizes: np.ndarray, total: int, length: int):
    """Cut documents at sequence borders: document index, start, length, sequence, offset.

    Sequences are full; the tokens that are left over at the very end form sequences of falling
    powers of two, which need no padding either.
    """
    full = total // length
    rest = total - full * length
    tail = [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1]
    tail_starts = full * length + np.cumsum([0, *tail])

    def sequence(at):
        inside = np.searchsorted(tail_starts, at, side="right") - 1
        return np.where(at < full * length, at // length, full + np.maximum(inside, 0))

    def begin(seq):
        last = tail_starts[np.clip(seq - full, 0, len(tail_starts) - 1)]
        return np.where(seq < full, seq * length, last)

    first, last = sequence(starts), sequence(starts + sizes - 1)
    count = last - first + 1
    doc = np.repeat(np.arange(len(starts)), count)
    seq = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    lo = np.maximum(begin(seq), starts[doc])
    hi = np.minimum(begin(seq + 1), (starts + sizes)[doc])
    return doc, lo - starts[doc], hi - lo, seq, lo - begin(seq)


PIECE = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "ids binary"
)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, spaces: bool = True) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of at most ``length`` tokens.

    Every document is its ids and the end id. Documents follow one another along a Hilbert curve
    through their projected, hashed id vectors, so a sequence holds like documents; within a cell
    they follow in hash order. The stream is cut every ``length`` ids. Only the rest at the very
    end is shorter and is split into powers of two, so nothing is padded. ``length`` must be a
    power of two. A piece carries its ids (little-endian, unsigned, 32 bits).

    Null text is empty, which is one end id; null and repeated doc_ids are rows like others; other
    columns are ignored; an empty table has no piece. A cell of many copies is cut by the
    tie-break, so no task gets more than its share. The driver sees cut points and bucket totals.
    """
    spark = docs.sparkSession
    directions = projection()
    coded = tokenized(docs, tokenizer, spaces, lambda ids: curve_keys(ids, directions))
    tokens = write_tokens(coded, scratch_path(spark, "tokens"))
    tie = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(1 << TIE_BITS))
    placed = tokens.withColumn("at", F.shiftleft("key", TIE_BITS) + tie)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut_points(placed.select(F.col("at").cast("double").alias("at")), "at", parts)
    placed = placed.withColumn("bucket", part_of(F.col("at"), [int(c) for c in cuts]))
    starts, total = bucket_starts(placed.select("bucket", "n_tokens"))

    def cut(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = table.select(["at", "doc_id", "tie"]).to_pandas()
        order = order.sort_values(["at", "doc_id", "tie"], na_position="first").index.to_numpy()
        sizes = table.column("n_tokens").to_numpy()[order]
        begin = starts[table.column("bucket")[0].as_py()] + np.cumsum(sizes) - sizes
        doc, start, own, seq, offset = _pieces(begin, sizes, total, length)
        ids = table.column("ids")
        rows = order[doc]
        bits = [
            wide_ids(ids[int(r)].as_buffer()[2 * s : 2 * (s + n)])
            for r, s, n in zip(rows.tolist(), start.tolist(), own.tolist(), strict=True)
        ]
        return pa.table(
            [
                table.column("doc_id").take(pa.array(rows)),
                pa.array(start, pa.int64()),
                pa.array(own, pa.int64()),
                pa.array(sizes[doc], pa.int64()),
                pa.array(seq, pa.int64()),
                pa.array(offset, pa.int64()),
                pa.array(bits, pa.binary()),
            ],
            names=[c.split()[0] for c in PIECE.split(", ")],
        )

    return placed.drop("key").groupBy("bucket").applyInArrow(cut, PIECE)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, tokenizer_path("byte_bpe_50k.json")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )

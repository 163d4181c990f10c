"""Token ids as canonical, length-limited Huffman codes with global counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import cut_points, load, part_of
from strophe.llm.token_tables import tokenized, tokenizer_path, write_tokens
from strophe.session import scratch_path

LIMIT = 16
#: A bit offset is stored for every so many ids of a block.
STEP = 256
#: Ids that are decoded together at most, unless one document has more.
BATCH = 1 << 21

FILE = "doc_id long, start long, n_tokens long, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, 0 for ids that don't occur.

    Package-merge: in each round the items are the leaves and the pairs of the round before, by
    weight. The leaves that the last round's cheapest 2n - 2 items contain are counted backwards;
    an id's length is the number of rounds that hold it.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    items, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by_weight = np.argsort(both, kind="stable")
        items = both[by_weight]
        is_leaf.append(by_weight < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each as an integer of its length's bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.int64)
    # in units of the longest code, the codes follow one another without a gap
    at = np.concatenate([[0], np.cumsum(1 << (LIMIT - own))[:-1]]) if len(own) else own
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (at >> (LIMIT - own)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every LIMIT bits that can lie ahead: the id and the length of its code."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << LIMIT, np.uint16), np.ones(1 << LIMIT, np.uint8)
    ids[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return ids, sizes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Checkpoints (bit offsets, 64-bit) and payload (32-bit words, first bit highest)."""
    own = lengths[ids].astype(np.int64)
    ends = np.cumsum(own)
    at = ends - own
    word, inside = at >> 5, (at & 31).astype(np.uint64)
    value = codes[ids] << (np.uint64(64) - own.astype(np.uint64) - inside)
    n = int(ends[-1] + 31 >> 5) + 1
    # bits don't overlap, so sums of halves are exact in doubles
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    words = (high + low).astype(np.uint64).astype("<u4")
    return at[::STEP].astype("<u8").tobytes(), words[: n - 1].tobytes()


def decode_blocks(blocks, ids_of: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Decode blocks (n, checkpoints, payload) together, one lane per checkpoint."""
    counts = [n for n, _, _ in blocks]
    payload = np.frombuffer(b"".join(p for _, _, p in blocks) + bytes(8), "<u4").astype(np.uint64)
    bases = np.cumsum([0] + [len(p) * 8 for _, _, p in blocks[:-1]])
    marks = [np.frombuffer(c, "<u8").astype(np.int64) for _, c, _ in blocks]
    at = np.concatenate([m + b for m, b in zip(marks, bases, strict=True)])
    left = np.concatenate(
        [np.minimum(STEP, n - STEP * np.arange(len(m))) for n, m in zip(counts, marks, strict=True)]
    )
    out = np.zeros((len(at), STEP), np.uint16)
    # lanes with most ids first, so that those still running are a prefix
    order = np.argsort(-left, kind="stable")
    at, running = at[order], np.searchsorted(-left[order], -np.arange(STEP), side="left")
    for i in range(STEP):
        m = running[i]
        if not m:
            break
        pos = at[:m]
        word = pos >> 5
        both = (payload[word] << np.uint64(32)) | payload[word + 1]
        ahead = (both >> (np.uint64(64 - LIMIT) - (pos & 31).astype(np.uint64))) & np.uint64(
            (1 << LIMIT) - 1
        )
        out[order[:m], i] = ids_of[ahead]
        at[:m] += sizes[ahead]
    decoded, lane = [], 0
    for n, mark in zip(counts, marks, strict=True):
        decoded.append(out[lane : lane + len(mark)].reshape(-1)[:n])
        lane += len(mark)
    return decoded


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs over all rows; at most one row per id and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = (
        tokens.select("ids")
        .mapInArrow(count, "id long, n long")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.zeros(1 << 16, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def write_coded(docs: DataFrame, tokenizer: str, out: str, spaces: bool = False) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``out``: codes, then blocks by doc_id.

    ``out/lengths`` holds the code length of every id; ``out/blocks`` one row per document, in
    ascending doc_id over the numbered folders and inside them: start (ids before it), n_tokens, the bit
    offset of every 256th id, and the code bits. A block is decoded without any other.

    A null doc_id comes first, equal ones follow by text; null text is empty, which is one end id.
    An empty table gives no block. Texts are coded before they are sorted, so the shuffle moves
    codes. The driver holds one count per id of the vocabulary.
    """
    spark = docs.sparkSession
    tokens = write_tokens(tokenized(docs, tokenizer, spaces), scratch_path(spark, "ids"))
    lengths = code_lengths(count_ids(tokens))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(
        1
    ).write.parquet(f"{out}/lengths")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                encode_block(np.frombuffer(ids.as_buffer(), "<u2"), codes, lengths)
                for ids in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "tie", "n_tokens")),
                    pa.array([d[0] for d in done], pa.binary()),
                    pa.array([d[1] for d in done], pa.binary()),
                ],
                names=["doc_id", "tie", "n_tokens", "checkpoints", "payload"],
            )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = tokens.select("doc_id", "tie", "n_tokens")
    cuts = cut_points(narrow, "doc_id", parts)
    bucket = part_of(F.col("doc_id"), cuts)
    # bucket totals carry the running start across buckets
    totals = narrow.groupBy(bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = (
        Window.partitionBy("bucket")
        .orderBy("doc_id", "tie", "n_tokens")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    coded = tokens.mapInArrow(
        encode, "doc_id long, tie long, n_tokens long, checkpoints binary, payload binary"
    ).withColumn("bucket", bucket)
    (
        coded.withColumn("end", F.sum("n_tokens").over(inside))
        .join(F.broadcast(base), "bucket")
        .select(
            "doc_id",
            (F.col("base") + F.col("end") - F.col("n_tokens")).alias("start"),
            "n_tokens",
            "checkpoints",
            "payload",
            "bucket",
        )
        .write.option("compression", "uncompressed")
        .partitionBy("bucket")
        .parquet(f"{out}/blocks")
    )


def read_coded(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian, unsigned, 32 bits) of every document."""
    row = spark.read.schema("lengths binary").parquet(f"{out}/lengths").first()
    ids_of, sizes = decode_table(np.frombuffer(bytes(row["lengths"]), np.uint8))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(n[lo:]), BATCH, "right")))
                part = batch.slice(lo, hi - lo)
                blocks = list(
                    zip(
                        part.column("n_tokens").to_pylist(),
                        part.column("checkpoints").to_pylist(),
                        part.column("payload").to_pylist(),
                        strict=True,
                    )
                )
                ids = decode_blocks(blocks, ids_of, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "start", "n_tokens")),
                        pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                lo = hi

    return (
        spark.read.schema(FILE)
        .parquet(f"{out}/blocks")
        .select("doc_id", "start", "n_tokens", "checkpoints", "payload")
        .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
    )


def op4_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "coded")
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    write_coded(docs, tokenizer_path("word_bpe_49k.json"), out)
    return read_coded(spark, out).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )

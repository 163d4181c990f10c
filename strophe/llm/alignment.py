"""Alignment of two tokenizers by merging their token ends, and how often ids meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import load
from strophe.llm.token_tables import tokenizer_path
from strophe.llm.tokens import _OTHERS, _PRINTABLE, PieceEncoder, _Cache
from strophe.session import cut_lineage, spread

#: Ends per piece of the merge.
WORK = 1 << 16
#: Tokens that are aligned together: as many documents as have about so many.
TOGETHER = 1 << 20
#: B ids are dealt out over so many buckets; a bucket's pair counts are in one task's memory.
BUCKETS = 16

_SPACE = "▁"
_LINKS = "bucket int, pairs binary, sums binary, runs binary, docs binary, counts binary"
_DIGESTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _a_bytes(encoder: PieceEncoder) -> list[bytes]:
    """The bytes of every id: byte-level entries decoded by the published rule."""
    stands = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(_OTHERS)}
    out = [b""] * encoder.tokenizer.get_vocab_size()
    for token, number in encoder.tokenizer.get_vocab().items():
        if all(c in stands for c in token):
            out[number] = bytes(map(stands.__getitem__, token))
    return out


class SentenceEncoder:
    """Ids of texts by a sentencepiece BPE file in which only runs of spaces hold inner spaces.

    A text is cut before spaces and line ends, where no merge can reach across; every distinct
    piece is encoded once per worker. Texts with runs of spaces go to the library whole.
    """

    def __init__(self, path: str, limit: int = 300_000):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(_SPACE, " ").encode()
            for i, n in enumerate(names)
        ]
        lone = any(_SPACE in n.lstrip(_SPACE) or "\n" in n for n in names)
        self.cuts = not lone and _SPACE in names
        self.space = self.model.piece_to_id(_SPACE)
        self.cache = _Cache(self._piece, limit)

    def _library(self, text: str) -> bytes:
        return np.array(self.model.encode(text), "<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece:  # a text that begins with a line end
            return np.array([self.space], "<u2").tobytes()
        return self._library(piece)[2:] if piece[0] == "\n" else self._library(piece)

    def encode(self, text: str) -> bytes:
        if (
            not self.cuts
            or text[0] == " "
            or text[-1] == " "
            or "  " in text
            or " \n" in text
            or _SPACE in text
        ):
            return self._library(text)
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " \n").split(" ")))


class Sides:
    """Both tokenizers, the bytes of their ids and the written forms of ids in groups."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PieceEncoder(path_a, True, limit=400_000), SentenceEncoder(path_b)
        self.a.tokenizer.encode_special_tokens = True
        self.bytes_a, self.bytes_b = _a_bytes(self.a), self.b.bytes
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.long_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.long_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.written = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
        self.shift = len(self.written)
        self.written += [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text by A and B; none where either's bytes differ from space and text."""
        none = np.zeros(0, np.uint16)
        if not text:
            return none, none
        whole = (" " + text).encode()
        a = np.frombuffer(self.a.encode(" " + text), self.a.dtype)[:-1]
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole:
            return none, none
        b = np.frombuffer(self.b.encode(text), "<u2")
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
            return none, none
        return a, b


_SIDES: dict[tuple[str, str], Sides] = {}


def _sides(path_a: str, path_b: str) -> Sides:
    """One pair of tokenizers per worker process."""
    key = (path_a, path_b)
    if key not in _SIDES:
        _SIDES[key] = Sides(path_a, path_b)
    return _SIDES[key]


def split_at(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int]:
    """How many of the first ``diagonal`` merged ends come from each side.

    A binary search along the diagonal; of equal ends A's comes first, and B's goes with it.
    """
    low, high = max(0, diagonal - len(b)), min(diagonal, len(a))
    while low < high:
        i = (low + high) // 2
        if a[i] <= b[diagonal - i - 1]:
            low = i + 1
        else:
            high = i
    i, j = low, diagonal - low
    if i and j < len(b) and a[i - 1] == b[j]:
        j += 1
    return i, j


def merge_pieces(a: np.ndarray, b: np.ndarray, work: int = WORK):
    """Overlapping tokens and common ends, piece by piece of equal work.

    ``a`` and ``b`` are strictly ascending ends over the same bytes. Yields (links of A, links of
    B, common ends of A, common ends of B) as token positions; no piece needs another one's result.
    """
    total = len(a) + len(b)
    cuts = [split_at(a, b, d) for d in range(0, total, work)] + [(len(a), len(b))]
    for (i, j), (to_i, to_j) in zip(cuts, cuts[1:], strict=False):
        keys = np.concatenate([a[i:to_i] * 2, b[j:to_j] * 2 + 1])
        keys.sort(kind="stable")  # two runs: a merge
        of_b = keys & 1
        before_b = np.cumsum(of_b) - of_b
        before_a = np.arange(len(keys)) - before_b
        ends = keys >> 1
        again = np.zeros(len(keys), bool)
        again[1:] = ends[1:] == ends[:-1]
        first = ~again
        common = np.flatnonzero(again) - 1
        yield (i + before_a[first], j + before_b[first], i + before_a[common], j + before_b[common])


def _written_groups(sides: Sides, a, b, last_a, last_b, n_a, n_b) -> list[str]:
    """SHA-256 of every document's groups; a group that pieces cut is whole again in the flags."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    end_a, end_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.concatenate([[0], end_b])[group_a]] = 2 * a + last_a
    codes[np.arange(len(b)) + end_a[group_b]] = sides.shift + 2 * b + last_b
    stops = np.cumsum(n_a + n_b).tolist()
    out, start, written = [], 0, sides.written.__getitem__
    for stop in stops:
        groups = "".join(map(written, codes[start:stop].tolist()))
        out.append(hashlib.sha256(groups[:-1].encode()).hexdigest() if groups else "")
        start = stop
    return out


def _small(values: np.ndarray) -> bytes:
    """Unsigned integers in 1, 2, 4 or 8 bytes each, whichever the largest needs."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return values.astype(f"<u{width}").tobytes()


def _wide(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // max(1, count)}" if count else "<u1").astype(np.int64)


def _link_rows(keys: np.ndarray) -> list[tuple]:
    """Per bucket: distinct pairs with their links, and per pair its documents with theirs.

    A key holds bucket, B id, A id and document, so one sort groups all.
    """
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts, keys = np.diff(np.append(at, len(keys))), keys[at]
    pairs = keys >> 16
    begin = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    sums, runs = np.add.reduceat(counts, begin), np.diff(np.append(begin, len(pairs)))
    buckets = pairs[begin] >> 32
    edges = np.searchsorted(buckets, np.arange(BUCKETS + 1))
    rows = []
    for bucket, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        if low == high:
            continue
        lo, hi = begin[low], begin[high] if high < len(begin) else len(keys)
        rows.append(
            (
                bucket,
                (pairs[begin[low:high]] & 0xFFFFFFFF).astype("<u4").tobytes(),
                _small(sums[low:high]),
                _small(runs[low:high]),
                (keys[lo:hi] & 0xFFFF).astype("<u2").tobytes(),
                _small(counts[lo:hi]),
            )
        )
    return rows


def _align(sides: Sides, tokens: list[tuple[np.ndarray, np.ndarray]], work: int):
    """Digests of some documents and the rows of their links."""
    n_a = np.array([len(x) for x, _ in tokens], np.int64)
    n_b = np.array([len(y) for _, y in tokens], np.int64)
    a = np.concatenate([x for x, _ in tokens]).astype(np.int64)
    b = np.concatenate([y for _, y in tokens]).astype(np.int64)
    size = len(tokens)
    if not len(a):
        zero = [0] * size
        return list(zip(zero, zero, zero, zero, [""] * size, strict=True)), []
    # the bytes of both sides agree, so the documents' ends do when all are laid end to end
    ends_a, ends_b = np.cumsum(sides.long_a[a]), np.cumsum(sides.long_b[b])
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    document = np.repeat(np.arange(size), n_a)
    n_links = np.zeros(size, np.int64)
    keys = []
    for link_a, link_b, common_a, common_b in merge_pieces(ends_a, ends_b, work):
        last_a[common_a] = last_b[common_b] = True
        doc, id_b = document[link_a], b[link_b]
        n_links += np.bincount(doc, minlength=size)
        keys.append((((id_b % BUCKETS) << 32 | id_b << 16 | a[link_a]) << 16) | doc)
    n_groups = np.bincount(document[last_a], minlength=size)
    hashes = _written_groups(sides, a, b, last_a, last_b, n_a, n_b)
    digests = zip(
        n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), hashes, strict=True
    )
    return list(digests), _link_rows(np.concatenate(keys))


def _aligned(docs: DataFrame, path_a: str, path_b: str, together: int, work: int) -> DataFrame:
    """Digests of documents and packed links, told apart by ``bucket``: null or a number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    form = f"batch long, doc int, doc_id {kind}, {_DIGESTS}, {_LINKS}"
    names = [c.split()[0] for c in form.split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(path_a, path_b)
        part, number = TaskContext.get().partitionId(), 0
        ids, tokens, held, type_ = [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            digests, links = _align(sides, tokens, work)
            here = (part << 32) + number
            rows = [(here, i, d, *x, *[None] * 6) for i, (d, x) in enumerate(zip(ids, digests, strict=True))]
            rows += [(here, None, None, *[None] * 5, *x) for x in links]
            kinds = [pa.int64(), pa.int32(), type_, *[pa.int64()] * 4, pa.string(), pa.int32(),
                     *[pa.binary()] * 5]
            columns = zip(*rows, strict=True)
            number, held = number + 1, 0
            ids.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        for batch in batches:
            type_ = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc)
                tokens.append(sides.ids(text.as_py()))
                held += len(tokens[-1][0]) + len(tokens[-1][1])
                if held >= together or len(ids) == 1 << 16:
                    yield flush()
        if ids:
            yield flush()

    return cut_lineage(spread(docs.select("doc_id", "text")).mapInArrow(align, form), "aligned")


def _merged(pairs: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(where, np.concatenate(sums), len(keys)).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): links of every id pair (B id * 65536 + A id) in the corpus, folded per task."""
    limit = 1 << 21

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[0]), pa.array(sums[0])], names=["pair", "n"]
            )

        for batch in batches:
            for keys, n in zip(batch.column("pairs"), batch.column("sums"), strict=True):
                pairs.append(np.frombuffer(keys.as_py(), "<u4").astype(np.int64))
                sums.append(_wide(n.as_py(), len(pairs[-1])))
                held += len(pairs[-1])
                if held >= limit:
                    merged = _merged(pairs, sums)
                    pairs, sums, held = [merged[0]], [merged[1]], len(merged[0])
                    if held >= limit // 2:  # many different ones: let Spark go on
                        yield out()
                        pairs, sums, held = [], [], 0
        if pairs:
            merged = _merged(pairs, sums)
            pairs, sums = [merged[0]], [merged[1]]
            yield out()

    folded = aligned.where("bucket is not null").select("pairs", "sums")
    return folded.mapInArrow(fold, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _packed(counts: DataFrame) -> DataFrame:
    """Pair counts as one row per bucket and batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = (batch.column(c).to_numpy() for c in ("pair", "n"))
            bucket = (pair >> 16) % BUCKETS
            own = [np.flatnonzero(bucket == k) for k in range(BUCKETS)]
            rows = [
                (k, pair[x].astype("<u4").tobytes(), n[x].astype("<i8").tobytes())
                for k, x in enumerate(own)
                if len(x)
            ]
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["bucket", "pairs", "sums"],
                )

    return counts.mapInArrow(pack, "bucket int, pairs binary, sums binary")


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(batch, doc, n_best, count_sum) per bucket: links against the counts of their pairs.

    Links stay packed. A bucket's links are dealt over several tasks by batch, and its counts,
    bounded by the two vocabularies, are sent to each of them; a task reads counts first, then
    links as a stream.
    """
    spark = aligned.sparkSession
    copies = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    columns = ["batch", "bucket", "pairs", "sums", "runs", "docs", "counts"]
    links = aligned.where("bucket is not null").select(
        *columns, F.pmod(F.xxhash64("batch"), F.lit(copies)).cast("int").alias("copy"),
        F.lit(1).alias("kind"),
    )
    tables = _packed(counts).select(
        F.lit(None).cast("long").alias("batch"), "bucket", "pairs", "sums",
        *[F.lit(None).cast("binary").alias(c) for c in ("runs", "docs", "counts")],
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"),
    )
    dealt = (
        tables.unionByName(links)
        .repartition(BUCKETS * copies, "bucket", "copy")
        .sortWithinPartitions("bucket", "copy", "kind")
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums = [], []
        keys = n = best = None
        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                own = np.frombuffer(row["pairs"], "<u4").astype(np.int64)
                if row["kind"] == 0:
                    if keys is not None:  # the next bucket
                        keys, pairs, sums = None, [], []
                    pairs.append(own)
                    sums.append(np.frombuffer(row["sums"], "<i8"))
                    continue
                if keys is None:
                    keys = np.concatenate(pairs)
                    order = np.argsort(keys)
                    keys, n = keys[order], np.concatenate(sums)[order]
                    begin = np.flatnonzero(np.concatenate([[True], np.diff(keys >> 16) != 0]))
                    most = np.maximum.reduceat(n, begin)
                    best = n == np.repeat(most, np.diff(np.append(begin, len(keys))))
                    pairs, sums = [], []
                runs = _wide(row["runs"], len(own))
                place = np.repeat(np.searchsorted(keys, own), runs)
                docs = np.frombuffer(row["docs"], "<u2")
                times = _wide(row["counts"], len(docs))
                order = np.argsort(docs, kind="stable")
                docs, place, times = docs[order], place[order], times[order]
                begin = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(begin), row["batch"], np.int64)),
                        pa.array(docs[begin].astype(np.int32)),
                        pa.array(np.add.reduceat(times * best[place], begin)),
                        pa.array(np.add.reduceat(times * n[place], begin)),
                    ],
                    names=["batch", "doc", "n_best", "count_sum"],
                )

    return dealt.mapInArrow(look_up, "batch long, doc int, n_best long, count_sum long")


def align(
    docs: DataFrame, path_a: str, path_b: str, together: int = TOGETHER, work: int = WORK
) -> tuple[DataFrame, DataFrame]:
    """Documents aligned between two tokenizers, and the corpus-wide counts of linked id pairs.

    ``docs`` has doc_id and text; other columns are ignored. A is a byte-level BPE file of the
    tokenizers library and reads a space and the text; B is a sentencepiece file. Returns one row
    per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; and (id_a, id_b,
    n). Null and empty texts, and texts of which either side's bytes differ, have no tokens: zeros
    and an empty digest. Repeated rows and null ids are answered, and counted, each on its own; an
    empty table gives none.

    The ends of both sides are merged in pieces of equal work, found by binary searches along
    diagonals: every elementary interval between two ends is one link, every end of both sides ends
    a group, also one that began in an earlier piece. Links are kept packed, per bucket of B ids and
    batch of documents, so that neither the counts nor a join back move a row per link.
    """
    aligned = _aligned(docs, path_a, path_b, together, work)
    counts = cut_lineage(pair_counts(aligned), "pair_counts")
    sums = (
        _looked_up(aligned, counts)
        .groupBy(F.col("batch").alias("__batch"), F.col("doc").alias("__doc"))
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    digests = aligned.where("bucket is null")
    same = (F.col("batch") == F.col("__batch")) & (F.col("doc") == F.col("__doc"))
    found = digests.join(sums, same, "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")],
    )
    return found, counts.select(
        F.col("pair").bitwiseAND(0xFFFF).alias("id_a"), F.shiftright("pair", 16).alias("id_b"), "n"
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))[0]

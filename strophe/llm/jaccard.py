"""Documents that share most of their shingles: a Jaccard join by PartEnum signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import load, row_hash
from strophe.llm.components import components
from strophe.llm.shingles import mix, shingle_sets
from strophe.session import cut_lineage

#: Documents whose set sizes lie within this ratio form one band, if the similarity allows no more.
BAND = 1.35
#: Texts whose words are hashed together; bounds a worker's memory.
SLICE = 2_000_000
#: Nodes of a block in the comparison of one candidate component.
BLOCK = 8192
#: Cells of a table of distances that is worked on at once.
PORTION = 1 << 17


def bands(largest: int, num: int, den: int) -> np.ndarray:
    """Lower ends of the size bands that cover 1 to ``largest``, and one band more.

    A band is at least den / num wide, so partners lie in the same band or the next.
    """
    ends = [1]
    while len(ends) < 2 or ends[-2] <= largest:
        last = ends[-1]
        ends.append(max(last + 1, math.floor(last * BAND) + 1, last * den // num + 1))
    return np.array(ends)


def _signatures(
    sets: np.ndarray, counts: np.ndarray, num: int, den: int
) -> tuple[np.ndarray, np.ndarray]:
    """One-part signatures after PartEnum, for sets (ascending hashes): values, how many each has.

    PartEnum takes subsets of parts; here a single part is a signature, which chains more candidates.

    Sets of sizes s and p with Jaccard similarity of num/den at least differ in no more than
    (s + p) * (den - num) / (den + num) elements. Within a band the hash domain is cut into parts,
    a fifth of the band's upper end in number. Each set emits its first h + 1 parts that are not
    empty, h being the most differences to any partner; h differences cannot touch all of them,
    and the one that has none is emitted by the partner too. A set with fewer such parts emits all
    and a common mark for sets of this kind: of a pair, one that isn't of this kind suffices.
    Sets that may have partners in the next band take part there too.
    """
    if not len(sets):
        return sets, counts
    ends = bands(int(counts.max()), num, den)
    own = np.searchsorted(ends, counts, side="right") - 1
    values, holders = [], []
    with_elements = np.flatnonzero(counts)
    starts = np.cumsum(counts) - counts
    for shift in (0, 1):
        band = own[with_elements] + shift
        low, high = ends[band], ends[band + 1] - 1
        size = counts[with_elements]
        take = size * den >= num * low
        who, band, high, size = with_elements[take], band[take], high[take], size[take]
        if not len(who):
            continue
        partner = np.minimum(size * den // num, high)
        wanted = (size + partner) * (den - num) // (den + num) + 1
        parts = np.ceil(high * (den - num) / (den + num) * 2 * 1.17).astype(np.int64) + 2
        # elements of the chosen sets, with their part; ascending hashes give ascending parts
        index = np.repeat(starts[who] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        element = sets[index]
        owner = np.repeat(np.arange(len(who)), size)
        part = ((element >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
        first = np.flatnonzero(new)
        total = np.add.reduceat(mix(element ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
        holder, part = owner[first], part[first]
        filled = np.bincount(holder, minlength=len(who))
        nth = np.arange(len(first)) - np.repeat(np.cumsum(filled) - filled, filled)
        keep = nth < wanted[holder]
        label = (band[holder].astype(np.uint64) << np.uint64(40)) + part + np.uint64(1)
        values.append(mix(total + mix(label))[keep])
        holders.append(who[holder[keep]])
        few = np.flatnonzero(filled < wanted)
        values.append(mix(mix(band[few].astype(np.uint64) << np.uint64(40))))
        holders.append(who[few])
    value, holder = np.concatenate(values), np.concatenate(holders)
    order = np.argsort(holder, kind="stable")
    return value[order], np.bincount(holder, minlength=len(counts))


def _parity_bits(size: int) -> int:
    return 1 << max(8, (4 * size - 1).bit_length())


def parity(one_set: np.ndarray) -> bytes:
    """A bit per hash cell, set if an odd number of elements falls there.

    The sketches of two sets differ in no more bits than the sets in elements.
    """
    bits = _parity_bits(len(one_set))
    cell = np.bincount((one_set & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cell.astype(np.uint8), bitorder="little").tobytes()


def _nodes(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit name per set, from all of its elements; 0 for the empty set."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        out[some] = mix(np.add.reduceat(mix(sets), at) + counts[some].astype(np.uint64))
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """Runs of rows of about SLICE bytes of text."""
    start, held, run = 0, 0, []
    for i, text in enumerate(texts):
        value = text.as_py()
        run.append(value)
        held += len(value or "")
        if held >= SLICE:
            yield start, run
            start, held, run = i + 1, 0, []
    if run:
        yield start, run


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


SKETCH = "doc_id long, tie long, node long, n_shingles long, parity binary"


def _first(node: np.ndarray) -> np.ndarray:
    """True at the first row of every name."""
    out = np.zeros(len(node), bool)
    out[np.unique(node, return_index=True)[1]] = True
    return out


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """Name, size and parity sketch of the shingle set of every row; repeats in a slice have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch.column("text")):
                sets, counts = shingle_sets(texts, width)
                node = _nodes(sets, counts)
                begin = np.cumsum(counts) - counts
                wanted = _first(node) & (counts > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(texts)),
                        batch.column("tie").slice(start, len(texts)),
                        pa.array(node.view(np.int64), mask=counts == 0),
                        pa.array(counts, pa.int64()),
                        pa.array(
                            [
                                parity(sets[b : b + n]) if w else None
                                for b, n, w in zip(begin, counts, wanted, strict=True)
                            ],
                            pa.binary(),
                        ),
                    ],
                    names=["doc_id", "tie", "node", "n_shingles", "parity"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(work, SKETCH)


def signatures(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(signature, node) of every row of ``docs``; repeats in a slice emit none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch.column("text")):
                sets, counts = shingle_sets(texts, width)
                node = _nodes(sets, counts)
                alone = _first(node) & (counts > 0)
                values, n = _signatures(sets[np.repeat(alone, counts)], counts[alone], num, den)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(values.view(np.int64), pa.int64()),
                        pa.array(np.repeat(node[alone], n).view(np.int64), pa.int64()),
                    ],
                    names=["signature", "node"],
                )

    return docs.select("text").mapInArrow(work, "signature long, node long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, elements) of rows (node, text) whose text has that set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in _slices(batch.column("text")):
                sets, counts = shingle_sets(some, width)
                expected = batch.column("node").slice(start, len(some))
                right = (_nodes(sets, counts).view(np.int64) == expected.to_numpy()) & (counts > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        expected.filter(pa.array(right)),
                        pa.array(counts[right], pa.int64()),
                        _lists(sets[np.repeat(right, counts)], counts[right]),
                    ],
                    names=["node", "n", "elements"],
                )

    return texts.mapInArrow(work, "node long, n long, elements array<long>")


class Block(NamedTuple):
    """Nodes with their labels, set sizes and sketches."""

    node: np.ndarray
    label: np.ndarray
    n: np.ndarray
    bits: np.ndarray
    parity: list[bytes]

    @classmethod
    def of(cls, rows: pa.RecordBatch | pa.Table) -> Block:
        parity = rows.column("parity").to_pylist()
        node, label, n = (rows.column(c).to_numpy() for c in ("node", "label", "n"))
        return cls(node, label, n, np.array([8 * len(p) for p in parity], np.int64), parity)

    def sketches(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with sketches of this width, small sets first, and their sketches."""
        rows = np.flatnonzero(self.bits == bits)
        rows = rows[np.argsort(self.n[rows], kind="stable")]
        words = np.frombuffer(b"".join([self.parity[i] for i in rows]), "<u8")
        return rows, words.reshape(len(rows), bits // 64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of bits in which every row of ``x`` differs from every row of ``y``."""
    total = np.zeros((len(x), len(y)), np.int64)
    differ = np.empty(total.shape, np.uint64)
    ones = np.empty(total.shape, np.uint8)
    for word in range(x.shape[1]):
        np.bitwise_xor(x[:, word, None], y[None, :, word], out=differ)
        np.bitwise_count(differ, out=ones)
        total += ones
    return total


def _fold(x: np.ndarray) -> np.ndarray:
    """Sketches of half the width. They differ in no more bits than the whole ones."""
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:]


def _close(
    left: Block, right: Block, num: int, den: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs whose sketches do not rule out the similarity, with their relative distance.

    Rows are ordered by set size, so that only like sizes meet; sketches of a quarter of the width
    decide most pairs, the whole ones the rest. Pairs come in portions, so a block of copies never
    holds all of its pairs at once.
    """

    for bits in np.union1d(left.bits, right.bits).tolist():
        a_rows, a = left.sketches(bits)
        b_rows, b = right.sketches(bits)
        a_wide, b_wide = left.sketches(2 * bits), right.sketches(2 * bits)
        sides = [(a_rows, a, b_rows, b)]
        if len(b_wide[0]):
            sides.append((a_rows, a, b_wide[0], _fold(b_wide[1])))
        if len(a_wide[0]):
            sides.append((a_wide[0], _fold(a_wide[1]), b_rows, b))
        for i_rows, x, j_rows, y in sides:
            if not len(i_rows) or not len(j_rows):
                continue
            thin_x, thin_y = x, y
            if x.shape[1] > 4:
                thin_x, thin_y = _fold(_fold(x)), _fold(_fold(y))
            n_i, n_j = left.n[i_rows], right.n[j_rows]
            step = max(1, PORTION // len(j_rows))
            for lo in range(0, len(i_rows), step):
                hi = min(lo + step, len(i_rows))
                begin = int(np.searchsorted(n_j * den, n_i[lo] * num))
                end = int(np.searchsorted(n_j * num, n_i[hi - 1] * den, side="right"))
                for at in range(begin, end, PORTION):
                    to = min(at + PORTION, end)
                    both = n_i[lo:hi, None] + n_j[None, at:to]
                    differ = _distances(thin_x[lo:hi], thin_y[at:to])
                    i, j = np.nonzero(differ * (den + num) <= both * (den - num))
                    i, j = i + lo, j + at
                    some = max(1, (1 << 20) // x.shape[1])
                    for k in range(0, len(i), some):
                        p, q = i[k : k + some], j[k : k + some]
                        whole = np.bitwise_count(x[p] ^ y[q]).sum(axis=1, dtype=np.int64)
                        total = n_i[p] + n_j[q]
                        near = whole * (den + num) <= total * (den - num)
                        near &= np.minimum(n_i[p], n_j[q]) * den >= np.maximum(n_i[p], n_j[q]) * num
                        if near.any():
                            yield i_rows[p[near]], j_rows[q[near]], whole[near] / total[near]


def _forest(left: Block, right: Block, num: int, den: int) -> pa.RecordBatch:
    """Pairs that span every tree of close pairs of two blocks, near ones first."""
    name, at = np.unique(np.concatenate([left.node, right.node]), return_inverse=True)
    at_left, at_right = at[: len(left.node)], at[len(left.node) :]
    root = np.arange(len(name))
    kept = []
    for i, j, far in _close(left, right, num, den):
        x, y = at_left[i], at_right[j]
        apart = np.flatnonzero(root[x] != root[y])
        apart = apart[np.argsort(far[apart], kind="stable")]
        up: dict[int, int] = {}

        def top(r: int, up: dict[int, int] = up) -> int:
            while r in up:
                r = up[r]
            return r

        for k, r, s in zip(apart, root[x[apart]].tolist(), root[y[apart]].tolist(), strict=True):
            r, s = top(r), top(s)
            if r != s:
                up[max(r, s)] = min(r, s)
                kept.append((x[k], y[k]))
        if up:
            moved = np.arange(len(name))
            for r in up:
                moved[r] = top(r)
            root = moved[root]
    x, y = np.array(kept, np.int64).reshape(-1, 2).T
    return _named(
        name[x], name[y], name[x], name[y],
        name[root[x]], np.zeros(len(x), np.int64), np.bincount(root, minlength=1)[root[x]] > 2,
    )


def _closest(
    left: Block, right: Block, num: int, den: int, quota: int
) -> pa.RecordBatch:
    """The ``quota`` closest pairs of every two labels of two blocks.

    One pair more than that is held for every two labels; later pairs that are no closer than all
    of them change nothing and go at once.
    """
    labels, code = np.unique(np.concatenate([left.label, right.label]), return_inverse=True)
    code_left, code_right = code[: len(left.node)], code[len(left.node) :]
    held = np.zeros(0, [("key", "<i8"), ("far", "<f8"), ("a", "<i8"), ("b", "<i8")])
    full, worst = np.zeros(0, np.int64), np.zeros(0)
    waiting, rows = [], 0

    def least(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The closest pairs of every two labels, and their number among them from 0."""
        all_rows = np.concatenate(some)
        all_rows = all_rows[np.lexsort([all_rows[c] for c in ("b", "a", "far", "key")])]
        a, b = all_rows["a"], all_rows["b"]
        again = (a[1:] == a[:-1]) & (b[1:] == b[:-1])  # a block meets itself both ways round
        all_rows = np.delete(all_rows, np.flatnonzero(again) + 1)
        start = np.flatnonzero(np.diff(all_rows["key"], prepend=-1))
        nth = np.arange(len(all_rows)) - np.repeat(start, np.diff(start, append=len(all_rows)))
        keep = nth <= quota
        return all_rows[keep], nth[keep]

    for i, j, far in _close(left, right, num, den):
        g, h = code_left[i], code_right[j]
        key = np.minimum(g, h) * len(labels) + np.maximum(g, h)
        open_pair = g != h
        if len(full):
            at = np.minimum(np.searchsorted(full, key), len(full) - 1)
            open_pair &= (full[at] != key) | (far < worst[at])
        if not open_pair.any():
            continue
        a, b = left.node[i[open_pair]], right.node[j[open_pair]]
        new = np.empty(len(a), held.dtype)
        new["key"], new["far"] = key[open_pair], far[open_pair]
        new["a"], new["b"] = np.minimum(a, b), np.maximum(a, b)
        waiting.append(new)
        rows += len(new)
        if rows > PORTION:
            held, nth = least([held, *waiting])
            last = nth == quota
            full, worst = held["key"][last], held["far"][last]
            waiting, rows = [], 0
    held, nth = least([held, *waiting])
    counts = dict(zip(*np.unique(held["key"], return_counts=True), strict=True))
    found = held[nth < quota]
    more = np.array([counts[k] > quota for k in found["key"]], bool)
    g, h = labels[found["key"] // max(1, len(labels))], labels[found["key"] % max(1, len(labels))]
    return _named(found["a"], found["b"], g, h, g, h, more)


def _named(a, b, g, h, t, u, more) -> pa.RecordBatch:
    columns = [np.minimum(a, b), np.maximum(a, b), g, h, t, u]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(c, np.int64)) for c in columns] + [pa.array(np.asarray(more, bool))],
        names=[*"abghtu", "more"],
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal ``keys``; no more than a run and a batch are held."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.column_stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(values[lo].tolist())
            if held and key != before:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            before = key
    if held:
        yield pa.Table.from_batches(held)


PAIRS = "a long, b long, g long, h long, t long, u long, more boolean"


def candidate_pairs(sketches: DataFrame, num: int, den: int, quota: int) -> DataFrame:
    """Pairs (a, b) of one unit whose sketches allow the similarity.

    ``sketches`` are (root, blocks, node, label, n, parity), root naming the unit. A unit is dealt
    into blocks by hash and compared block by block; a sketch, not a set, is sent to each block
    pair. With ``quota`` 0 the
    pairs of a block pair span its trees of close pairs; otherwise they are the ``quota`` closest
    of every two labels g and h. (t, u) names the tree or the labels, ``more`` says that pairs
    were left out there.
    """
    dealt = sketches.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(
        "root", "node", "label", "n", "parity", "own",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["root", "i", "j"]):
            first = np.sort(np.unique(run.column("node").to_numpy(), return_index=True)[1])
            run = run.take(pa.array(first)) if len(first) < run.num_rows else run
            i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
            if i == j:
                left = right = Block.of(run)
            else:
                at_left = pc.equal(run.column("own"), i)
                left, right = Block.of(run.filter(at_left)), Block.of(run.filter(pc.invert(at_left)))
            found = _closest(left, right, num, den, quota) if quota else _forest(left, right, num, den)
            if found.num_rows:
                yield found

    # a run holds two blocks at most, so no task gets a whole unit
    return (
        spread.repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
        .mapInArrow(compare, PAIRS)
    )


def _text_key() -> Column:
    """A hash of id and text of a row, as narrow as a key can be: few texts are asked for by many keys."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("tie"))


def _sets_of(docs: DataFrame, known: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(node, n, elements) of each node that occurs in ``pairs``, written; one text of it is read.

    Only the texts asked for are shuffled: the others are left out by a hash of id and text first,
    so small a table that it can mostly be sent to all tasks.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = cut_lineage(
        known.select("node", "doc_id", "tie")
        .join(ends, "node")
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "tie")).alias("__first"))
        .select("node", F.col("__first.doc_id").alias("__id"), F.col("__first.tie").alias("__tie")),
        "first",
    )
    keys = cut_lineage(
        first.select(F.col("__id").alias("doc_id"), F.col("__tie").alias("tie"))
        .select(_text_key().alias("__key")),
        "keys",
    )
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    some = named.withColumn("__key", _text_key()).join(keys, "__key", "left_semi")
    # id and text hash together: rows without an id, or with the same one, don't meet each other
    texts = some.join(
        first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie"))
    )
    found = _sets(texts.select("node", "text"), width).dropDuplicates(["node"])
    return cut_lineage(found, "sets")


def _checked(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` with ``linked``: whether the sets themselves reach the similarity."""
    one = sets.select(
        F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("elements").alias("x")
    )
    two = sets.select(
        F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("elements").alias("y")
    )
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .withColumn("common", common)
        .withColumn(
            "linked",
            F.col("common") * den >= (F.col("n_a") + F.col("n_b") - F.col("common")) * num,
        )
        .select(*pairs.columns, "linked")
    )


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) when ``links`` (a, b) join further the components that ``roots`` holds.

    Only the roots that a link joins are contracted anew, so later rounds work on few edges.
    """
    if roots is None:
        return components(links)
    ends = links
    for side in ("a", "b"):
        known = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        ends = ends.join(known, side, "left")
    moved = cut_lineage(
        components(
            ends.select(
                F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
            )
        ),
        "moved",
    )
    onto = moved.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return (
        roots.join(onto, "root", "left")
        .select("node", F.coalesce("new", "root").alias("root"))
        .unionByName(moved.join(roots, "node", "left_anti"))
    )


def _roots(
    docs: DataFrame, known: DataFrame, sketches: DataFrame, width: int, num: int, den: int
) -> DataFrame:
    """(node, root) of all nodes with a link.

    At first only pairs that span the trees of close pairs are checked. If all pairs of a tree are
    links, the pairs left out join nothing new. The nodes of other trees go on: labelled by the
    links found so far, every two labels offer their closest pairs, sixteen times as many in each
    round, until no pair that could join two labels is left out.
    """
    todo, quota, roots, sets = sketches.withColumn("label", F.col("node")), 0, None, None
    while True:
        pairs = cut_lineage(candidate_pairs(todo, num, den, quota), "pairs")
        # every node with a close pair is in a pair of the first round: the trees span all of them
        if sets is None:
            sets = _sets_of(docs, known, pairs, width)
        # units that share nodes may offer a pair more than once
        asked = pairs.select("a", "b").distinct()
        linked = cut_lineage(_checked(sets, asked, num, den), "linked")
        checked = pairs.join(linked, ["a", "b"])
        roots = cut_lineage(_merged(roots, linked.where("linked").select("a", "b")), "roots")
        open_trees = (
            checked.groupBy("t", "u")
            .agg(F.bool_or("more").alias("more"), F.bool_and("linked").alias("all"))
            .where("more AND NOT all")
            .select("t", "u")
        )
        labels = cut_lineage(
            checked.join(open_trees, ["t", "u"])
            .select(F.explode(F.array("g", "h")).alias("label"))
            .distinct(),
            "labels",
        )
        if labels.isEmpty():
            return roots
        again = todo.join(labels, "label", "left_semi").drop("label")
        todo = cut_lineage(
            again.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn(
                "label", F.coalesce("label", "node")
            ),
            "todo",
        )
        quota = 16 * max(quota, 1)


def _groups(signed: DataFrame) -> DataFrame:
    """(group, node) of the nodes that share a signature with another one; like groups are one.

    A group is named by a hash of its nodes. Two groups of one name would only be compared together.
    """
    inside = Window.partitionBy("signature").orderBy("node")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        signed.withColumn("before", F.lag("node").over(inside))
        .where("before IS NULL OR before <> node")
        .withColumns(
            {"members": F.count("*").over(whole), "group": F.bit_xor(F.xxhash64("node")).over(whole)}
        )
        .where("members > 1")
        .select("group", "node")
        .distinct()
    )


def _units(groups: DataFrame) -> DataFrame:
    """(root, blocks, node): the nodes that are compared with each other, ``blocks`` of them.

    Groups that share nodes are one unit, compared once, as long as it is one block. Chains of
    groups grow with the table, in the end into one component of most nodes; of a larger one each
    group is a unit by itself.
    """
    inside = Window.partitionBy("group").orderBy("node")
    chained = (
        groups.withColumn("before", F.lag("node").over(inside))
        .where("before IS NOT NULL")
        .select(F.col("before").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    possible = cut_lineage(components(chained), "possible")
    large = cut_lineage(
        possible.groupBy("root").agg(F.count("*").alias("members")).where(f"members > {BLOCK}"), "large"
    )
    parted = groups.join(possible.join(large, "root", "left_semi").select("node"), "node")
    sizes = parted.groupBy("group").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    return (
        possible.join(large, "root", "left_anti")
        .select("root", F.lit(1).alias("blocks"), "node")
        .unionByName(parted.join(sizes, "group").select(F.col("group").alias("root"), "blocks", "node"))
    )


def classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles, class, component_id for every row of ``docs``.

    Words are runs of characters other than space and 09 to 0D, A to Z lower-cased. A document's
    set holds its distinct shingles of ``width`` words; with fewer words, the whole sequence as
    one. Two documents are linked when den * |intersection| >= num * |union|; a component is named
    by its smallest doc_id, nulls apart. Without words a document has no shingles and no links,
    and is its own component, of no class. Repeated rows and equal sets are linked. Other columns are ignored;
    an empty table gives an empty one.

    Equal sets become one node. Signatures are shuffled once; nodes that share one are possible
    partners, in units of at most a block or of one signature. Its nodes are compared by
    sketches that can only understate differences, block by block, and pairs that span what is
    left are compared by the sets themselves, for which the texts of these nodes alone are read
    again. No link that joins two components is lost, and a group does not write all of its pairs.
    Shingles are compared by 64-bit hashes. The similarity must exceed one half.
    """
    if 2 * num <= den:
        raise ValueError("the similarity must exceed one half")
    known = cut_lineage(sketch(docs, width), "sketch")
    units = cut_lineage(_units(cut_lineage(_groups(signatures(docs, width, num, den)), "groups")), "units")
    sketches = (
        known.where("parity IS NOT NULL")
        .select("node", F.col("n_shingles").alias("n"), "parity")
        .dropDuplicates(["node"])
        .join(units, "node")
    )
    roots = _roots(docs, known, sketches, width, num, den)
    named = cut_lineage(
        known.select("doc_id", "tie", "node", "n_shingles").join(roots, "node", "left").select(
            "doc_id", "tie", "n_shingles", F.coalesce("root", "node").alias("class")
        ),
        "named",
    )
    least = cut_lineage(
        named.where("class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("doc_id").alias("component_id")),
        "least",
    )
    return named.join(least, "class", "left").select(
        "doc_id",
        "tie",
        "n_shingles",
        "class",
        F.when(F.col("class").isNull(), F.col("doc_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def near_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id as ``classes`` finds them, for every row of ``docs``."""
    return classes(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component of ``docs``, with all columns.

    The smallest doc_id stays, a null one only without another; then the smallest text hash and
    a hash of the other columns, of any type, decide. Documents without words all stay.
    """
    found = cut_lineage(classes(docs, width, num, den), "classes").where("class IS NOT NULL")
    winner = found.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("__w")
    )
    stays = F.col("doc_id").eqNullSafe(F.col("__w.doc_id")) & (F.col("tie") == F.col("__w.tie"))
    # what goes is little: the texts that stay aren't shuffled for its sake
    apart = cut_lineage(
        found.groupBy("class", "doc_id", "tie")
        .agg(F.count("*").alias("n"))
        .join(winner, "class")
        .select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), stays.alias("stays"), "n")
        .where("n > 1 OR NOT stays"),
        "apart",
    )
    named = docs.withColumn("__own", F.xxhash64("text"))
    on = named["doc_id"].eqNullSafe(apart["__id"]) & (named["__own"] == apart["__tie"])
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    same = Window.partitionBy("doc_id", "__own").orderBy(row_hash(others))
    repeated = (
        named.join(apart.where("stays"), on, "left_semi")
        .withColumn("__nth", F.row_number().over(same))
        .where("__nth = 1")
    )
    kept = named.join(apart, on, "left_anti")
    return kept.select(*docs.columns).unionByName(repeated.select(*docs.columns))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return near_groups(docs, width=4, num=85, den=100)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM w
),
sized AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, n, unnest(s) AS g FROM s JOIN sized USING (doc_id)),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
    AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY ALL
),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
  ) SELECT a, min(b) AS m FROM r GROUP BY a
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, m AS component_id
FROM sized JOIN reach ON doc_id = a
"""

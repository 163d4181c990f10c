"""Forests of classification trees, grown where the rows are.

No tree is ever held as a whole. The nodes at the top of all trees are split by histograms that the
tasks add up, until a node holds no more than NODE_ROWS rows; the rows of such a node, one byte per
feature, are then sent to one task, which grows what is below and keeps only what it gains: the
decrease of impurity per feature, and the class shares that held-out rows meet in their leaf. The
driver holds the top nodes, of which there are about rows / NODE_ROWS per tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.session import cut_lineage

#: Values of a feature are told apart by as many bins.
BINS = 32
#: Weight of a node from which it is split by histograms of all tasks.
NODE_ROWS = 1 << 17
#: Cells of the histograms that a task holds at once.
CELLS = 1 << 22
#: How often a row is drawn into the sample of a tree, as Poisson(1): the chance of k times or fewer.
DRAWN = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(16)])


def cuts(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Ascending cuts per feature, at most BINS - 1: a value's bin is the number of cuts below it.

    They are approximate quantiles of all rows, or all distinct values if these are few.
    """
    shares = [(i + 1) / BINS for i in range(BINS - 1)]
    values = [F.col(f).cast("double") for f in features]
    asked = [F.percentile_approx(v, shares, 100 * BINS).alias(f"_{i}") for i, v in enumerate(values)]
    found = [np.unique(q or []) for q in rows.agg(*asked).first()]
    heavy = [i for i, q in enumerate(found) if len(q) < BINS - 1]
    if not heavy:
        return found

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.unique(c.to_numpy(zero_copy_only=False))[: BINS + 1] for c in batch.columns]
            at = np.repeat(heavy, [len(k) for k in kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(np.concatenate(kept), pa.float64())], names=["f", "v"]
            )

    # a batch names one value more than there are bins at most, so too many stay too many
    listed = (
        rows.select(*[values[i].alias(f"_{i}") for i in heavy])
        .mapInArrow(few, "f int, v double")
        .groupBy("f")
        .agg(F.array_sort(F.collect_set("v")).alias("v"))
        .where(F.size("v") <= BINS)
    )
    for f, v in listed.collect():
        found[f] = np.array(v[:-1])
    return found


def binned(rows: DataFrame, features: Sequence[str], edges: list[np.ndarray]) -> DataFrame:
    """``rows`` with ``_x``, the bins of all ``features`` by their :func:`cuts`, in their place."""
    others = [c for c in rows.columns if c not in features]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((batch.num_rows, len(edges)), np.uint8)
            for i, values in enumerate(batch.column("_x").flatten()):
                x[:, i] = np.searchsorted(edges[i], values.to_numpy(zero_copy_only=False))
            columns = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, _blobs(x)], names=[*others, "_x"])

    doubles = F.struct(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    schema = rows.select(*others, F.lit(b"").alias("_x")).schema
    return rows.select(*others, doubles.alias("_x")).mapInArrow(work, schema)


def _blobs(x: np.ndarray) -> pa.Array:
    """The rows of ``x`` as binary values."""
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.Array.from_buffers(
        pa.binary(), len(x), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(x))]
    )


def _joined(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def drawn(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often every row is in the sample of a tree; depends on its number alone."""
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    share = (z >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(DRAWN, share, side="right").astype(np.uint8)


class Split(NamedTuple):
    """What became of a node: its class weights, and unless it is a leaf its cut and children."""

    total: np.ndarray
    feature: int = -1
    cut: int = 0
    left: int = -1


def _asked(tree: int, node: int, seed: int, width: int, mtry: int) -> np.ndarray:
    """The features that a node at the top may be split by; every task draws the same ones."""
    return np.random.default_rng([seed, tree, node]).permutation(width)[:mtry]


def _best(hist: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cut of each histogram (..., bins, classes) and the impurity it takes away, times weight."""
    left = hist.cumsum(axis=-2)
    right = total[..., None, :] - left
    n_left, n_right = left.sum(axis=-1), right.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (left * left).sum(axis=-1) / n_left + (right * right).sum(axis=-1) / n_right
    pure[(n_left == 0) | (n_right == 0)] = -np.inf
    cut = pure.argmax(axis=-1)
    before = (total * total).sum(axis=-1) / total.sum(axis=-1)
    return cut, np.take_along_axis(pure, cut[..., None], -1)[..., 0] - before


def _level(x, y, w, rows, at, total, mtry, rng):
    """Feature, cut and gain of every node of a level; ``rows`` are ordered by their node ``at``."""
    nodes, k = total.shape
    feature, cut, gain = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.full(nodes, -np.inf)
    step = max(1, CELLS // 16 // (BINS * k))
    for a in range(0, nodes, step):
        b = min(a + step, nodes)
        lo, hi = np.searchsorted(at, [a, b])
        own, here = at[lo:hi] - a, rows[lo:hi]
        width = x.shape[1]
        asked = rng.random((b - a, width)).argpartition(mtry - 1, axis=1)[:, :mtry]
        for j in range(mtry):
            code = (own * BINS + x[here, asked[own, j]]) * k + y[here]
            hist = np.bincount(code, w[here], (b - a) * BINS * k).reshape(b - a, BINS, k)
            c, g = _best(hist, total[a:b])
            better = np.flatnonzero(g > gain[a:b])
            feature[a + better], cut[a + better], gain[a + better] = asked[better, j], c[better], g[better]
    return feature, cut, gain


def grow(x, y, w, judged, k: int, depth: int, mtry: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Impurity taken away per feature by a tree on weighted rows, and the class shares of ``judged``.

    A node is a leaf at the depth given, or where no cut takes any impurity away. The result doesn't
    depend on the order of the rows.
    """
    gains, shares = np.zeros(x.shape[1]), np.zeros((len(judged), k))
    y, w = y.astype(np.int64), w.astype(np.float64)
    rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    asks, ask_at = np.arange(len(judged)), np.zeros(len(judged), np.int64)
    nodes = 1
    for level in range(depth + 1):
        total = np.bincount(at * k + y[rows], w[rows], nodes * k).reshape(nodes, k)
        mixed = (total > 0).sum(axis=1) > 1
        feature, cut, gain = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes)
        if level < depth and mixed.any():
            number = np.cumsum(mixed) - 1
            some = mixed[at]
            order = np.argsort(at[some], kind="stable")
            found = _level(x, y, w, rows[some][order], number[at[some][order]], total[mixed], mtry, rng)
            feature[mixed], cut[mixed], gain[mixed] = found
        split = gain > 1e-9 * total.sum(axis=1)
        np.add.at(gains, feature[split], gain[split])
        done = ~split[ask_at]
        met = total[ask_at[done]]
        shares[asks[done]] = met / met.sum(axis=1, keepdims=True)
        if not split.any():
            break
        child = 2 * (np.cumsum(split) - 1)
        rows, at = rows[split[at]], at[split[at]]
        at = child[at] + (x[rows, feature[at]] > cut[at])
        asks, ask_at = asks[~done], ask_at[~done]
        ask_at = child[ask_at] + (judged[asks, feature[ask_at]] > cut[ask_at])
        nodes = 2 * int(split.sum())
    return gains, shares


class Grown(NamedTuple):
    """Importance of every feature, and the share of held-out rows that were told right."""

    featureImportances: np.ndarray
    accuracy: float | None


class Forest:
    """Settings of a forest; ``width`` features, ``classes`` labels."""

    def __init__(self, trees: int, depth: int, seed: int, width: int, classes: int):
        self.trees, self.depth, self.seed = trees, depth, seed
        self.width, self.classes = width, classes
        #: of all features a node may be split by the root of their number, as usual
        self.mtry = width if trees == 1 else int(np.ceil(np.sqrt(width)))

    def fit(self, rows: DataFrame) -> Grown:
        """Grow all trees on ``rows (_x, _y, _row, _held)``; rows with ``_held`` are only judged.

        ``_x`` are bins, a byte per feature, ``_y`` the number of a label, ``_row`` a number that
        says how often each tree draws the row.
        """
        rows = rows.select("_x", F.col("_y").cast("int"), F.col("_row").cast("long"), "_held")
        tops, gained = self._tops(rows)
        grown = cut_lineage(self._below(rows, tops), "grown")
        for tree, at, gain in grown.where("tree >= 0").select("tree", "at", "s0").collect():
            gained[tree, at] += gain
        each = gained.sum(axis=1, keepdims=True)
        weights = np.divide(gained, each, out=np.zeros_like(gained), where=each > 0).sum(axis=0)
        if weights.sum() > 0:
            weights /= weights.sum()
        shares = F.array(*[F.col(f"s{c}") for c in range(self.classes)])
        told = F.array_position(shares, F.array_max(shares)) - 1
        judged = grown.where("tree < 0").agg(F.avg((told == F.col("y")).cast("double"))).first()[0]
        return Grown(weights, judged)

    def _parts(self, batch: pa.RecordBatch):
        x = _joined(batch.column("_x"), "u1").reshape(batch.num_rows, self.width)
        held = batch.column("_held").to_numpy(zero_copy_only=False).astype(bool)
        return x, batch.column("_y").to_numpy(), batch.column("_row").to_numpy(), held

    def _place(self, x: np.ndarray, top: list[Split | None]) -> np.ndarray:
        """The node among those known that every row comes to."""
        at = np.zeros(len(x), np.int64)
        known = [t or Split(np.zeros(0)) for t in top]
        feature, cut = np.array([t.feature for t in known]), np.array([t.cut for t in known])
        left = np.array([t.left for t in known])
        while True:
            go = np.flatnonzero(left[at] >= 0)
            if not len(go):
                return at
            now = at[go]
            at[go] = left[now] + (x[go, feature[now]] > cut[now])

    def _tops(self, rows: DataFrame) -> tuple[list[list[Split | None]], np.ndarray]:
        """The nodes of more than NODE_ROWS rows of every tree with their children; what they gained.

        A node that is not known yet is None.
        """
        tops: list[list[Split | None]] = [[None] for _ in range(self.trees)]
        gained = np.zeros((self.trees, self.width))
        n = rows.where("NOT _held").count()
        todo = [(t, 0) for t in range(self.trees)] if n > NODE_ROWS and self.depth > 0 else []
        at_once = max(1, CELLS // (self.mtry * BINS * self.classes))
        for level in range(self.depth):
            more = []
            for i in range(0, len(todo), at_once):
                for found in self._split(rows, tops, todo[i : i + at_once]):
                    tree, node, top = found["tree"], found["node"], tops[found["tree"]]
                    total = np.array(found["total"])
                    if found["gain"] <= 1e-9 * total.sum():
                        top[node] = Split(total)
                        continue
                    gained[tree, found["feature"]] += found["gain"]
                    top[node] = Split(total, found["feature"], found["cut"], len(top))
                    for side in (np.array(found["lower"]), total - found["lower"]):
                        closed = (side > 0).sum() < 2 or level + 1 == self.depth
                        top.append(Split(side) if closed else None)
                        if not closed and side.sum() > NODE_ROWS:
                            more.append((tree, len(top) - 1))
            todo = more
        return tops, gained

    def _split(self, rows: DataFrame, tops: list, todo: list[tuple[int, int]]) -> list:
        """Best split of each (tree, node), from histograms of all tasks."""
        shape = (self.mtry, BINS, self.classes)
        nodes: dict[int, list[int]] = {}
        for tree, node in todo:
            nodes.setdefault(tree, []).append(node)

        whole, number, numbers = pa.int32(), pa.float64(), pa.list_(pa.float64())
        chosen = pa.schema([("tree", whole), ("node", whole), ("cut", whole), ("gain", number),
                            ("feature", whole), ("total", numbers), ("lower", numbers)])
        counted = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("hist", pa.binary())])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {key: np.zeros(shape) for key in todo}
            asked = {key: _asked(*key, self.seed, self.width, self.mtry) for key in todo}
            for batch in batches:
                x, y, row, held = self._parts(batch)
                for tree, some in nodes.items():
                    w = np.where(held, 0, drawn(row, tree, self.seed))
                    at = self._place(x, tops[tree])
                    for node in some:
                        here = np.flatnonzero((at == node) & (w > 0))
                        for j, f in enumerate(asked[tree, node]):
                            code = x[here, f].astype(np.int64) * self.classes + y[here]
                            hist = np.bincount(code, w[here], BINS * self.classes)
                            sums[tree, node][j] += hist.reshape(shape[1:])
            for (tree, node), hist in sums.items():
                if hist.any():
                    one = {"tree": tree, "node": node, "hist": hist.tobytes()}
                    yield pa.RecordBatch.from_pylist([one], counted)

        def choose(key, table):
            tree, node = (k.as_py() for k in key)
            hist = sum(np.frombuffer(h.as_py()).reshape(shape) for h in table.column("hist"))
            total = hist[0].sum(axis=0)
            cut, gain = _best(hist, np.broadcast_to(total, (self.mtry, self.classes)))
            j = int(gain.argmax())
            one = {
                "tree": tree, "node": node, "cut": int(cut[j]), "gain": float(max(gain[j], -1.0)),
                "feature": int(_asked(tree, node, self.seed, self.width, self.mtry)[j]),
                "total": total.tolist(), "lower": hist[j, : cut[j] + 1].sum(axis=0).tolist(),
            }
            return pa.Table.from_pylist([one], chosen)

        found = rows.mapInArrow(count, "tree int, node int, hist binary").groupBy("tree", "node")
        return found.applyInArrow(
            choose, "tree int, node int, cut int, gain double, feature int, total array<double>, lower array<double>"
        ).collect()

    def _below(self, rows: DataFrame, tops: list) -> DataFrame:
        """Sums ``s0, s1, ..``: of class shares per judged row ``at`` (tree -1), or gain per feature ``at``."""
        classes, width = self.classes, self.width

        packed = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("piece", pa.int64()),
                            *[(c, pa.binary()) for c in ("x", "y", "w", "row")]])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, row, held = self._parts(batch)
                for tree, top in enumerate(tops):
                    w = np.where(held, 0, drawn(row, tree, self.seed)).astype(np.uint8)
                    at = self._place(x, top)
                    out = []
                    for node in np.unique(at[held | (w > 0)]).tolist():
                        known = top[node] is not None  # a leaf: nothing is left to grow
                        here = np.flatnonzero((at == node) & (held if known else held | (w > 0)))
                        if len(here):
                            out.append({
                                "tree": tree, "node": node, "piece": int(row[here[0]]) if known else -1,
                                "x": x[here].tobytes(), "y": y[here].astype("<i4").tobytes(),
                                "w": w[here].tobytes(), "row": row[here][held[here]].tobytes(),
                            })
                    if out:
                        yield pa.RecordBatch.from_pylist(out, packed)

        def below(key, table):
            tree, node = key[0].as_py(), key[1].as_py()
            x = _joined(table.column("x"), "u1").reshape(-1, width)
            y, w = _joined(table.column("y"), "<i4"), _joined(table.column("w"), "u1")
            row = _joined(table.column("row"), "<i8")
            own, top = w > 0, tops[tree]
            gains, shares = np.zeros(width), np.zeros((len(row), classes))
            if top[node] is not None:
                shares[:] = top[node].total / top[node].total.sum()
            elif own.any():
                rng = np.random.default_rng([self.seed, tree, node, 1])
                gains, shares = grow(
                    x[own], y[own], w[own], x[~own], classes, self.depth - _depth(top, node), self.mtry, rng
                )
            first = np.concatenate([gains, shares[:, 0]])
            rest = [np.concatenate([np.zeros(width), shares[:, c]]) for c in range(1, classes)]
            return pa.table({
                "tree": pa.array(np.repeat([tree, -1], [width, len(row)]), pa.int32()),
                "at": pa.array(np.concatenate([np.arange(width), row]), pa.int64()),
                "y": pa.array(np.concatenate([np.zeros(width, "<i4"), y[~own]]), pa.int32()),
                **{f"s{c}": s for c, s in enumerate([first, *rest])},
            })

        names = [f"s{c}" for c in range(classes)]
        groups = sum(sum(t is None for t in top) for top in tops)
        sent = rows.mapInArrow(
            send, "tree int, node int, piece long, x binary, y binary, w binary, row binary"
        )
        return (
            sent.repartition(min(max(groups, 1), 2000), "tree", "node", "piece")
            .groupBy("tree", "node", "piece")
            .applyInArrow(below, "tree int, at long, y int, " + ", ".join(f"{s} double" for s in names))
            .groupBy("tree", "at")
            .agg(F.max("y").alias("y"), *[F.sum(s).alias(s) for s in names])
        )


def _depth(top: Sequence[Split | None], node: int) -> int:
    """How many splits lie above a node."""
    deep = 0
    for above in range(node - 1, -1, -1):
        split = top[above]
        if split is not None and split.left >= 0 and node in (split.left, split.left + 1):
            node, deep = above, deep + 1
    return deep

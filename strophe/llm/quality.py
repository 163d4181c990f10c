"""Quality scores from compression with a dictionary of good and one of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import load
from strophe.session import cut_lineage

#: Texts are compressed in windows of so many bytes, so a dictionary helps all along a long text.
WINDOW = 512
DICTIONARY = 112 << 10
LEVEL = 3
THRESHOLD = 0.3
#: Differences are damped as tanh(difference / DAMPING), so that extreme texts don't set the slope.
DAMPING = 0.05
#: One in so many sampled rows calibrates, the others train the dictionaries.
CALIBRATE = 4
#: Bounds of the training sample: labelled rows of each class, and windows of each text, drawn by
#: hash from the whole text. Calibration takes whole texts.
SAMPLE_ROWS = 3000
SAMPLE_WINDOWS = 32


def held_out(doc_id: Column) -> Column:
    """True if the CRC-32 of the id as text is divisible by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weight: float
    bias: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        options = {
            "level": LEVEL,
            "write_content_size": False,
            "write_checksum": False,
            "write_dict_id": False,
        }
        return [
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **options)
            for d in (self.good, self.bad)
        ]

    def score(self, differences: np.ndarray) -> np.ndarray:
        damped = np.tanh(differences / DAMPING)
        return 1 / (1 + np.exp(-np.clip(self.weight * damped + self.bias, -50, 50)))


def difference(text: str | None, good, bad) -> float:
    """(bad size - good size) / (bad size + good size) over all windows; 0 for an empty text."""
    parts = windows(text)
    a = sum(len(good.compress(p)) for p in parts)
    b = sum(len(bad.compress(p)) for p in parts)
    return (b - a) / (a + b) if parts else 0.0


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # too few samples to train on: use them as they are, in the order of their hashes
        return b"".join(samples)[:DICTIONARY]


def _drawn_windows(count: int):
    """Of every text at most ``count`` windows of at least 8 bytes, by their hash."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, quality in zip(batch.column("text"), batch.column("quality"), strict=True):
                found = sorted(
                    (xxhash.xxh64_intdigest(w, i) >> 1, w)
                    for i, w in enumerate(windows(text.as_py()))
                    if len(w) >= 8
                )[:count]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([quality.as_py()] * len(found), pa.int32()),
                        pa.array([key for key, _ in found], pa.int64()),
                        pa.array([w for _, w in found], pa.binary()),
                    ],
                    names=["quality", "key", "piece"],
                )

    return draw


def _differences(shared):
    """Label and difference of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = shared.value.compressors()
        for batch in batches:
            found = [difference(t.as_py(), good, bad) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality"), pa.array(found, pa.float64())], names=["quality", "x"]
            )

    return measure


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number, by Newton steps with a slight penalty."""
    design = np.column_stack([np.tanh(x / DAMPING), np.ones(len(x))])
    beta, w = np.zeros(2), w / w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - 1e-4 * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = SAMPLE_ROWS,
    windows_of_text: int = SAMPLE_WINDOWS,
) -> Model:
    """Fit to a sample of the labelled rows of ``docs`` that are not held out.

    Of each class at most ``rows`` rows are drawn, by the hash of their id. Three quarters train the
    dictionaries, each with at most ``windows_of_text`` windows drawn from its whole text; the
    others, as whole texts, calibrate: the classes count there as often as they occur. The driver
    gets the drawn windows and one number of every calibrating text. A document labelled twice takes
    the larger label; rows that repeat a labelled id are one draw, the smallest text of it. Without
    rows of both classes, as in empty tables, all scores are the share of label 1, or one half.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .where(~held_out(F.col("doc_id")))
    )
    counted = known.groupBy("quality").agg(F.count("*").alias("n")).collect()
    totals = {r["quality"]: r["n"] for r in counted}
    picked = [
        known.where(F.col("quality") == q)
        .orderBy(F.sha2(F.col("doc_id").cast("string"), 256))
        .limit(rows)
        for q in (0, 1)
    ]
    ids = picked[0].unionByName(picked[1])
    sample = cut_lineage(
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")  # 2 * rows ids
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
        .select("text", "quality", (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0).alias("calibrates")),
        "sample",
    )
    drawn = (
        sample.where("NOT calibrates")
        .select("quality", "text")
        .mapInArrow(_drawn_windows(windows_of_text), "quality int, key long, piece binary")
        .collect()  # at most 2 * rows * windows_of_text windows
    )
    ordered = sorted((r["key"], bytes(r["piece"]), r["quality"]) for r in drawn)
    pieces = {q: [w for _, w, quality in ordered if quality == q] for q in (0, 1)}
    n = totals.get(0, 0) + totals.get(1, 0)
    share = (totals.get(1, 0) + 0.5) / (n + 1)
    flat = Model(b"\0" * 8, b"\0" * 8, 0.0, float(np.log(share / (1 - share))))
    if not all(pieces.values()):
        return flat
    model = Model(_dictionary(pieces[1]), _dictionary(pieces[0]), 0.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    measured = (
        sample.where("calibrates")
        .select("quality", "text")
        .mapInArrow(_differences(shared), "quality int, x double")
        .collect()  # at most 2 * rows numbers
    )
    x = [np.sort([r["x"] for r in measured if r["quality"] == q]) for q in (0, 1)]
    if not len(x[0]) or not len(x[1]):
        return flat
    weight = [np.full(len(x[q]), totals[q] / len(x[q])) for q in (0, 1)]
    y = np.concatenate([np.zeros(len(x[0])), np.ones(len(x[1]))])
    return Model(model.good, model.bad, *_calibrate(np.concatenate(x), y, np.concatenate(weight)))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and score, predicted: one pass, no shuffle.

    A null or empty text gets the score of no difference, and equal texts get equal scores; repeated
    rows stay, an empty table gives an empty one. Very long texts are scored whole, window by window.
    Columns named score or predicted are replaced, others of any type are carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        good, bad = own.compressors()
        for batch in batches:
            texts = batch.column("text")
            found = own.score(np.array([difference(t.as_py(), good, bad) for t in texts], float))
            yield batch.append_column("score", pa.array(found, pa.float64())).append_column(
                "predicted", pa.array((found >= threshold).astype(np.int32), pa.int32())
            )

    schema = kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return kept.mapInArrow(add, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, load(spark, sf_dir, "labels", "doc_id", "quality"))
    return scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )

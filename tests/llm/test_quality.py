"""The compression classifier: held-out accuracy, whole texts, odd rows, equal results for equal input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import quality

GOOD = "the committee reviewed evidence from several careful studies and published its findings".split()
BAD = "click here buy now cheap offer win prize subscribe limited deal free bonus casino".split()
DOCS = "doc_id long, text string, source string, tags map<string,string>, score string"


def sentence(stock, rng, n=60):
    return " ".join(rng.choice(stock) for _ in range(n))


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, sentence(GOOD if good else BAD, rng), "s", {"a": "b"}, "old"))
        labels.append((i, int(good)))
    rows += [(1000, None, None, None, None), (1001, "", "s", {}, None), (None, "x", "s", None, None), rows[7], rows[7]]
    labels += [(1001, 1), (None, 0), (5, None), (7, labels[7][1])]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")


def test_scores_of_held_out_rows(tables):
    docs, labels = tables
    got = quality.scores(docs, quality.train(docs, labels)).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and is_held_out(r["doc_id"])]
    good = [r["score"] for r in held if r["doc_id"] % 3]
    bad = [r["score"] for r in held if r["doc_id"] % 3 == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert got[0]["tags"] == {"a": "b"}


def test_scores_match_a_plain_version(tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    good, bad = model.compressors()
    for r in quality.scores(docs, model).collect():
        raw = (r["text"] or "").encode()
        parts = [raw[i : i + 512] for i in range(0, len(raw), 512)]
        a, b = (sum(len(c.compress(p)) for p in parts) for c in (good, bad))
        x = np.tanh((b - a) / (a + b) / quality.DAMPING) if parts else 0.0
        assert abs(r["score"] - 1 / (1 + np.exp(-model.weight * x - model.bias))) < 1e-12


def test_labels_of_held_out_rows_are_not_learnt(tables):
    docs, labels = tables
    turned = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert quality.train(docs, labels) == quality.train(docs.repartition(7), turned.repartition(3))


def test_training_reads_past_any_prefix(spark, tables):
    """Long texts that all begin alike are told apart by what follows."""
    rng = random.Random(5)
    head = sentence(["alpha", "beta", "gamma"], rng, 4000)  # 22 thousand characters
    rows = [(i, head + " " + sentence(GOOD if i % 2 else BAD, rng, 4000)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.scores(docs, quality.train(docs, labels)).collect()
    held = {r["doc_id"]: r["score"] for r in got if is_held_out(r["doc_id"])}
    assert min(v for i, v in held.items() if i % 2) > max(v for i, v in held.items() if i % 2 == 0)


def test_empty_tables(tables):
    docs, labels = tables
    none = labels.where("false")
    flat = quality.scores(docs, quality.train(docs, none)).select("score").distinct().collect()
    assert [r["score"] for r in flat] == [0.5]
    assert quality.scores(docs.where("false"), quality.train(docs.where("false"), none)).count() == 0

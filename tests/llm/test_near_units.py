"""What near-duplicate detection sends around grows with the table, not with its square."""

import numpy as np
from pyspark.sql import functions as F

from strophe.llm import jaccard


def test_chained_groups_are_not_one_unit(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)

    def sent(links):
        groups = [(g, n) for g in range(links) for n in (g, g + 1)]  # every node is in two groups
        groups += [(-1, -1), (-1, -2), (-2, -2), (-2, -3)]  # a chain that fits one block
        groups += [(-9, -100 - i) for i in range(40)]  # a group of more than a block
        units = jaccard._units(spark.createDataFrame(groups, "group long, node long"))
        # each sketch goes to all block pairs of its unit
        return {r["root"]: (r["count"], r["blocks"])
                for r in units.groupBy("root", "blocks").count().collect()}

    few, many = sent(100), sent(400)
    for got, links in ((few, 100), (many, 400)):
        assert sorted(v for k, v in got.items() if k >= 0) == [(2, 1)] * links
        assert got[-3] == (3, 1) and got[-9] == (40, 3)
    rows = [sum(n * blocks for n, blocks in got.values()) for got in (few, many)]
    assert rows[1] < 5 * rows[0]


def test_texts_are_read_again_once_and_only_those_asked_for(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(rng.choice([f"o{i}" for i in range(5000)], 60)) for _ in range(200)]
    for _ in range(45):
        copy = list(base)
        for at in rng.integers(0, len(copy), rng.integers(0, 7)):
            copy[at] = f"x{rng.integers(0, 1 << 30)}"
        texts.append(" ".join(copy))
    written, keep = {}, jaccard.cut_lineage

    def cut(df, name="step"):
        out = keep(df, name)
        written.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", cut)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and 200 <= kept.count() < 245
    assert len(written["pairs"]) > 1 and len(written["sets"]) == 1
    assert 16 < written["sets"][0].count() == written["keys"][0].count() <= 45
    # what goes is sent around, not what stays
    assert written["apart"][0].count() == 245 - kept.count()


def test_one_of_repeated_rows_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (2, text + " more", "a"), (None, text, "c"),
            (3, "", "a"), (3, "", "a"), (4, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = jaccard.keep_one(docs).select("doc_id", "text").collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(1, text), (3, ""), (3, ""), (4, None)], key=str)
    assert jaccard.keep_one(docs.where(F.lit(False))).count() == 0

"""Every stage of the corpus pipeline, and their chain, against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strophe.llm import quality
from strophe.llm.common import load
from strophe.llm.token_tables import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int"
GOOD = "river stone garden letter winter morning quiet bridge window harvest story teacher".split()
BAD = "xx99 buyit $$$ clickk zzqq w1n fr33 ###== casinoo %%% lolol offerr".split()


def fixture_rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(120):
        vocabulary = GOOD if i % 3 else BAD
        text = " ".join(rng.choice(vocabulary, 60 + i % 40))
        out.append([i, text, "en", ("a", "b", None)[i % 7 % 3], len(text), 1])
    for i, copied in enumerate((1, 2, 4, 4, 5)):
        same = out[copied][1]
        out.append([200 + i, same.upper() if i % 2 else same, "en", "b", len(same), None])
    for i, copied in enumerate((7, 8, 10)):
        near = out[copied][1] + " tail"
        out.append([300 + i, near, "en", "a", len(near), 1])
    out += [[400, None, None, None, None, None], [401, "", "en", "a", 0, 1], [402, " \t", "en", "a", 2, 1]]
    out.append([403, out[11][1] + " " + " ".join(rng.choice(GOOD, 4000)), "en", "a", 9, 1])
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = fixture_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1 if r[0] % 3 else 0) for r in rows if r[0] < 120]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def good_rows(spark, folder, rows):
    """The model scores a text by itself here, without Spark."""
    docs = load(spark, folder, "documents", "*")
    model = quality.train(docs, load(spark, folder, "labels", "doc_id", "quality"))
    good, bad = model.compressors()
    score = model.score(np.array([quality.difference(r[1], good, bad) for r in rows]))
    return [r for r, s in zip(rows, score, strict=True) if s >= 0.3]


def without_copies(rows):
    last = {}
    for r in sorted(rows):
        last[(r[1] or "").lower()] = r
    return sorted(last.values())


def shingles(text):
    words = (text or "").lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def without_near_copies(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 80 * len(x | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    first = {}
    for r, group in sorted(zip(rows, root, strict=True)):
        first.setdefault(group, r)
    return sorted(first.values())


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def sizes(rows):
    return {r[0]: len((r[1] or "").split()) for r in rows}


def check_mix(before, mixed):
    size, taken, by_source, whole = sizes(before), Counter(), Counter(), Counter()
    texts = {r[0]: r[1] for r in before}
    for r in mixed:
        n = len(r[1].split())
        taken[r[0]] += n
        by_source[r[3]] += n
        assert set(r[1].split()) <= set(texts[r[0]].split())
    for r in before:
        whole[r[3]] += size[r[0]]
    assert all(n <= 2 * size[d] for d, n in taken.items())
    sources = sorted((s for s in whole if whole[s]), key=lambda s: (s is None, s or ""))
    weight = dict(zip(sources, (3, 1, 2)))
    left, wanted, full = 1.5 * sum(whole.values()), {}, set()
    while len(wanted) < len(sources):
        open_ = [s for s in sources if s not in full]
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > 2 * whole[s]]
        for s in above or open_:
            wanted[s] = 2 * whole[s] if above else level * weight[s]
            left -= wanted[s] if above else 0
            full.add(s)
    assert all(abs(by_source[s] - wanted[s]) <= 1 for s in sources)


def check_pieces(before, pieces):
    encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode
    wanted, got, filled = defaultdict(Counter), defaultdict(Counter), defaultdict(int)
    for r in before:
        wanted[r[0]].update([*encode(r[1] or "", add_special_tokens=False).ids, 1])
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"]
        got[p["doc_id"]].update(ids.tolist())
        filled[p["sequence_id"]] += p["length"]
    assert got == wanted
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())


def test_stages_and_their_chain(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = load(spark, folder, "documents", "*")
    rows = plain(docs.na.fill({"n_chars": -1, "size": -1, "text": "\0", "lang": "\0", "source": "\0"}))
    rows = [tuple(None if v in ("\0", -1) else v for v in r) for r in rows]
    ids = lambda some: sorted(r[0] for r in some)

    kept = good_rows(spark, folder, rows)
    now = stages["quality"](spark, docs, folder)
    assert ids(now.collect()) == ids(kept) and now.columns == docs.columns
    assert 0 < len(kept) < len(rows)

    alone = without_copies(kept)
    now = stages["exact_dedup"](spark, spark.createDataFrame(kept, DOCS), folder)
    assert ids(now.collect()) == ids(alone) and now.columns == docs.columns
    assert len(alone) < len(kept)

    apart = without_near_copies(alone)
    now = stages["near_dedup"](spark, spark.createDataFrame(alone, DOCS), folder)
    assert ids(now.collect()) == ids(apart) and now.columns == docs.columns
    assert len(apart) < len(alone)

    mixed = stages["mixing"](spark, spark.createDataFrame(apart, DOCS), folder)
    assert mixed.columns == docs.columns
    mixed_rows = [tuple(r) for r in mixed.collect()]
    check_mix(apart, mixed_rows)

    packed = stages["packing"](spark, spark.createDataFrame(mixed_rows, DOCS), folder)
    check_pieces(mixed_rows, packed.collect())

    check_pieces(mixed_rows, corpus_pipeline.run(spark, folder).collect())


def test_stages_take_empty_tables(spark, folder):
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name

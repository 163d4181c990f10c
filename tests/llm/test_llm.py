"""The training-data operators against plain versions on small tables with odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import exact_dedup, huffman, jaccard, line_dedup, mixing, packing, token_counts, topk, url_filter
from strophe.llm.token_tables import tokenizer_path
from strophe.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept boolean"
LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [None, "", "  ", "a", "One two  three\n\nfour", "one two  three\n\nfour", LONG, LONG + " x", "a\nb\nc\nd\na\nb\nc",
         "Äé straße — 日本 it's 12,5!!", "a\nb\nc", LONG, "p q r s t u v", "p q r s t u v w"]


def rows():
    out = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1, True) for i, t in enumerate(TEXTS)]
    return [*out, (None, "p q r s t u v", None, None, None, None, None), out[4], out[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def words(text):
    return (text or "").encode().lower().split()


def test_exact_groups(docs):
    got = exact_dedup.exact_groups(docs).collect()
    norm = [bytes((t or "").encode()).lower() if (t or "").isascii() else (t or "").encode() for _, t, *_ in rows()]
    assert len(got) == len(norm) and sum(r["kept"] for r in got) == len(set(norm))
    assert exact_dedup.drop_duplicates(docs).count() == len(set(norm))


def test_mix_reaches_targets(docs):
    got = mixing.taken_words(mixing.mix(docs, block=7, shard=16)).collect()
    assert len(got) == len(rows()) and all(r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) < 1 for (_, t), v in by.items())
    assert mixing.mixed_documents(docs, block=7, shard=16).columns == docs.columns


def test_coded_ids_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path, out = tokenizer_path("word_bpe_49k.json"), scratch_path(spark, "coded")
    huffman.write_coded(docs, path, out)
    plain = Tokenizer.from_file(path)
    ids = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    got = huffman.read_coded(spark, out).orderBy("start").collect()
    assert sorted(bytes(r["ids"]) for r in got) == sorted(np.array(ids(t), "<u4").tobytes() for _, t, *_ in rows())
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda x: -1 if x is None else x)


def test_pack_places_every_id_once(docs):
    got = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=64).collect()
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for spans in used.values():
        spans.sort()
        total = sum(n for _, n in spans)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert total == 64 or total & (total - 1) == 0


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(packing.hilbert_key(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_near_groups_match_brute_force(docs):
    data = rows()
    sets = []
    for _, t, *_ in data:
        w = words(t)
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(data)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    want = []
    for i, (d, *_) in enumerate(data):
        ids = [data[k][0] for k in range(len(data)) if root[k] == root[i] and data[k][0] is not None]
        want.append((d, len(sets[i]), min(ids, default=None)))
    got = [tuple(r) for r in jaccard.near_groups(docs, 4, 85, 100).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_families_near_the_threshold(spark, monkeypatch):
    """Copies whose similarities lie around the threshold, over many blocks, as brute force links them."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(5)
    texts = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(150)]
        for _ in range(45):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 7)):
                copy[at] = f"x{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(frame, 5, 80, 100).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_close_pairs_of_blocks_match_plain_comparison():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (30, 90, 130, 400)]
    sets = []
    for k in range(160):
        one = base[k % 4].copy()
        one[: rng.integers(0, len(one) // 4)] = rng.integers(0, 1 << 63, 1, np.uint64)
        sets.append(np.unique(one)[: len(one) - int(rng.integers(0, len(one) // 5))])
    names = np.arange(160)
    parity = [jaccard.parity(s) for s in sets]
    block = jaccard.Block(
        names, names // 3, np.array([len(s) for s in sets]),
        np.array([8 * len(p) for p in parity]), parity,
    )
    bits = [np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little") for p in parity]

    def far(i, j):
        x, y = sorted((bits[i], bits[j]), key=len)
        if len(y) > 2 * len(x):
            return None
        y = y if len(x) == len(y) else y[: len(x)] ^ y[len(x) :]
        both = len(sets[i]) + len(sets[j])
        like = 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))
        return (x != y).sum() / both if like and (x != y).sum() * 9 <= both else None

    expected = {
        (i, j): f for i in range(160) for j in range(i, 160) if (f := far(i, j)) is not None
    }
    got = {}
    for i, j, d in jaccard._close(block, block, 80, 100):
        got |= dict(zip(zip(i.tolist(), j.tolist(), strict=True), d.tolist(), strict=True))
    assert {k: v for k, v in got.items() if k[0] <= k[1]} == expected

    for quota in (1, 16):
        best = {}
        for (i, j), d in expected.items():
            if i // 3 != j // 3:
                best.setdefault((i // 3, j // 3), []).append(d)
        pairs = jaccard._closest(block, block, 80, 100, quota).to_pandas()
        for key, rows in pairs.groupby(["g", "h"]):
            want = sorted(best.pop(key))
            assert sorted(expected[a, b] for a, b in zip(rows["a"], rows["b"], strict=True)) == want[:quota]
            assert set(rows["more"]) == {len(want) > quota}
        assert not best


def test_line_windows(docs):
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got[8]["text"] == "a\nb\nc\nd" and got[10]["text"] == "" and got[10]["n_removed"] == 3
    assert got[0]["n_lines"] == 1 and got[0]["n_removed"] == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    odd = [(None, [1.0] * 6), (200, None), (201, [None] * 6), (202, [float("nan")] * 6), (100, vectors[0][1])]
    df = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=16, group=2).collect()
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors}
    for i in (0, 50):
        every = [(-int(q[i] @ q[j]), j) for j in q if j != i] + ([(-int(q[i] @ q[0]), 100)] if i != 100 else [])
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [(-s, v) for _, v, s in mine] == sorted(every)[:5]


def test_trie_counts_match_plain_dynamic_programme():
    costs = {"a": 1.0, "b": 1.5, "ab": 1.7, "abc": 4.0, "c": 2.0, "bc": 2.0}
    words_ = sorted({"abc", "abcab", "ab", "b", "zab", "cab"})

    def plain(w):
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            options = [(best[e - 1][0] + token_counts.UNKNOWN, 0, best[e - 1][1] + 1)]
            options += [(best[b][0] + costs[w[b:e]], b - e, best[b][1] + 1) for b in range(e) if w[b:e] in costs]
            least = min(options)
            best.append((least[0], least[2]))
        return best[-1][1]

    assert token_counts.trie_counts(words_, costs) == [plain(w) for w in words_]


def test_rules_and_parts(spark):
    pages = [(1, "HTTP://A.Example.ORG/es/x?y"), (2, "https://x.com/de/1#f"), (3, None), (4, "no scheme"), (5, "http://b.net?x"),
             (6, "http://example.org/en/12"), (7, "http://notexample.org.net/es/")]
    labelled = spark.createDataFrame(url_filter.labelled_addresses(), "url string, label int")
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df, labelled).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("a.example.org", "/es/x", "example.org/es/")
    assert got[2]["verdict"] == "block" and got[6]["rule"] == "example.org/en/1" and got[7]["rule"] is None
    assert got[3]["host"] == got[4]["path"] == "" and got[5]["host"] == "b.net"


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert exact_dedup.exact_groups(none).count() == 0
    assert jaccard.near_groups(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert mixing.taken_words(mixing.mix(none)).count() == 0
    assert packing.pack(none, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_crc_of_ids_is_unsigned():
    assert zlib.crc32(b"\xff") >= 0


def test_path_belongs_to_the_first_address(spark):
    urls = ["http://b.net?u=http://x.com/de/1", "http://shop.com?u=http://x.org/de/1", "http://b.net#http://x.com/a",
            "http://b.net/p?u=http://x.com/q", "http://b.net", "b.net/p", "://h/p://q/r"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string").orderBy("i")
    got = [tuple(r) for r in df.select(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).collect()]
    assert got == [("b.net", ""), ("shop.com", ""), ("b.net", ""), ("b.net", "/p"), ("b.net", ""), ("", ""), ("h", "/p://q/r")]


@pytest.mark.parametrize("num", [51, 60, 70, 85])
def test_partners_of_other_sizes_share_a_signature(num):
    rng = np.random.default_rng(num)
    for large in (*range(20, 400, 7), 150):
        small = -(-large * num // 100)
        whole = np.sort(rng.integers(0, 1 << 63, large, dtype=np.uint64))
        part = np.sort(rng.choice(whole, small, replace=False))
        values, held = jaccard._signatures(np.concatenate([whole, part]), np.array([large, small]), num, 100)
        assert set(values[: held[0]]) & set(values[held[0] :]), (small, large)


def test_a_link_over_sizes_is_found(spark):
    text = [f"w{i}" for i in range(154)]
    frame = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:94])), (3, "x y z")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(frame, 5, 60, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 3}

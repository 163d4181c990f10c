"""Alignment of two tokenizers against a plain version over all pairs of byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strophe.llm import alignment
from strophe.llm.alignment import SentenceEncoder, align, merge_pieces, op13_alignment
from strophe.llm.token_tables import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "One two  three\n\nfour", "  x ", "\n", "\nab cd", "a \nb", "tab\there",
         "Äé straße — 日本 it's 12,5!!", "<|endoftext|> plain <s> </s>", "▁odd ▁ ▁▁x", "ﬁ ①", "a\r\nb\x00c",
         " ".join(f"w{i}" for i in range(400)), "Same words here.", "Same words here.", "🙂🙂 ok"]
FORM = "doc_id long, text string, batch int, pairs string, n_a string"


def plain(rows):
    """Per row its counts and digest, all from the library's ids."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [i for i in range(256) if i not in printable]
    stand = {chr(i): i for i in printable} | {chr(256 + k): i for k, i in enumerate(others)}
    docs, total = [], Counter()
    for doc, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        by_a = [bytes(stand[c] for c in names[i]) for i in ids_a]
        by_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or not b"".join(by_a) == b"".join(by_b) == (" " + text).encode():
            docs.append((doc, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (by_a, by_b)]
        links = [
            (ids_a[i], ids_b[j])
            for i, x in enumerate(ends[0])
            for j, y in enumerate(ends[1])
            if max(x - len(by_a[i]), y - len(by_b[j])) < min(x, y)
        ]
        total.update(links)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            i, j = p, q
        docs.append((doc, ids_a, ids_b, groups, links))
    most = Counter()
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    out = []
    for doc, ids_a, ids_b, groups, links in docs:
        best = sum(total[link] == most[link[1]] for link in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), digest, best, sum(total[x] for x in links)))
    return out, total


@pytest.mark.parametrize(("together", "work"), [(1, 3), (200, 16), (1 << 20, 1 << 16)])
def test_alignment_matches_plain(spark, together, work):
    rows = [*enumerate(TEXTS), (None, "Same words here."), (3, "a")]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], FORM)
    got, pairs = align(frame, A, B, together=together, work=work)
    want, total = plain(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {(r["id_a"], r["id_b"]): r["n"] for r in pairs.collect()} == total


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows]
    got = op13_alignment(spark, sf).collect()
    from_library = {d: h for d, _, _, _, _, h, _, _ in plain([r for r in rows if len(r[1] or "") < 2000])[0]}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in from_library:
            assert r["groups_sha256"] == from_library[r["doc_id"]]
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_best"] <= r["n_links"]


def test_empty_table(spark):
    got, pairs = align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.count() == 0 and pairs.count() == 0


def test_pieces_of_ids_are_the_librarys():
    encoder, library = SentenceEncoder(B), sentencepiece.SentencePieceProcessor(model_file=B)
    rng = np.random.default_rng(2)
    bits = [" ", "  ", "\n", "\t", "a", "the", "▁", "é", "日", "'s", ".", "\r", "12", "<0x0A>", " x", " "]
    for _ in range(4000):
        text = "".join(bits[k] for k in rng.integers(0, len(bits), rng.integers(1, 9)))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text), repr(text)


def test_merge_pieces_do_not_depend_on_their_size():
    rng = np.random.default_rng(4)
    for _ in range(60):
        end = int(rng.integers(5, 200))
        a, b = (np.append(np.flatnonzero(rng.random(end) < 0.4) + 1, end + 1) for _ in range(2))
        want = [np.concatenate(x).tolist() for x in zip(*merge_pieces(a, b, 1 << 20))]
        for work in (1, 2, 7):
            got = [np.concatenate(x).tolist() for x in zip(*merge_pieces(a, b, work))]
            assert got == want
        assert len(want[0]) == len(set(a) | set(b)) and len(want[2]) == len(set(a) & set(b))


def test_ids_fit_the_packed_form():
    assert alignment.BUCKETS <= 256

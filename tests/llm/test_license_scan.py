"""License labels against a plain comparison of every block with every template."""

import random
import re

from strophe.llm.license_scan import PHRASES, STRIDE, TEMPLATES, scan

FORM = "doc_id long, text string, row string, blocks int, labels string"


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, base, found, best = [], set(), set(), 0.0
    for phrase, label in PHRASES:
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                places.append(i)
                base.add(label)
    for start in range(0, len(words), STRIDE):
        block = set(words[start : start + 2 * STRIDE])
        for template, label in TEMPLATES:
            tokens = set(template.split())
            if 10 * len(block & tokens) >= 9 * len(tokens):
                found.add(label)
                best = max(best, len(block & tokens) / len(tokens))
    return (len(words), len(places), min(places, default=None), max(places, default=None), sorted(base),
            sorted(base | found), 1.0 if places else best)


def odd_texts():
    rng = random.Random(2)
    filler = "the of and in license public under version word été mit 2 0".split()
    texts = [None, "", "...", "MIT", "Under the MIT License. under the mit license", "CC-BY-NC; cc by\nnc!", "Ünder the mit licensé"]
    for _ in range(120):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 150))]
        template = rng.choice(TEMPLATES)[0].split()
        for _ in range(rng.randint(0, 3)):
            template.pop(rng.randrange(len(template)))
        at = rng.randint(0, len(words))
        texts.append(rng.choice([" ", "\n", ", "]).join([*words[:at], *template, *words[at:]]))
    return [*texts, " ".join(["word"] * 20000 + TEMPLATES[1][0].upper().split())]


def test_labels_match_plain(spark):
    rows = [*enumerate(odd_texts()), (None, "under the mit license"), (4, "again"), (4, "again")]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], FORM)
    got = [tuple(r)[:8] for r in scan(frame).collect()]
    assert sorted(got, key=str) == sorted([(d, *plain(t)) for d, t in rows], key=str)
    assert any(r[6] and not r[2] for r in got)


def test_spans_hold_the_passage(spark):
    text = " ".join(["word"] * 100 + TEMPLATES[1][0].split() + ["word"] * 50)
    row = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["spans"] and all(s["label"] == "mit" and s["containment"] >= 0.9 for s in row["spans"])
    assert any(s["first_word"] <= 100 and s["end_word"] >= 100 + len(TEMPLATES[1][0].split()) for s in row["spans"])


def test_empty_table_and_no_templates(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "under the mit license")], "doc_id long, text string")
    assert scan(docs, templates=()).first()["labels"] == ["mit"]

"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import UPPER, load
from strophe.session import cut_lineage, spread

#: A block starts at every STRIDE-th word and covers twice as many, so a passage of up to STRIDE
#: words lies whole in at least one block.
STRIDE = 32
#: The share of a template's distinct words that a block must hold.
NUM, DEN = 9, 10

#: Phrases whose consecutive words are a base place, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Sentences of public licenses, in words, and their labels. Words may come in any
#: order and with others between; up to 9 distinct words all have to be there.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the "
     "license at http www apache org licenses license 2 0", "apache-2"),
    ("licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without "
     "fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license",
     "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license",
     "cc-by-sa"),
    ("creative commons cc0 1 0 universal", "cc0"),
)

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

_DIGEST = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "blocks array<struct<block:int,words:array<int>>>"
)


def _needed(size: int, num: int, den: int) -> int:
    return -(-size * num // den)


def _places(words: list[bytes], phrases: Sequence[tuple[bytes, str]]) -> tuple[list[int], set[str]]:
    """First words of all places of the phrases, and the labels of those found."""
    joined = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in phrases:
        at = joined.find(phrase)
        while at >= 0:
            labels.add(label)
            places.append(joined.count(b" ", 0, at))
            at = joined.find(phrase, at + 1)
    return places, labels


def _digests(docs: DataFrame, known: dict[bytes, int], phrases, stride: int, least: int):
    """Per row: words, base places, and the template words of every block with ``least`` of them."""
    bounded = [(b" " + p.encode() + b" ", label) for p, label in phrases]
    types = docs.select("doc_id").schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for text in batch.column("text"):
                words = _WORDS.findall((text.as_py() or "").encode().lower())
                places, labels = _places(words, bounded)
                halves: dict[int, set[int]] = {}
                for at, number in enumerate(map(known.get, words)):
                    if number is not None:
                        halves.setdefault(at // stride, set()).add(number)
                blocks = []
                for half in sorted({h - d for h in halves for d in (0, 1) if h >= d}):
                    held = halves.get(half, set()) | halves.get(half + 1, set())
                    if len(held) >= least:
                        blocks.append({"block": half, "words": sorted(held)})
                row = (len(words), len(places), min(places, default=None),
                       max(places, default=None), sorted(labels), blocks)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [*[pa.int64()] * 4, pa.list_(pa.string()),
                     pa.list_(pa.struct([("block", pa.int32()), ("words", pa.list_(pa.int32()))]))]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], names=["doc_id", *names]
            )

    return spread(docs.select("doc_id", "text")).mapInArrow(digest, f"{types}, {_DIGEST}")


def _found(blocks: DataFrame, templates, known: dict[bytes, int], num: int, den: int) -> DataFrame:
    """(row, block, label, containment) of all blocks that reach a template's threshold.

    Words are ranked by how many blocks of the corpus hold them, rarest first; that table and the
    index are as small as the templates. A block and a template with ``need`` words in common share
    a word among the first size - need + 1 of either. The positions of the first common word bound
    the overlap; pairs that pass are verified on the whole sets.
    """
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}
    order = sorted(known.values(), key=lambda w: (seen.get(w, 0), w))
    rank = {word: i for i, word in enumerate(order)}
    index, least = [], None
    for text, label in templates:
        tokens = sorted({rank[known[w]] for w in text.encode().split()})
        need = _needed(len(tokens), num, den)
        least = need if least is None else min(least, need)
        index += [
            (token, place, label, need, tokens)
            for place, token in enumerate(tokens[: len(tokens) - need + 1])
        ]
    # as many rows as the templates have rare words
    index = blocks.sparkSession.createDataFrame(
        index, "token int, place int, label string, need int, template array<int>"
    )
    ranks = F.array(*[F.lit(rank[w]) for w in range(len(known))])
    sets = blocks.select(
        "row",
        "block",
        F.array_sort(F.transform("words", lambda w: F.element_at(ranks, w + 1))).alias("tokens"),
    )
    size, other = F.size("tokens"), F.size("template")
    rest = F.least(size - F.col("at"), other - F.col("place"))
    probes = (
        sets.select(
            "*", F.posexplode(F.slice("tokens", F.lit(1), size - least + 1)).alias("at", "token")
        )
        .join(F.broadcast(index), "token")
        .where((size >= F.col("need")) & (rest >= F.col("need")))
        .withColumn("common", F.array_intersect("tokens", "template"))
    )
    # of the words in common only the first one counts the pair
    return probes.where(
        (F.element_at("common", 1) == F.col("token")) & (F.size("common") >= F.col("need"))
    ).select("row", "block", "label", (F.size("common") / other).alias("containment"))


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    stride: int = STRIDE,
    num: int = NUM,
    den: int = DEN,
) -> DataFrame:
    """License labels of every document, found by phrases and by sets of words.

    ``docs`` has doc_id and text; other columns are ignored. Returns one row per row: doc_id,
    n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score and
    spans (label, first word, word after the last, containment) of the blocks found. Null and empty texts have no words,
    no labels and score 0. Repeated rows and null ids are answered each on its own. The score is 1
    with a base place, else the highest containment found, else 0; an empty table gives no rows.

    A template is found where a block of 2 * ``stride`` words holds ``num`` / ``den`` of its
    distinct words. Templates must not be longer than ``stride`` words, so no whole occurrence is
    cut by all blocks. Only words of templates leave the scan of the texts; the join and its
    verification work on small sets.
    """
    if any(len(text.split()) > stride for text, _ in templates):
        raise ValueError(f"a template has more than {stride} words")
    vocabulary = sorted({w for text, _ in templates for w in text.encode().split()})
    known = {word: i for i, word in enumerate(vocabulary)}
    least = min((_needed(len(set(t.split())), num, den) for t, _ in templates), default=1)
    digests = cut_lineage(
        _digests(docs, known, phrases, stride, least).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "license_blocks",
    )
    blocks = digests.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    span = F.struct(
        "label",
        (F.col("block").cast("long") * stride).alias("first_word"),
        ((F.col("block").cast("long") + 2) * stride).alias("end_word"),
        "containment",
    )
    if known:
        found = _found(blocks, templates, known, num, den)
    else:
        found = blocks.select("row", "block", F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    matched = found.groupBy(F.col("row").alias("__row")).agg(
        F.collect_set("label").alias("__labels"),
        F.max("containment").alias("__best"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    both = F.concat("base_labels", F.coalesce("__labels", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__best", F.lit(0.0)))
    return digests.join(matched, digests["row"] == matched["__row"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_sort(F.array_distinct(both)).alias("labels"),
        score.alias("score"),
        "spans",
    )


def _joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        _joined("base_labels"),
        _joined("labels"),
        "score",
    )


_PHRASE_ROWS = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES)
_TEMPLATE_ROWS = ", ".join(
    f"({i}, '{label}', {len(set(text.split()))}, '{word}')"
    for i, (text, label) in enumerate(TEMPLATES)
    for word in sorted(set(text.split()))
)
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
p AS (
  SELECT r, i, w[i + 1] AS word, w[i + 1:i + 4] AS ahead
  FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d)
),
base AS (
  SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels
  FROM p JOIN (VALUES {_PHRASE_ROWS}) AS phrase(phrase, size, label)
    ON array_to_string(ahead[1:size], ' ') = phrase
  GROUP BY r
),
t(template, label, size, word) AS (VALUES {_TEMPLATE_ROWS}),
b AS (
  SELECT DISTINCT r, unnest([i // {STRIDE}, i // {STRIDE} - 1]) AS block, word
  FROM p WHERE word IN (SELECT word FROM t)
),
hit AS (
  SELECT r, label, count(*) / any_value(CAST(size AS DOUBLE)) AS share
  FROM b JOIN t USING (word) WHERE block >= 0
  GROUP BY r, block, template, label
  HAVING {DEN} * count(*) >= {NUM} * any_value(size)
),
found AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS best FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base,
       first AS first_word, last AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []),
                                                           coalesce(found.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""

"""Token counts of a unigram model by a trie of pre-tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strophe.llm.common import load
from strophe.llm.token_tables import tokenizer_path

SPACE_MARK = "▁"
LONGEST = 16
#: Cost of a character that is no piece, against the costs of pieces.
UNKNOWN = 30.0
CACHE = 400_000


def unigram_costs(model_file: str) -> dict[str, float]:
    """Piece to cost, the negative log of a Zipf share of its rank in the vocabulary file.

    The file ranks its pieces but has no probabilities; nothing is trained. Control and byte
    pieces and pieces longer than LONGEST are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = float(np.log(len(pieces) + 1))
    return {
        p: float(np.log(rank + 1)) + total
        for rank, p in enumerate(pieces, 1)
        if len(p) <= LONGEST
    }


def trie_counts(words: list[str], costs: dict[str, float]) -> list[int]:
    """Number of pieces of the cheapest segmentation of every word.

    ``words`` are sorted, so that a walk along them is a depth-first walk of their trie: the
    forward costs of a prefix stay on a stack and are computed once for all words that share it.
    A tie goes to the longest last piece. A word's end is a terminal node; its count is kept.
    """
    best, pieces = [0.0], [0]
    out, before = [], ""
    get = costs.get
    for word in words:
        shared = len(os.path.commonprefix((before, word)))
        del best[shared + 1 :], pieces[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            lowest, count = best[end - 1] + UNKNOWN, pieces[end - 1] + 1
            for begin in range(end - 1, max(-1, end - LONGEST - 1), -1):
                cost = get(word[begin:end])
                if cost is not None and best[begin] + cost <= lowest:
                    lowest, count = best[begin] + cost, pieces[begin] + 1
            best.append(lowest)
            pieces.append(count)
        out.append(pieces[len(word)])
        before = word
    return out


_COSTS: dict[str, dict[str, float]] = {}
_COUNTS: dict[str, dict[str, int]] = {}


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words, n_tokens per row of ``docs`` (doc_id, text); no shuffle.

    Pre-tokens are the words between ASCII white space, each with a leading space mark. The
    distinct new ones of a batch go through a trie; known ones are remembered, up to a bound that
    changes only the work. Null and empty texts have 0 words; null and repeated ids are rows like
    others; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _COSTS:
            _COSTS[model_file] = unigram_costs(model_file)
        costs = _COSTS[model_file]
        known = _COUNTS.setdefault(model_file, {})
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                # bytes split at ASCII white space only
                texts = [(t.as_py() or "").encode().split() for t in part.column("text")]
                new = set().union(*texts).difference(known)
                words = sorted(SPACE_MARK + w.decode() for w in new)
                if len(known) + len(words) > CACHE:
                    known.clear()
                    words = sorted(SPACE_MARK + w.decode() for w in set().union(*texts))
                known.update(
                    zip((w[1:].encode() for w in words), trie_counts(words, costs), strict=True)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([sum(map(known.__getitem__, t)) for t in texts], pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        count, "doc_id long, n_words long, n_tokens long"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts(docs, tokenizer_path("piece_bpe_32k.model"))

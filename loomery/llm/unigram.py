"""Token counts under a unigram vocabulary, without the tokens (operator 2).

An Aho-Corasick automaton lists all vocabulary matches in a text; dynamic programming over their ends carries the best
score and the number of pieces on the best path, nothing else. Ties go as in the ``tokenizers`` library's unigram
model: of equal scores the path whose last piece starts first. A character that no piece covers alone costs the least
score less 10 and counts as its bytes (byte fallback).

No piece reaches over the start of a word mark, so the best path of a text is that of its marked words, put together;
with scores whose sums are exact in doubles (whole numbers, as in the vocabulary files here) they are counted once and
remembered, in a bounded store. Other vocabularies are counted over the whole text at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomery.llm.common import Remembered, with_made_columns

MARK = "▁"


class UnigramCounter:
    """Counts pieces of ``vocabulary`` (piece to score). ``prefix``: texts get a mark in front, if they aren't empty."""

    def __init__(self, vocabulary: dict[str, float], prefix: bool = True):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.find.add_word(piece, (len(piece), float(score)))
        self.find.make_automaton()
        self.single = frozenset(p for p in vocabulary if len(p) == 1)
        self.unknown = min(vocabulary.values()) - 10.0
        self.prefix = prefix
        self.apart = all(float(s).is_integer() for s in vocabulary.values()) and not any(MARK in p.lstrip(MARK) for p in vocabulary)
        self.known = Remembered(self.best)

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path through a marked text."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        single, unknown = self.single, self.unknown
        matches = self.find.iter(text) if n else iter(())
        end, match = next(matches, (n, None))
        for i in range(n):
            top, pieces, some = 0.0, 0, False
            while end == i:
                size, own = match
                new = score[i + 1 - size] + own
                if not some or new > top:
                    top, pieces, some = new, count[i + 1 - size] + 1, True
                end, match = next(matches, (n, None))
            c = text[i]
            if c not in single:
                new = score[i] + unknown
                if not some or new > top:
                    top, pieces, some = new, count[i] + len(c.encode("utf-8", "surrogatepass")), True
            score[i + 1], count[i + 1] = top, pieces
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text; nothing for an empty one."""
        if not text:
            return 0, 0.0
        marked = (MARK * self.prefix + text).replace(" ", MARK)
        if not self.apart:
            return self.best(marked)
        total, sum_ = 0, 0.0
        for n, score in map(self.known.__getitem__, _chunks(marked)):
            total += n
            sum_ += score
        return total, sum_


def _chunks(marked: str) -> Iterator[str]:
    """Pieces of a text that start with their marks."""
    first, *rest = marked.split(MARK)
    if first:
        yield first
    marks = 0
    for part in rest:
        marks += 1
        if part:
            yield MARK * marks + part
            marks = 0
    if marks:
        yield MARK * marks


def read_vocabulary(model_path: str) -> dict[str, float]:
    """Ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in plain}


_COUNTERS: dict[str, UnigramCounter] = {}


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Add ``n_tokens`` (long) and ``path_score`` (double) to ``docs``. Null text counts as empty: 0 and 0.

    ``model_path``: a sentencepiece file whose pieces and scores are taken as a unigram vocabulary. One row out for each
    row in, repeated rows too; columns of these names are replaced, others kept; no rows: no rows. Texts of any length
    are counted whole, in one pass over them.
    """

    def tool() -> UnigramCounter:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = UnigramCounter(read_vocabulary(model_path))
        return _COUNTERS[model_path]

    def made(counter: UnigramCounter, texts: list[str | None]) -> dict:
        found = [counter.count(x or "") for x in texts]
        return {"n_tokens": pa.array([n for n, _ in found], pa.int64()), "path_score": pa.array([s for _, s in found], pa.float64())}

    return with_made_columns(docs, "text", {"n_tokens": "bigint", "path_score": "double"}, tool, made)


def op2_token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """Token counts of all ``documents``."""
    return count_tokens(docs.select("doc_id", "text"), model_path).select("doc_id", "n_tokens", "path_score")

"""Count-only Viterbi for a unigram vocabulary.

Pieces and scores come from a SentencePiece file (a parameter).  A text is
segmented as a unigram tokenizer does that marks spaces with U+2581 and cuts
before each mark: segments are scored alone, so a segment that recurs is solved
once a task (a bounded cache).  In a segment an Aho-Corasick automaton lists all
vocabulary matches; dynamic programming over end positions carries the best
score and the number of pieces on that path, and no back pointers, since only
the count is wanted.

Tie rules of the tokenizer, kept exactly: path scores are sums of doubles from
the left; a later candidate replaces the best only if it scores strictly more,
and candidates come by ascending start, so the longest last piece wins a tie.
A character that no single-character piece covers offers the unknown piece at
the lowest score minus 10; unknown pieces in a row count as one.

Defined results: null and empty texts count 0.  Repeated rows count alike.  An
empty table gives an empty result.  Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import functools
import math

import ahocorasick
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.llm.text import append_columns
from plumbline.staging import table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Fixed value: how far the unknown piece scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Segments a task remembers, and the longest it does.
CACHE = 1_000_000
CACHE_LENGTH = 64


@functools.lru_cache(maxsize=2)
def counter(path: str) -> "Counter":
    """One for each worker process, so that its cache outlives a task."""
    return Counter(*vocabulary(path))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, and the id of the unknown piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    """Counts pieces of texts; one for each task."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        self.automaton = ahocorasick.Automaton()
        # a piece that is listed twice has the score of its last entry
        for piece, (score, at) in {p: (s, i) for i, (p, s) in enumerate(pieces)}.items():
            self.automaton.add_word(piece, (len(piece), score, at == unknown))
        self.automaton.make_automaton()
        self.matches = self.automaton.iter
        self.singles = {p for i, (p, _) in enumerate(pieces) if len(p) == 1 and i != unknown}
        self.unknown_piece = pieces[unknown][0]
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Pieces on the best path.  Matches come by end, and for one end by falling length."""
        if not self.singles.issuperset(text) or self.unknown_piece in text:
            return self.segment_with_unknown(text)
        n = len(text)
        score = [-math.inf] * n + [0.0]  # at -1, before the first character: 0
        count = [0] * (n + 1)
        for last, (size, s, _) in self.matches(text):
            found = score[last - size] + s
            if found > score[last]:
                score[last] = found
                count[last] = count[last - size] + 1
        return count[n - 1]

    def segment_with_unknown(self, text: str) -> int:
        n = len(text)
        score: list = [None] * (n + 1)
        score[0] = 0.0
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        offer = self.unknown_score
        at, length = 1, 0  # the end in work, and the length of its last match

        def no_single(end: int) -> None:
            found = offer + score[end - 1]
            if score[end] is None or found > score[end]:
                score[end] = found
                unknown[end] = True
                count[end] = count[end - 1] + (not unknown[end - 1])

        for last, (size, s, is_unknown) in self.matches(text):
            end = last + 1
            if end != at:
                if length != 1:
                    no_single(at)
                for skipped in range(at + 1, end):
                    no_single(skipped)
                at = end
            length = size
            start = end - size
            found = score[start] + s
            best = score[end]
            if best is None or found > best:
                score[end] = found
                unknown[end] = is_unknown
                count[end] = count[start] + (not (is_unknown and unknown[start]))
        if n:
            if length != 1:
                no_single(at)
            for skipped in range(at + 1, n + 1):
                no_single(skipped)
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = text.replace(" ", MARK)
        if not parts.startswith(MARK):
            parts = MARK + parts
        total, cache = 0, self.cache
        for part in parts.split(MARK)[1:]:
            found = cache.get(part)
            if found is None:
                found = self.segment(MARK + part)
                if len(part) <= CACHE_LENGTH:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[part] = found
            total += found
        return total


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_chars_counted, n_tokens)`` for each row of ``docs(doc_id, text)``."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        count = counter(path)
        return lambda texts: [[len(x or "") for x in texts], [count(x) for x in texts]]

    fields = {"n_chars_counted": T.LongType(), "n_tokens": T.LongType()}
    return append_columns(docs.select("doc_id", "text"), "text", fields, make).drop("text")


def op6_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

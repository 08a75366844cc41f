"""Quality rules: base limits and a learned decision list.

Word and line statistics of every whole text are measured in Arrow batches.
A decision list is learned by sequential covering from labelled rows: a rule
(a conjunction of at most ``MOST_TERMS`` thresholds) is grown on one part of
the labelled rows by FOIL gain, pruned from its end on the other part, given a
margin, and taken if it is precise enough; the rows it covers are set aside
and the next rule is grown.  Rows that fail the base limits teach nothing.  The list is emitted as one ordered conditional expression,
so applying it is plain column arithmetic.

The learner sees at most ``SAMPLE`` labelled rows, those with the smallest
hash of their id (a fixed bound, whatever the table's size); measuring and
applying the list cover all rows.

Defined results: a null text has no words, so it fails the base limits.  Labels
that are null or whose document is missing are left out, and with no usable
labels the list is empty and keeps what passes the base limits.  Repeated rows
are judged alike.  An empty table gives an empty result.  Other columns pass
through ``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.text import append_columns, fresh, words_of
from plumbline.staging import table

#: Fixed values of the base limits.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: Bound of the labelled rows that the learner sees.
SAMPLE = 20000
MOST_RULES = 12
MOST_TRIES = 30
MOST_TERMS = 4
LEAST_PRECISION = 0.98
#: A good document that a rule would reject weighs as many bad ones that it would let pass.
GOOD_WEIGHT = 5
#: Share of the bad rows a rule covers that its thresholds give up for a margin.
TRIM = 0.02
LEAST_COVER = 8

_UPPER = bytes(range(65, 91))
_has_word = re.compile(r"[^\x20\x09-\x0D]").search
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct")


def repeated_words(words: list[str], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    span = n - window + 1
    if len(number) ** window < 1 << 63:
        key = np.zeros(span, np.int64)
        for i in range(window):
            key = key * len(number) + ids[i : i + span]
    else:  # too many for one word: number the windows by their prefixes
        key = ids[:span]
        for i in range(1, window):
            key = np.unique(key * len(number) + ids[i : i + span], return_inverse=True)[1]
    ranked = np.sort(key)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    hit = np.nonzero(np.isin(key, twice))[0]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The ``MEASURES`` of one text."""
    text = text or ""
    words = words_of(text)
    raw = text.encode()
    if "\n" in text:
        lines = [x for x in text.split("\n") if _has_word(x)]
        n_lines, dup = len(lines), len(lines) - len(set(lines))
    else:
        n_lines, dup = int(bool(words)), 0
    symbols, upper = (len(raw) - len(raw.translate(None, x)) for x in (SYMBOLS, _UPPER))
    return len(words), sum(map(len, words)), symbols, dup, repeated_words(words), n_lines, upper, len(set(words))


def measured(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a column for each measure; also the columns' names, which avoid those in ``docs``."""
    names = {m: fresh(m, docs.columns) for m in MEASURES}
    fields = {n: T.LongType() for n in names.values()}
    return append_columns(docs, "text", fields, lambda: lambda texts: list(zip(*map(measure, texts), strict=True)) or [[]] * len(MEASURES)), names


def features(name: dict[str, str]) -> dict[str, Column]:
    """What the rules may test, as columns over the measures."""
    c = {k: F.col(v).cast("double") for k, v in name.items()}
    words = F.greatest(c["n_words"], F.lit(1.0))
    return {
        "words": c["n_words"],
        "word_length": c["word_chars"] / words,
        "symbols_per_word": c["n_symbols"] / words,
        "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
        "repeat_share": c["n_repeat_words"] / words,
        "upper_per_word": c["n_upper"] / words,
        "distinct_share": c["n_distinct"] / words,
    }


def base_failed(name: dict[str, str]) -> Column:
    words, repeat = F.col(name["n_words"]), F.col(name["n_repeat_words"])
    return (words < LEAST_WORDS) | (100 * repeat > MOST_REPEAT_PERCENT * words)


@dataclass(frozen=True)
class Rule:
    """Reject where every ``(feature, is_least, threshold)`` holds."""

    terms: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        found = np.ones(len(next(iter(x.values()))), bool)
        for f, least, at in self.terms:
            found &= (x[f] >= at) if least else (x[f] <= at)
        return found

    def column(self, of: dict[str, Column]) -> Column:
        found = F.lit(True)
        for f, least, at in self.terms:
            found = found & ((of[f] >= at) if least else (of[f] <= at))
        return found


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.nan_to_num(g, nan=-1.0, neginf=-1.0)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[tuple[str, bool, float]]:
    inside, terms = np.ones(len(bad), bool), []
    while len(terms) < MOST_TERMS and (~bad[inside]).any():
        best = (1e-9, None)
        p0, n0 = bad[inside].sum(), GOOD_WEIGHT * (~bad[inside]).sum()
        for f, v in x.items():
            order = np.argsort(v[inside], kind="stable")
            value, hit = v[inside][order], bad[inside][order]
            up = np.nonzero(np.diff(value) > 0)[0]  # a threshold lies between different values
            if not len(up):
                continue
            p, n = np.cumsum(hit)[up], GOOD_WEIGHT * np.cumsum(~hit)[up]
            middle = (value[up] + value[up + 1]) / 2
            for least, g in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), (f, least, float(middle[k])))
        if best[1] is None:
            break
        terms.append(best[1])
        f, least, at = best[1]
        inside &= (x[f] >= at) if least else (x[f] <= at)
        if not bad[inside].any():
            break
    return terms


def _tighten(rule_terms: tuple, x: dict[str, np.ndarray], covered: np.ndarray) -> tuple:
    """Move each threshold to where all but ``TRIM`` of the covered bad rows lie, away from the good ones."""
    found = []
    for f, least, at in rule_terms:
        v = np.quantile(x[f][covered], TRIM if least else 1 - TRIM, method="higher" if least else "lower")
        found.append((f, least, float(max(at, v) if least else min(at, v))))
    return tuple(found)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray) -> list[Rule]:
    """Rules for ``bad`` rows; rows with ``held`` prune, the others grow."""
    left, growing, rules = np.ones(len(bad), bool), ~held, []
    for _ in range(MOST_TRIES):
        if len(rules) == MOST_RULES or not (bad & growing).any():
            break
        terms = _grow({f: v[growing] for f, v in x.items()}, bad[growing])
        if not terms:
            break
        best = None
        for k in range(len(terms), 0, -1):
            hit = Rule(tuple(terms[:k]), 0.0, 0).holds(x) & left
            p, n = (hit & held & bad).sum(), GOOD_WEIGHT * (hit & held & ~bad).sum()
            worth = (p - n) / max(p + n, 1)
            if best is None or worth >= best[0]:
                best = (worth, terms[:k], hit)
        terms = tuple(best[1])
        growing = growing & ~best[2]
        if not (best[2] & bad).any():
            continue
        terms = _tighten(terms, x, best[2] & bad)
        hit = Rule(terms, 0.0, 0).holds(x) & left
        rule = Rule(terms, float((hit & bad).sum() / max(hit.sum(), 1)), int(hit.sum()))
        if rule.precision >= LEAST_PRECISION and rule.covered >= LEAST_COVER:
            rules.append(rule)
            left &= ~hit
    return rules


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most ``sample`` labelled documents."""
    spark = docs.sparkSession
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = picked.select(F.col("doc_id").alias("of"), "quality", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"))
    some = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("of"))  # at most `sample` rows
    rows, name = measured(some)
    rows = rows.where(~base_failed(name))  # what the base limits reject needs no rule
    of = features(name)
    found = rows.groupBy("of").agg(F.first("quality").alias("quality"), F.first("held").alias("held"), *(F.max(v).alias(k) for k, v in of.items()))
    got = found.orderBy("of").limit(sample).toPandas()
    x = {k: got[k].to_numpy(float) for k in of}
    if not len(got):
        return []
    return learn(x, (got["quality"] == 0).to_numpy(), got["held"].to_numpy(bool))


def verdict(rules: list[Rule], name: dict[str, str]) -> Column:
    """True where no rule rejects: an ordered conditional expression."""
    of, found = features(name), F
    for rule in rules:
        found = found.when(rule.column(of), F.lit(False))
    return found.otherwise(F.lit(True)) if rules else F.lit(True)


def judged(docs: DataFrame, rules: list[Rule]) -> tuple[DataFrame, dict[str, str], Column, Column]:
    rows, name = measured(docs)
    failed = base_failed(name)
    return rows, name, failed, ~failed & verdict(rules, name)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the base limits and the learned list."""
    rows, _, _, kept = judged(docs, train(docs, labels))
    return rows.where(kept).select(docs.columns)


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = train(docs, table(spark, sf_dir, "labels"))
    rows, name, failed, kept = judged(docs.select("doc_id", "text"), rules)
    return rows.select("doc_id", *(F.col(name[m]).alias(m) for m in MEASURES[:5]), failed.alias("base_failed"), kept.alias("kept"))

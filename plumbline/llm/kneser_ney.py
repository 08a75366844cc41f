"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters as they are (n-grams of ``ORDER`` code points, the
first preceded by edges, one edge at the end), so its tables grow with the
trusted text and keep every script apart.

1. N-grams are counted in tasks: how often trusted text holds each, and how
   often any text does.  Texts whose id cannot be trusted, by a bitmap of fixed size,
   stay where they are; only the others move, once, to meet the trusted ids.
2. Sharded joins on n-grams make the model: discounts come from counts of
   counts; each n-gram joins its context's totals and its suffix's lower-order
   probability; lower orders count distinct left extensions.  N-grams that
   trusted text lacks back off along joins.  What comes out is a table of the
   log probability of every n-gram that any document holds.
3. The ``CACHE`` n-grams that documents hold most often are broadcast (that is
   the bound).  Texts are scored where they lie; only occurrences of the others
   are written out, joined to the table, and summed by word, passage and
   document.  None of these is hot: each is rarer than all in the cache.
4. A document has three measures, in natural logarithms a character: its mean
   (whose exponential is the perplexity), its worst passage (``PASSAGE`` words)
   and its worst word.  Each has a limit for each language, a quantile of trusted
   documents that the model was not fitted on (one in ``HELD_OUT``).  A document
   above any limit goes; the three share the ``1 - QUANTILE`` that may go in error.

Trusted are the documents labelled good and not toxic in every label they have.

Defined results: null and empty texts score as one end of text; a null language
is a language of its own, and a language without held-out trusted text takes
the limits over all.  Where fewer than ``FEW`` texts make a limit it is at least
their tolerance limit: the mean and ``SPREAD * (1 + 2 / sqrt(n))`` standard deviations.  With no trusted text held out
the fitted texts make the limits; with none at all everything is kept and the
model is uniform.  A text without a passage of ``PASSAGE_LEAST`` characters (or a
word of ``WORD_LEAST``) has no worst one.  Repeated rows score alike.  U+10FFFF in
a text reads as an edge.  N-grams in the cache are told apart by 64-bit hashes.
An empty table gives an empty result.  Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import BITMAP_BITS, _bitmap
from plumbline.llm.text import append_columns
from plumbline.operators.ranks import percentile
from plumbline.staging import staged, table

ORDER = 4
QUANTILE = 0.995
HELD_OUT = 5
FEW, SPREAD = 1200, 3.0
CACHE = 1 << 19
#: Slots of each of the two tables that hold the cache.
SLOTS = 1 << 20
PASSAGE, PASSAGE_LEAST, WORD_LEAST = 8, 20, 5
#: Discounts used where counts of counts leave them undefined.
DISCOUNTS = (0.5, 0.75, 0.9)
#: Characters that one step of a task handles, and distinct n-grams that it holds before it hands them on.
STEP = 1 << 20
HELD = 1 << 21
EDGE = 0x10FFFF
#: Every code point, and the edge in the place of the last.
UNIFORM = 1.0 / 0x110000
MEASURES = ("mean", "passage", "word")


class Grams:
    """All n-grams of some texts, one after the other: ``len(text) + 1`` a text."""

    def __init__(self, texts: list, order: int = ORDER):
        self.order = order
        self.sizes = np.array([len(t or "") for t in texts], np.int64) + 1
        points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
        place = np.arange(len(points)) + np.repeat(np.arange(len(texts)) * order + order - 1, self.sizes - 1)
        self.points = np.full(int((self.sizes + order - 1).sum()), EDGE, np.uint32)
        self.points[place] = points
        #: where each n-gram ends in ``points``
        self.at = np.arange(int(self.sizes.sum())) + np.repeat((np.arange(len(texts)) + 1) * (order - 1), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        self.blank = np.zeros(len(self.points), bool)
        self.blank[place] = blank

    def hashes(self) -> np.ndarray:
        return hashed(np.stack([self.points[self.at - k] for k in range(self.order - 1, -1, -1)], axis=1)) if len(self.at) else np.zeros(0, np.uint64)

    def strings(self, which: np.ndarray) -> list[str]:
        rows = np.stack([self.points[self.at[which] - k] for k in range(self.order - 1, -1, -1)], axis=1)
        flat = rows.tobytes().decode("utf-32-le")
        return [flat[i : i + self.order] for i in range(0, len(flat), self.order)]


def hashed(points: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points."""
    acc = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        acc = (acc ^ (points[:, k] + np.uint64(77))) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc


def _steps(texts: list) -> Iterator[tuple[int, list]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + ORDER
        if size > STEP:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs(text, fits boolean)`` -> ``(gram, c, seen)``: occurrences in texts that the model fits, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged() -> tuple:
            code, fits, seen = (np.concatenate([h[i] for h in held]) for i in range(3))
            names = np.concatenate([h[3] for h in held])
            code, first, of = np.unique(code, return_index=True, return_inverse=True)
            return code, np.bincount(of, fits, len(code)).astype(np.int64), np.bincount(of, seen, len(code)).astype(np.int64), names[first]

        def rows(part: tuple) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(part[0]), 1 << 16):
                cut = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(part[3][cut], pa.string()), pa.array(part[1][cut]), pa.array(part[2][cut])], names=["gram", "c", "seen"])

        for batch in batches:
            marks = np.array(batch.column("fits").to_pylist(), bool)
            for begin, part in _steps(batch.column("text").to_pylist()):
                grams = Grams(part, order)
                code, first, of = np.unique(grams.hashes(), return_index=True, return_inverse=True)
                fits = np.repeat(marks[begin : begin + len(part)], grams.sizes)
                held.append((code, np.bincount(of, fits, len(code)), np.bincount(of, minlength=len(code)), np.array(grams.strings(first), object)))
                size += len(code)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from rows(held[0])
                        held, size = [], 0
        if held:
            yield from rows(merged())

    found = docs.select("text", "fits").mapInArrow(run, "gram string, c long, seen long")
    return found.groupBy("gram").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def discounts(seen: DataFrame) -> tuple[float, float, float]:
    row = seen.agg(*(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5))).first()
    n1, n2, n3, n4 = (row[f"n{i}"] for i in range(1, 5))
    if not (n1 and n2 and n3):
        return DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 < d < i + 1 for i, d in enumerate(found)) else DISCOUNTS


def fit(top: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """``top(gram, c)`` of the highest order -> for each order, ``(gram, p)`` and ``(context, gamma)``."""
    levels = {order: top}
    for k in range(order, 1, -1):
        levels[k - 1] = staged(levels[k].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c")), "grams")
    found: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(levels[k])
        c = F.col("c")
        lost = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        seen = levels[k].withColumn("context", F.expr(f"left(gram, {k - 1})")).withColumn("lost", lost)
        contexts = staged(seen.groupBy("context").agg(F.sum("c").alias("total"), F.sum("lost").alias("given")), "contexts")
        rows = seen.join(contexts, "context")
        below: Column = F.lit(UNIFORM)
        if found:
            lower = found[-1][0].withColumnsRenamed({"gram": "suffix", "p": "below"})
            rows, below = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower, "suffix"), F.col("below")
        p = (c - F.col("lost")) / F.col("total") + F.col("given") / F.col("total") * below
        found.append((staged(rows.select("gram", p.alias("p")), "model"), contexts.select("context", (F.col("given") / F.col("total")).alias("gamma"))))
    return found


def log_probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``(gram, lp)`` of every row of ``grams(gram, ...)``: natural logarithms, backed off where unseen."""
    rows = grams.select("gram", F.col("gram").alias("rest"), F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("lp"))
    for k in range(len(model), 0, -1):
        known, contexts = model[k - 1]
        # characters are at most as many as code points, so these are bounded; their keys are hot
        known, contexts = F.broadcast(known) if k == 1 else known, F.broadcast(contexts) if k <= 2 else contexts
        rows = rows.join(known.withColumnRenamed("gram", "rest"), "rest", "left")
        rows = rows.withColumn("lp", F.coalesce("lp", F.col("weight") + F.ln("p"))).drop("p")
        rows = rows.withColumn("context", F.expr(f"left(rest, {k - 1})")).join(contexts, "context", "left")
        weight = F.when(F.col("lp").isNull(), F.col("weight") + F.coalesce(F.ln("gamma"), F.lit(0.0))).otherwise(F.col("weight"))
        rows = rows.select("gram", F.expr("substring(rest, 2)").alias("rest"), weight.alias("weight"), "lp")
    return rows.select("gram", F.coalesce("lp", F.col("weight") + float(np.log(UNIFORM))).alias("lp"))


class Cache:
    """Log probabilities by hash in two tables; what has no slot there counts as not held."""

    def __init__(self, grams: list[str], lp: np.ndarray, slots: int = SLOTS):
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), -1) if grams else np.zeros((0, ORDER), np.uint32)
        keys, self.tables = hashed(points), []
        left = np.arange(len(keys))
        for shift in (0, 32):  # the most frequent come first, and take their slot
            held, values, used = np.zeros(slots, np.uint64), np.zeros(slots), np.zeros(slots, bool)
            slot, first = np.unique((keys[left] >> np.uint64(shift)) & np.uint64(slots - 1), return_index=True)
            slot = slot.astype(np.int64)
            held[slot], values[slot], used[slot] = keys[left[first]], lp[left[first]], True
            held[~used] = ~(np.nonzero(~used)[0].astype(np.uint64) << np.uint64(shift))  # a key that does not belong there
            self.tables.append((shift, held, values))
            left = np.delete(left, first)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are held."""
        found, hit = np.zeros(len(keys)), np.zeros(len(keys), bool)
        for shift, held, values in self.tables:
            slot = ((keys >> np.uint64(shift)) & np.uint64(len(held) - 1)).astype(np.int64)
            here = held[slot] == keys
            found[here], hit = values[slot[here]], hit | here
        return found, hit


_PART = [("unit", T.IntegerType()), ("passage", T.IntegerType()), ("unit_sum", T.DoubleType()), ("unit_size", T.IntegerType()), ("passage_sum", T.DoubleType()), ("passage_size", T.IntegerType()), ("gram", T.StringType())]
_PARTS = T.ArrayType(T.StructType([T.StructField(*x) for x in _PART]))


def score(texts: list, cache: Cache) -> tuple[list, list, list, list, list]:
    """``(sum, worst passage, worst word, size, parts)`` of each text; parts are the occurrences that the cache lacks.

    The sum leaves these out, and the worst ones the passages and words that hold them.
    """
    grams = Grams(texts)
    if not len(texts):
        return [], [], [], [], []
    lp, hit = cache(grams.hashes())
    n = len(lp)
    last = np.zeros(n, bool)
    last[grams.starts + grams.sizes - 1] = True
    ends = np.nonzero(last | grams.blank[grams.at])[0]
    begins = np.concatenate(([0], ends[:-1] + 1))
    first_unit = np.searchsorted(begins, grams.starts)
    units = np.diff(np.append(first_unit, len(begins)))
    unit_no = np.arange(len(begins)) - np.repeat(first_unit, units)
    u_sum, u_size, u_miss = np.add.reduceat(lp, begins), ends - begins + 1, np.logical_or.reduceat(~hit, begins)
    p_begin = np.nonzero(unit_no % PASSAGE == 0)[0]
    p_sum, p_size, p_miss = np.add.reduceat(u_sum, p_begin), np.add.reduceat(u_size, p_begin), np.logical_or.reduceat(u_miss, p_begin)
    word = np.maximum.reduceat(np.where(u_miss | (u_size < WORD_LEAST), -np.inf, -u_sum / u_size), first_unit)
    passage = np.maximum.reduceat(np.where(p_miss | (p_size < PASSAGE_LEAST), -np.inf, -p_sum / p_size), np.searchsorted(p_begin, first_unit))
    total = np.add.reduceat(lp, grams.starts)
    lost = np.nonzero(~hit)[0]
    of_unit = np.searchsorted(ends, lost)
    of_passage = np.searchsorted(p_begin, of_unit, side="right") - 1
    of_text = np.searchsorted(grams.starts, lost, side="right") - 1
    names = grams.strings(lost) if len(lost) else []
    fields = (unit_no[of_unit].tolist(), (unit_no[of_unit] // PASSAGE).tolist(), u_sum[of_unit].tolist(), u_size[of_unit].tolist(), p_sum[of_passage].tolist(), p_size[of_passage].tolist(), names)
    keys = ("unit", "passage", "unit_sum", "unit_size", "passage_sum", "passage_size", "gram")
    rows = [dict(zip(keys, x, strict=True)) for x in zip(*fields, strict=True)]
    cut = np.searchsorted(of_text, np.arange(len(texts) + 1)).tolist()
    finite = lambda x: [v if np.isfinite(v) else None for v in x.tolist()]
    return total.tolist(), finite(passage), finite(word), grams.sizes.tolist(), [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def measured(docs: DataFrame, lps: DataFrame, cache: Cache) -> DataFrame:
    """``docs`` without its text, with ``mean``, ``passage`` and ``word``: see the module."""
    held = docs.sparkSession.sparkContext.broadcast(cache)  # at most CACHE n-grams in tables of fixed size

    def make():
        key = TaskContext.get().partitionId() << 36

        def work(texts: list) -> list:
            nonlocal key
            out: list[list] = [[], [], [], [], []]
            for _, part in _steps(texts):
                for column, found in zip(out, score(part, held.value), strict=True):
                    column += found
            key += len(texts)
            return [list(range(key - len(texts), key)), *out]

        return work

    fields = {"row_key": T.LongType(), "total": T.DoubleType(), "passage": T.DoubleType(), "word": T.DoubleType(), "size": T.LongType(), "parts": _PARTS}
    rows = staged(append_columns(docs, "text", fields, make).drop("text"), "scored")
    parts = rows.where(F.size("parts") > 0).select("row_key", F.explode("parts").alias("x")).select("row_key", "x.*").join(lps, "gram")
    first = [F.first(c).alias(c) for c in ("unit_sum", "unit_size", "passage_sum", "passage_size")]
    units = parts.repartition("row_key").groupBy("row_key", "passage", "unit").agg(F.sum("lp").alias("lp"), *first)
    word = F.when(F.col("unit_size") >= WORD_LEAST, -(F.col("unit_sum") + F.col("lp")) / F.col("unit_size"))
    passages = units.groupBy("row_key", "passage").agg(F.sum("lp").alias("lp"), *first[2:], F.max(word).alias("word"))
    passage = F.when(F.col("passage_size") >= PASSAGE_LEAST, -(F.col("passage_sum") + F.col("lp")) / F.col("passage_size"))
    late = passages.groupBy("row_key").agg(F.sum("lp").alias("more"), F.max(passage).alias("late_passage"), F.max("word").alias("late_word"))
    mean = -(F.col("total") + F.coalesce("more", F.lit(0.0))) / F.col("size")
    worst = [F.greatest(m, f"late_{m}").alias(m) for m in ("passage", "word")]
    kept = [c for c in docs.columns if c != "text"]
    return rows.drop("parts").join(late, "row_key", "left").select(*kept, mean.alias("mean"), *worst)


def _perhaps(docs: DataFrame, ids: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be one of ``ids``: all that are, and few others while the bitmap is sparse."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(ids.select(F.xxhash64("doc_id").alias("k1")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = (batch.column("_key").to_numpy() & (bits - 1)).view(np.uint64)
            hit = (held.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            kept = batch.filter(pa.array(hit.astype(bool)))
            yield pa.RecordBatch.from_arrays(kept.columns[1:], names=kept.schema.names[1:])

    return docs.select(F.xxhash64("doc_id").alias("_key"), *docs.columns).mapInArrow(run, docs.schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return good.where("q = 1 and t = 0").select("doc_id")


def limits(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(key, mean, passage, word)``: the limits of each language's key and, under a null key, over all."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES))).alias("x")
    rows = scored.select("key", values)
    rows = rows.select(F.explode(F.array(F.col("key"), F.lit(None).cast("string"))).alias("key"), "x.measure", "x.value").where("value is not null")
    rows = staged(rows.withColumn("group", F.concat_ws("|", "measure", F.coalesce("key", F.lit("*")))), "held-out")
    found = percentile(rows, ["group"], "value", 1 - (1 - quantile) / len(MEASURES), "limit", buckets=max(64, rows.count() // 100_000))
    spread = rows.groupBy("group", "measure", "key").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.stddev("value"), F.lit(0.0)).alias("s"))
    limit = F.when(F.col("n") < FEW, F.greatest("limit", F.col("m") + SPREAD * (1 + 2 / F.sqrt("n")) * F.col("s"))).otherwise(F.col("limit"))
    return spread.join(found, "group").groupBy("key").pivot("measure", list(MEASURES)).agg(F.first(limit))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(doc_id, lang, perplexity, passage, word, threshold, kept)`` for each row of ``docs(doc_id, lang, text)``.

    ``threshold`` is the limit of the perplexity; those of passages and words are in ``passage_limit`` and ``word_limit``.
    """
    trusted = trusted_ids(labels).withColumn("fits", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) > 0)
    docs = docs.select("doc_id", "lang", "text")
    # the hint keeps one plan at every size; fitted texts are counted again with all, which only moves them forward in the cache
    fits = trusted.where("fits")
    fitted = _perhaps(docs, fits).join(fits.hint("merge"), "doc_id", "left_semi")
    grams = staged(counts(docs.select("text", F.lit(False).alias("fits")).unionByName(fitted.select("text", F.lit(True).alias("fits")))), "grams")
    model = fit(grams.where("c > 0").select("gram", "c"))
    lps = staged(log_probabilities(grams, model), "log-probabilities")
    often = grams.orderBy(F.desc("seen"), "gram").limit(CACHE).select("gram", "seen").join(lps, "gram").orderBy(F.desc("seen"), "gram").select("gram", "lp").toArrow()
    cache = Cache(often.column("gram").to_pylist(), often.column("lp").to_numpy())
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    scored = staged(measured(docs, lps, cache).join(trusted, "doc_id", "left").withColumn("key", key), "measured")
    held = scored.where("not fits")
    limit = staged(limits(held if not held.isEmpty() else scored.where("fits"), quantile), "limits")
    overall = limit.where("key is null").first()
    by_lang = limit.where("key is not null").select("key", *(F.col(m).alias(f"{m}_limit") for m in MEASURES))  # one row a language
    rows = scored.join(by_lang, "key", "left")
    above: Column = F.lit(False)
    for m in MEASURES:
        cut = F.coalesce(f"{m}_limit", F.lit(overall[m] if overall else None).cast("double"))
        rows = rows.withColumn(f"{m}_limit", cut)
        above = above | F.coalesce(F.col(m) > F.col(f"{m}_limit"), F.lit(False))
    return rows.select("doc_id", "lang", F.exp("mean").alias("perplexity"), "passage", "word", F.exp("mean_limit").alias("threshold"), "passage_limit", "word_limit", (~above).alias("kept"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Training time runs from 0 to 1.  A source's share of the stream at time ``t``
follows a weight schedule; the schedule's integral over the whole run is the
source's target in words, and the integral up to ``t`` its cumulative demand.
Schedules are linear, ``target * (1 + slope * (2 t - 1))`` with ``|slope| < 1``,
so cumulative demand is ``target * (t + slope * (t * t - t))`` and is inverted in
closed form: a document copy whose midpoint lies ``c`` words into its source's
sequence gets the position ``t`` at which the demand reaches ``c``.  Documents
are then range-sorted by position, so no task ever holds a whole source.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share the total size; a target stops at 3 times its source's size and the
excess is shared again by weight.  That fixed point is found directly: in
order of ``cap / weight`` a source is capped exactly if the level reached
without its predecessors exceeds its own ratio.

Each source repeats its documents in a fixed pseudo-random order (MD5 of the
id) until its target is met: copy ``e`` of a document that starts ``b`` words
into the order is taken if its midpoint ``e * source_size + b + size / 2`` lies
within the target, so a source's words differ from its target by at most half
of its longest document.  Targets are at most 3 source sizes, hence at most 3
copies.  Prefix sums run in bins (first three hex digits of the MD5), and bin
totals carry them over, so a hot source is spread over 4096 bins.

Defined results: null texts have no words.  A document without words is taken
once or not at all by the same midpoint rule and counts nothing.  Repeated rows
with one id and size are interchangeable.  An empty table gives an empty
result.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.text import fresh, word_count
from plumbline.staging import staged, table

#: Weights by rank of the source, and the most a source is repeated.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Slopes of the weight schedules by rank of the source: early, even and late sources.
SLOPES = (-0.5, 0.0, 0.5)


def _by_rank(rank: Column, values: tuple) -> Column:
    at = F.pmod(rank - 1, F.lit(len(values)))
    return reduce(lambda rest, i: F.when(at == i, F.lit(values[i])).otherwise(rest), range(len(values) - 1), F.lit(values[-1]))


def _key(source: Column) -> Column:
    """A join key that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, slopes: tuple = SLOPES) -> DataFrame:
    """``sizes(key, source_size)`` -> also ``rank, weight, slope, target``.  One row a source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("key")))
    ranked = ranked.select(
        "key", "source_size", "rank", _by_rank(F.col("rank"), weights).cast("double").alias("weight"), _by_rank(F.col("rank"), slopes).alias("slope")
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = (F.col("source_size") * most).cast("double")
    ranked = ranked.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    ranked = ranked.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.col("rest") / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    # the level settles at the first source that is not capped
    settled = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(all_rows)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * settled)
    return ranked.select("key", "source_size", "rank", "weight", "slope", target.alias("target"))


def position(words_before: Column, target: Column, slope: Column) -> Column:
    """Time at which cumulative demand reaches ``words_before``."""
    share = F.when(target > 0, words_before / target).otherwise(F.lit(0.0))
    bent = ((slope - 1) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / F.nullif(2 * slope, F.lit(0.0))
    return F.coalesce(bent, share)


def _identity(docs: DataFrame) -> Column:
    """What tells rows with one doc_id apart; rows alike in it are interchangeable."""
    return F.xxhash64(docs["doc_id"], docs["text"], docs["source"])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, slopes: tuple = SLOPES) -> DataFrame:
    """``(doc_id, identity, source, size, source_size, target, positions, copies)`` for each row of ``docs``.

    ``positions`` holds the training position of each copy taken.
    """
    mark = F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", _identity(docs).alias("identity"), "source", _key(docs["source"]).alias("key"), word_count(docs["text"]).alias("size"), mark.alias("mark"))
    rows = staged(rows.withColumn("bin", F.substring("mark", 1, 3)), "mix-rows")
    bins = rows.groupBy("key", "bin").agg(F.sum("size").alias("bin_size"))
    earlier = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = staged(bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0))), "mix-bins")
    aims = targets(bins.groupBy("key").agg(F.sum("bin_size").alias("source_size")), weights, most, slopes)
    bins = bins.join(aims, "key").select("key", "bin", "bin_start", "source_size", "slope", "target")
    inside = Window.partitionBy("key", "bin").orderBy("mark", "size", "identity").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    middle = F.col("bin_start") + F.col("start") + F.col("size") / 2
    at = [
        F.when(middle + e * F.col("source_size") <= F.col("target"), position(middle + e * F.col("source_size"), F.col("target"), F.col("slope")))
        for e in range(most)
    ]
    placed = rows.join(bins, ["key", "bin"]).withColumn("positions", F.array_compact(F.array(*at)))
    return placed.select("doc_id", "identity", "source", "size", "source_size", "target", "positions", F.size("positions").alias("copies"))


def training_order(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, once for each copy taken, range-sorted into the order of training."""
    of, key, lists, nth, at = (fresh(n, docs.columns) for n in ("mix_id", "identity", "lists", "nth", "position"))
    found = mix(docs).groupBy(F.col("doc_id").alias(of), F.col("identity").alias(key)).agg(F.sort_array(F.collect_list("positions")).alias(lists))
    rows = docs.join(found, docs["doc_id"].eqNullSafe(F.col(of)) & (_identity(docs) == F.col(key)))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(of, key).orderBy(F.lit(1))))  # rows alike share their lists out
    rows = rows.select(*docs.columns, F.explode(F.get(lists, F.col(nth) - 1)).alias(at))
    return rows.orderBy(at, "doc_id").select(docs.columns)


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0))
    rows = found.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.round(first, 6).alias("position")
    )
    return rows.orderBy("position", "doc_id")


ORACLE_SQL = r"""
WITH r AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5(coalesce(cast(doc_id AS varchar), '')) AS mark,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size
  FROM documents),
s AS (SELECT k, sum(size)::bigint AS source_size FROM r GROUP BY k),
w AS (SELECT k, source_size, row_number() OVER (ORDER BY k) AS rank FROM s),
v AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight,
    CASE (rank - 1) % 3 WHEN 0 THEN -0.5::double WHEN 1 THEN 0.0::double ELSE 0.5::double END AS slope, (3 * source_size)::double AS cap FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::double - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM v WINDOW b AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN level * weight > cap THEN cap ELSE weight * (SELECT arg_min(level, (cap / weight, rank)) FROM l WHERE NOT level * weight > cap) END AS target FROM l),
o AS (SELECT doc_id, size, source_size, target, slope,
    coalesce(sum(size) OVER (PARTITION BY k ORDER BY mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint + size / 2 AS middle FROM r JOIN t USING (k)),
p AS (SELECT *, CASE WHEN target > 0 THEN middle / target ELSE 0 END AS share,
    (middle <= target)::int + (middle + source_size <= target)::int + (middle + 2 * source_size <= target)::int AS copies FROM o)
SELECT doc_id, size, source_size, target, size * copies AS taken, CASE WHEN copies > 0 THEN round(
  CASE WHEN slope = 0 THEN share ELSE ((slope - 1) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope) END, 6) END AS position
FROM p
"""

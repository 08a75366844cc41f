"""Ranks, positions, running sums and percentiles by one range partitioning, for any orderable values.

Rows are range partitioned by (group, value) and written once with the number of
their partition.  A running sum is then the sum inside a partition, plus the
totals of the group's partitions before it: a window sees one partition of one
group, or one row for each partition of a group.  A group of any size is thus spread
over as many tasks as its rows need, many small groups share one, and groups of
unlike scale do not meet in a bucket.  Values may be numbers, strings, dates or
structs.  Ties are counted before they are ranked (``running``), or told apart by a
row number (``positions``), so that one value repeated does not fill a task either.

Partitions are as many as the session's shuffle partitions unless ``parts`` says how
many; a partition then holds about rows / parts rows.  Null groups are groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.staging import staged


def ranged(df: DataFrame, keys: list[Column | str], parts: int | None = None) -> DataFrame:
    """``df`` range partitioned by ``keys``, written with the partition's number in ``_part``."""
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return staged(dealt.withColumn("_part", F.spark_partition_id()), "ranged")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys are equal; the left side's keys stay."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*(f"_right_{k}" for k in keys))


def _offsets(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """``(by, _part, _o_name, _t_name)``: each sum over the group's earlier partitions, and over the group."""
    per = rows.groupBy(*by, "_part").agg(*(c.alias(f"_s_{n}") for n, c in sums.items()))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    out = [F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    return per.select(*by, "_part", *out, *(F.sum(f"_s_{n}").over(group).alias(f"_t_{n}") for n in sums))


def running(df: DataFrame, by: list[str], value: str, sums: dict[str, str], buckets: int | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """Add, for each ``name: column`` in ``sums``, the sum of ``column`` over smaller values in the group.

    ``df`` has one row for each group and value.  ``totals`` (``name: name in sums``) adds the group's
    whole sums.  ``buckets`` is the number of range partitions.
    """
    rows = ranged(df, [*by, value], buckets)
    inside = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    met = joined(summed, _offsets(rows, by, {n: F.sum(c) for n, c in sums.items()}), [*by, "_part"])
    whole = [F.col(f"_t_{n}").alias(name) for name, n in (totals or {}).items()]
    return met.select(*df.columns, *((F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums), *whole)


def average_ranks(df: DataFrame, by: list[str], value: str, out: str = "rank", buckets: int | None = None) -> DataFrame:
    """Rows of ``df`` with their rank in the group, ties sharing the mean rank."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running(counted, by, value, {"_below": "_n"}, buckets)
    ranked = ranked.select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(out))
    return joined(df, ranked, [*by, value])


def percentile(df: DataFrame, by: list[str], value: str, p: float, out: str = "percentile", buckets: int | None = None) -> DataFrame:
    """Linearly interpolated percentile of each group, exact."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    rows = running(counted, by, value, {"_below": "_n"}, buckets, {"_all": "_below"})
    at = (F.col("_all") - 1) * F.lit(float(p))
    last = F.col("_below") + F.col("_n") - 1
    holds = lambda k: (F.col("_below") <= k) & (last >= k)
    picked = rows.groupBy(*by).agg(
        F.max(F.when(holds(F.floor(at)), F.col(value))).alias("_lo"),
        F.max(F.when(holds(F.ceil(at)), F.col(value))).alias("_hi"),
        F.max(at - F.floor(at)).alias("_f"),
    )
    return picked.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out))


def positions(df: DataFrame, by: list[str], order: list[Column], at: str = "at", of: str = "of", parts: int | None = None) -> DataFrame:
    """Rows with their position in the group by ``order`` (from 1) and the group's size; equal rows take any order among them."""
    rows = ranged(df.withColumn("_row", F.monotonically_increasing_id()), [*by, *order, F.col("_row")], parts)
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order, "_row"))
    met = joined(rows.withColumn("_inside", inside), _offsets(rows, by, {"n": F.count("*")}), [*by, "_part"])
    return met.select(*df.columns, (F.col("_inside") + F.col("_o_n")).alias(at), F.col("_t_n").alias(of))

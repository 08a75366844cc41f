"""Rubric responses: tolerant parsing, scores, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import cache_key, cost, json_object

SUBSCORES = ("palette", "composition", "typography", "styling", "mood")
SCHEMA = ", ".join(f"{s} int" for s in SUBSCORES) + ", overall_consistency int, reason string"


def parse(responses: DataFrame, text: str = "text", schema: str = SCHEMA) -> DataFrame:
    """Fields of the JSON object in a reply, with ``error``: null, ``nojson`` or ``parse``.

    Fences and prose around the object are ignored; of a list the first object
    counts.  The object runs from the first brace to the last, so two objects in
    one reply do not parse.
    """
    wrapped = F.concat(F.lit("["), json_object(text), F.lit("]"))  # two objects without a comma are no array
    is_list = F.ltrim(F.regexp_replace(F.col(text), r"^\s*```[a-z]*", "")).startswith("[")
    rows = responses.withColumns({"_wrapped": wrapped, "_list": is_list})
    rows = rows.withColumn("_all", F.when(F.try_parse_json("_wrapped").isNotNull(), F.from_json("_wrapped", f"array<struct<{schema.replace(' int', ': int').replace(' string', ': string')}>>")))
    good = (F.size("_all") == 1) | ((F.size("_all") > 1) & F.col("_list"))
    error = F.when(F.col("_wrapped").isNull(), "nojson").when(~F.coalesce(good, F.lit(False)), "parse")
    rows = rows.withColumn("_error", error).withColumn("_v", F.when(F.col("_error").isNull(), F.get("_all", F.lit(0))))
    return rows.select(*responses.columns, "_v.*", F.col("_error").alias("error"))


def scores(parsed: DataFrame, judge: str, scale: float = 10.0) -> DataFrame:
    """Long scores; divided, not multiplied by the inverse: the two differ in the last bit, and so by bin."""
    rows = parsed.where("overall_consistency is not null")
    return rows.select(F.lit(judge).alias("judge"), "item_id", (F.col("overall_consistency") / F.lit(scale)).alias("score"))


def usage(calls: DataFrame, rates: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Tokens and dollars of each judge of ``(judge, tokens_in, cached, tokens_out)``; failed calls bill too."""
    sums = calls.groupBy("judge").agg(*(F.sum(c).alias(c) for c in ("tokens_in", "cached", "tokens_out")), F.count("*").alias("calls"))
    dollars: Column = F.lit(None).cast("double")
    for judge, r in rates.items():
        dollars = F.when(F.col("judge") == judge, cost("tokens_in", "cached", "tokens_out", r)).otherwise(dollars)
    return sums.withColumn("dollars", dollars)


def to_call(items: DataFrame, cache: DataFrame, judge: str, retry_errors: bool = True) -> DataFrame:
    """Items without a usable cached reply; ``cache(judge, cache_key, error)``."""
    held = cache.where(F.col("judge") == judge)
    if retry_errors:
        held = held.where("error is null")
    return items.withColumn("cache_key", cache_key("item_id")).join(held.select("cache_key").distinct(), "cache_key", "left_anti")

"""How the given tables carry judges, items, prompts and instruments.  Each frame has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.staging import table

def event_k():
    """The integer that an event's properties hold."""
    return F.get_json_object("props", "$.k").cast("int")


K_SQL = "(props->>'$.k')::int"


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two judges over events: a coarse one in tenths, and a fine one."""
    e = table(spark, sf, "events")
    rows = e.select(
        F.col("event_id").alias("item_id"), F.col("user_id").alias("prompt_idx"), "event_type", "ts",
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("label"),
        F.explode(F.array(F.struct(F.lit("coarse").alias("judge"), (F.floor(event_k() / 10) / F.lit(10.0)).alias("score")), F.struct(F.lit("fine").alias("judge"), (F.col("value") / 500).alias("score")))).alias("s"),
    )
    return rows.select("s.judge", "item_id", "prompt_idx", "event_type", "ts", "label", "s.score")


EVENTS_SQL = f"""ev AS (
  SELECT event_id AS item_id, user_id AS prompt_idx, event_type, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label, 'coarse' AS judge, floor({K_SQL} / 10.0) / 10 AS score FROM events
  UNION ALL SELECT event_id, user_id, event_type, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END, 'fine', value / 500 FROM events)"""

#: Instruments by the remainder of the order key.
INSTRUMENTS = ("pos_real", "pos_temporal", "neg_competitor", "neg_masked", "neg_clean", "corrupt_prog", "corrupt_gen", "dial")


def exam_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as exam items with two judges: price share, and a coarse one in tenths."""
    o = table(spark, sf, "orders")
    inst = F.get(F.array(*map(F.lit, INSTRUMENTS)), (F.col("o_orderkey") % 8).cast("int"))
    price = F.least(F.col("o_totalprice") / 500000, F.lit(1.0))
    rows = o.select(
        F.col("o_orderkey").alias("item_id"), inst.alias("instrument"), F.substring("o_orderpriority", 1, 1).alias("dimension"), (F.floor(F.col("o_orderkey") / 8) % 3 + 1).cast("int").alias("severity"),
        (F.col("o_custkey") % 50).cast("int").alias("prompt_idx"), (F.col("o_custkey") % 3).alias("seed"), (F.floor(F.col("o_orderkey") / 8) % 6 / 5).alias("adapter_scale"),
        F.explode(F.array(F.struct(F.lit("price").alias("judge"), price.alias("score")), F.struct(F.lit("tenths").alias("judge"), (F.floor(price * 10) / F.lit(10.0)).alias("score")))).alias("s"),
    )
    return rows.select("s.judge", "item_id", "instrument", "dimension", "severity", "prompt_idx", "seed", "adapter_scale", "s.score")


_INST_SQL = "[" + ", ".join(f"'{i}'" for i in INSTRUMENTS) + "][(o_orderkey % 8)::int + 1]"
_PRICE_SQL = "least(o_totalprice / 500000, 1.0)"
_EXAM_COLUMNS = f"""o_orderkey AS item_id, {_INST_SQL} AS instrument, substr(o_orderpriority, 1, 1) AS dimension, ((o_orderkey // 8) % 3 + 1)::int AS severity,
  (o_custkey % 50)::int AS prompt_idx, o_custkey % 3 AS seed, ((o_orderkey // 8) % 6) / 5 AS adapter_scale"""
EXAM_SQL = f"""ex AS (SELECT {_EXAM_COLUMNS}, 'price' AS judge, {_PRICE_SQL} AS score FROM orders
  UNION ALL SELECT {_EXAM_COLUMNS}, 'tenths', floor({_PRICE_SQL} * 10) / 10 FROM orders)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")


VECTORS_SQL = "ve AS (SELECT vec_id AS item_id, embedding AS vec, label FROM embeddings)"


def staged_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Events as paired evaluations: judges, stages by half of the month, brand and control items."""
    e = table(spark, sf, "events")
    stage = F.when(F.dayofmonth("ts") <= 15, "base").otherwise("tuned")
    kind = F.when(F.col("event_type") == "error", "control").otherwise("brand")
    k = event_k()
    judges = [("alpha", F.col("value") / 500), ("beta", k / 100), ("gamma", (F.col("value") + k) / 600), ("delta", F.lit(1.0) - k / 100)]
    made = F.array(*(F.struct(F.lit(n).alias("judge"), c.alias("score")) for n, c in judges))
    rows = e.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("prompt_idx"), (F.col("event_id") % 4).cast("int").alias("cand"), stage.alias("stage"), kind.alias("kind"), F.explode(made).alias("s"))
    return rows.select("s.judge", "item_id", "stage", "kind", "prompt_idx", "cand", "s.score")


FAMILIES = {"alpha": "one", "beta": "two", "gamma": "one", "delta": "three"}


def judge_table(spark: SparkSession) -> DataFrame:
    """The dimension table of judges and families (a fixed short list)."""
    return spark.createDataFrame(list(FAMILIES.items()), "judge string, family string")


_STAGED = f"""SELECT event_id AS item_id, user_id AS prompt_idx, (event_id %% 4)::int AS cand, CASE WHEN day(ts) <= 15 THEN 'base' ELSE 'tuned' END AS stage,
  CASE WHEN event_type = 'error' THEN 'control' ELSE 'brand' END AS kind, '%s' AS judge, %s AS score FROM events"""
STAGED_SQL = "st AS (" + " UNION ALL ".join(
    _STAGED % (n, s) for n, s in (("alpha", "value / 500"), ("beta", f"{K_SQL} / 100.0::double"), ("gamma", f"(value + {K_SQL}) / 600"), ("delta", f"1.0::double - {K_SQL} / 100.0::double"))
) + "), ju AS (SELECT * FROM (VALUES " + ", ".join(f"('{j}', '{f}')" for j, f in FAMILIES.items()) + ") t(judge, family))"

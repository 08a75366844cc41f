"""Cluster summaries, splits and their checks, over the near-duplicate clusters of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clusters, sampling, splits
from plumbline.plans.embedding import COMPONENTS_SQL, members
from plumbline.plans.registry import query
from plumbline.staging import staged, table

ANCHOR = "b0"

_MEMBERS = """me AS (SELECT cc.item_id, component, 'b' || label AS brand, CASE WHEN item_id % 3 = 0 THEN 'ig' ELSE 'fb' END AS src, floor(epoch(ts))::bigint AS date FROM cc JOIN ve USING (item_id) LEFT JOIN (SELECT * FROM events WHERE event_id % 7 <> 0) e ON e.event_id = item_id),
  cf AS (SELECT component, arg_min(brand, item_id) AS brand, count(*) AS n, CASE WHEN count(*) FILTER (src = 'fb') >= count(*) FILTER (src = 'ig') THEN 'fb' ELSE 'ig' END AS src, coalesce(min(date), 0) AS date, count(DISTINCT src) AS n_src FROM me GROUP BY component)"""
INFO_SQL = f"{COMPONENTS_SQL}, {_MEMBERS}"


def info(spark, sf, held=None):
    """Clusters with brand by label, source by id, and dates from events (a seventh have none)."""
    dates = table(spark, sf, "events").where("event_id % 7 <> 0").select(F.col("event_id").alias("item_id"), F.unix_timestamp("ts").alias("date"))
    items = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.concat(F.lit("b"), F.col("label").cast("string")).alias("brand"), F.when(F.col("vec_id") % 3 == 0, "ig").otherwise("fb").alias("src")
    )
    return clusters.cluster_info((held or members(spark, sf)).join(items, "item_id").join(dates, "item_id", "left"))


@query(f"WITH RECURSIVE {INFO_SQL} SELECT * FROM cf")
def cluster_summary(spark, sf):
    return info(spark, sf)


@query(f"WITH RECURSIVE {INFO_SQL} SELECT brand, sum(n)::bigint AS raw, count(*) AS clusters, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n_src > 1) AS cross_source FROM cf GROUP BY brand")
def brand_summary(spark, sf):
    return clusters.brand_summary(info(spark, sf))


@query(f"WITH RECURSIVE {INFO_SQL} SELECT component, n, n_src FROM cf WHERE n_src > 1")
def mixed_source_clusters(spark, sf):
    return clusters.mixed_source(info(spark, sf)).select("component", "n", "n_src")


def _found(spark, sf, held=None):
    """``info``, written once for its several readers."""
    return staged(info(spark, sf, held), "clusters")


_HOLD = f"ho AS (SELECT component FROM (SELECT component, row_number() OVER (ORDER BY date DESC, component DESC) AS pos, count(*) OVER () AS total FROM cf WHERE brand = '{ANCHOR}') WHERE pos <= greatest(1, 15 * total // 100))"
_SPLIT = """sp AS (SELECT component, CASE WHEN pos <= 60 * total // 100 THEN 'train' WHEN pos <= 75 * total // 100 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT component, row_number() OVER (PARTITION BY brand, src ORDER BY md5('42:' || component), component) AS pos, count(*) OVER (PARTITION BY brand, src) AS total FROM cf WHERE component NOT IN (FROM ho))
  UNION ALL SELECT component, 'temporal_test' FROM ho)"""


@query(f"WITH RECURSIVE {INFO_SQL}, {_HOLD} SELECT component, 'temporal_test' AS split FROM ho")
def temporal_holdout(spark, sf):
    return splits.temporal_holdout(info(spark, sf), ANCHOR)


@query(f"WITH RECURSIVE {INFO_SQL}, {_HOLD}, {_SPLIT} SELECT component, split FROM sp")
def cluster_splits(spark, sf):
    return splits.cluster_splits(_found(spark, sf), ANCHOR)


@query(f"WITH RECURSIVE {INFO_SQL}, {_HOLD}, {_SPLIT} SELECT component, count(DISTINCT split) AS n_splits FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leak_check(spark, sf):
    """Must be empty."""
    return splits.split_leaks(splits.cluster_splits(_found(spark, sf), ANCHOR))


@query(f"WITH RECURSIVE {INFO_SQL}, {_HOLD}, {_SPLIT} SELECT split, brand, count(*) AS clusters, sum(n)::bigint AS items FROM cf JOIN sp USING (component) GROUP BY ALL")
def split_counts(spark, sf):
    found = _found(spark, sf)
    return splits.split_counts(found, splits.cluster_splits(found, ANCHOR))


@query(f"WITH RECURSIVE {INFO_SQL}, {_HOLD}, {_SPLIT} SELECT item_id, split FROM cc JOIN sp USING (component)")
def image_split_index(spark, sf):
    held = staged(members(spark, sf), "members")
    return splits.image_index(held, splits.cluster_splits(_found(spark, sf, held), ANCHOR))


_TEXTS = "gr AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS component FROM documents)"


@query(f"WITH {_TEXTS} SELECT component, count(*) AS n, count(DISTINCT source) AS n_src FROM gr GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, sf):
    """Groups of documents with one text, by digest."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    groups = docs.groupBy("digest").agg(F.min("doc_id").alias("component"), F.count("*").alias("n"), F.countDistinct("source").alias("n_src"))
    return groups.where("n > 1").select("component", "n", "n_src")


@query("SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS pos FROM embeddings) WHERE pos <= 5")
def seeded_sample(spark, sf):
    """Five items of each label in a seeded order."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    return sampling.seeded_sample(rows, "vec_id", 5, 7, ["label"])


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY o_orderstatus) // 20) AS step FROM orders) WHERE pos % step = 0 AND pos / step < 20")
def stride_sample(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stride_sample(rows, ["o_orderkey"], 20, ["o_orderstatus"])


@query("SELECT (o_orderkey % 16)::int AS shard, count(*) AS n FROM orders GROUP BY 1")
def shard_counts(spark, sf):
    return sampling.shard_of(table(spark, sf, "orders"), "o_orderkey", 16).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, bool_and(o_totalprice >= 20000) OVER (PARTITION BY o_custkey) AS ok FROM orders) WHERE ok")
def eligibility_gate(spark, sf):
    """Orders of customers none of whose orders fails the gate."""
    rows = table(spark, sf, "orders")
    return sampling.rungs_hold(rows, ["o_custkey"], F.col("o_totalprice") >= 20000).select("o_custkey", "o_orderkey")

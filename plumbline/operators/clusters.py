"""Near-duplicate clusters: blocked candidate pairs, components, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import hamming
from plumbline.operators.components import connected_components
from plumbline.operators.ranks import positions
from plumbline.operators.similar import similar_links, similar_pairs

MOST_BITS = 8
LEAST_COSINE = 0.95


def hamming_pairs(items: DataFrame, block: str, most: int = MOST_BITS) -> DataFrame:
    """Pairs ``(u, v, bits)`` of one block whose 64-bit ``hash`` differ in at most ``most`` bits.

    Lossless banding: ``most`` flips leave one of ``most + 1`` bit bands equal, so
    only items that share a band (and the block) meet.  Equal hashes meet once.
    """
    bands = most + 1
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    cut = lambda i: F.shiftrightunsigned("hash", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    one = items.where("hash is not null").groupBy(block, "hash").agg(F.min("item_id").alias("item_id"))
    keyed = one.select(block, "hash", "item_id", F.posexplode(F.array(*(cut(i) for i in range(bands)))).alias("band", "part"))
    left, right = keyed.withColumnsRenamed({"hash": "ha", "item_id": "a"}), keyed.withColumnsRenamed({"hash": "hb", "item_id": "b"})
    met = left.join(right, [block, "band", "part"]).where("a < b").where(hamming("ha", "hb") <= most)
    met = met.select(F.col("a").alias("u"), F.col("b").alias("v"), hamming("ha", "hb").alias("bits")).distinct()
    same = items.where("hash is not null").join(one.withColumnRenamed("item_id", "u"), [block, "hash"]).where("item_id > u")
    return met.unionByName(same.select("u", F.col("item_id").alias("v"), F.lit(0).alias("bits")))


def cosine_pairs(items: DataFrame, block: str, least: float = LEAST_COSINE) -> DataFrame:
    """Pairs ``(u, v, cosine)`` of unit vectors of one block at or above ``least``."""
    return similar_pairs(items, block, least).withColumnRenamed("product", "cosine")


def hybrid_links(items: DataFrame, block: str, most: int = MOST_BITS, least: float = LEAST_COSINE) -> DataFrame:
    """Links ``(u, v)`` that connect what ``hybrid_pairs`` connects, without naming all pairs of vectors."""
    return hamming_pairs(items, block, most).select("u", "v").unionByName(similar_links(items, block, least))


def hybrid_pairs(items: DataFrame, block: str, most: int = MOST_BITS, least: float = LEAST_COSINE) -> DataFrame:
    """Pairs ``(u, v, by_hash, by_vector)`` of one block that either rule finds; an item may lack its hash or its vector."""
    near = hamming_pairs(items, block, most).select("u", "v", F.lit(True).alias("by_hash"), F.lit(False).alias("by_vector"))
    alike = cosine_pairs(items, block, least).select("u", "v", F.lit(False).alias("by_hash"), F.lit(True).alias("by_vector"))
    return near.unionByName(alike).groupBy("u", "v").agg(F.bool_or("by_hash").alias("by_hash"), F.bool_or("by_vector").alias("by_vector"))


def clusters(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(item_id, component)`` for all items; an item without a pair is its own component."""
    found = connected_components(pairs.select("u", "v")).withColumnRenamed("node", "item_id")
    return items.select("item_id").distinct().join(found, "item_id", "left").select("item_id", F.coalesce("component", "item_id").alias("component"))


def numbered(members: DataFrame, prefix: str = "h") -> DataFrame:
    """``(cluster_id, component, n)``: largest first, ties by first member."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    rows = positions(sizes, [], [F.desc("n"), F.col("component")])
    digits = (F.col("at") - 1).cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return rows.select(F.concat(F.lit(prefix), padded).alias("cluster_id"), "component", "n")


def cluster_info(members: DataFrame) -> DataFrame:
    """Per component of ``(component, item_id, brand, src, date)``: brand, size, dominant source, earliest date (0 if none)."""
    first_source = F.count(F.when(F.col("src") == "fb", 1))
    return members.groupBy("component").agg(
        F.min_by("brand", "item_id").alias("brand"),
        F.count("*").alias("n"),
        F.when(first_source >= F.count(F.when(F.col("src") == "ig", 1)), F.lit("fb")).otherwise(F.lit("ig")).alias("src"),
        F.coalesce(F.min("date"), F.lit(0).cast("long")).alias("date"),
        F.countDistinct("src").alias("n_src"),
    )


def brand_summary(info: DataFrame) -> DataFrame:
    """Per brand: items, clusters, largest, singletons, clusters over both sources."""
    return info.groupBy("brand").agg(
        F.sum("n").alias("raw"),
        F.count("*").alias("clusters"),
        F.max("n").alias("largest"),
        F.count(F.when(F.col("n") == 1, 1)).alias("singletons"),
        F.count(F.when(F.col("n_src") > 1, 1)).alias("cross_source"),
    )


def mixed_source(info: DataFrame) -> DataFrame:
    return info.where("n_src > 1")


def nearest_of_palette(colours: DataFrame, palette: DataFrame, distance: Column) -> DataFrame:
    """Each colour with the palette entry (a small dimension table) at the least distance; ties to the smaller entry."""
    met = colours.join(F.broadcast(palette))
    return met.withColumn("distance", distance).groupBy("colour_id").agg(F.min(F.struct("distance", "entry")).alias("m")).select("colour_id", "m.entry", "m.distance")

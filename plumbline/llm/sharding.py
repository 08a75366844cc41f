"""Sharding by Karmarkar-Karp differencing.

Groups (equal texts) are indivisible, and the law is ``bytes``: shard sizes as
near to equal as the groups allow.

A partial partition is a vector of ``shards`` part sizes with a spread
(largest minus smallest).  Differencing repeatedly takes the two partial
partitions with the largest spreads and adds them in opposite order, so that
the largest part of one meets the smallest of the other.  It is done in
levels, so that no task and no driver holds more than ``FAN_IN`` partial
partitions (a bucket is filled by digest, so its size varies around that):

* groups are dealt to buckets by digest; each bucket is differenced to one
  partial partition in its own task;
* the results are dealt to fewer buckets, and so on, until one bucket is left;
* ``fan_in`` groups skip the buckets and join the last level: a quarter of them
  the largest of all, which settle first, the others a choice by digest, whose
  smaller sizes even those out.

Units are named by level and bucket, so names of two levels never meet, and
places are followed down one level at a time.

Equal texts are recognised by SHA-256.  A hot group costs one map-side sum, and
its rows are salted before they meet their group's shard; slots are numbered in
bins with prefix sums of bin counts, so no shard is numbered in one task.

Defined results: null texts count as empty (size 1, checksum 0) and are one
group with the empty texts.  Repeated rows are separate rows of one group.  An
empty table gives an empty result.  Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.staging import staged, table

SHARDS = 8
FAN_IN = 2000
#: Rows of a group that stay together in a join, and parts it is dealt to at most.
SALT = 1000
MOST_SALTS = 10000
#: Rows of a bin in which slots are numbered, about, and bins of a bin of bins.
SLOT_ROWS = 1000
SLOT_BINS = 1024


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over rows of part sizes.

    Returns the part sizes of the result and, for each row, where each of its
    parts went.  Ties go by row number, so the result is repeatable.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = np.take_along_axis(parts, order, axis=1)
    # place[i][p]: slot, in its tree's current vector, of part p of row i; kept lazily as a tree of permutations
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    nodes: list[tuple] = [(i,) for i in range(n)]
    vectors = list(sums)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = vectors[a] + vectors[b][::-1]
        turn = np.argsort(-joined, kind="stable")
        vectors.append(joined[turn])
        vectors[a] = vectors[b] = None
        nodes.append((a, b, turn))
        heapq.heappush(heap, (int(vectors[-1][-1] - vectors[-1][0]), len(nodes) - 1))
    place = np.empty((n, k), np.int64)
    stack = [(len(nodes) - 1, np.arange(k))]
    while stack:
        i, where = stack.pop()  # where[slot of node i] = slot of the result
        if len(nodes[i]) == 1:
            place[i, order[i]] = where
        else:
            a, b, turn = nodes[i]
            inner = np.empty(k, np.int64)
            inner[turn] = where  # slot before sorting -> slot of the result
            stack += [(a, inner), (b, inner[::-1])]
    return vectors[-1], place


def _level(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", kind="stable")
        sizes, place = difference(np.stack(pdf["parts"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"unit": pdf["unit"], "bucket": pdf["bucket"], "place": list(place.astype(np.int32)), "sizes": [sizes] * len(pdf)})

    return run


_PLACED = "unit binary, bucket long, place array<int>, sizes array<long>"


def _name(level: int, bucket: Column) -> Column:
    """A unit's name says which bucket of which level it came from."""
    return F.unhex(F.sha2(F.concat_ws(":", F.lit(level), bucket).cast("binary"), 256))


def balance(groups: DataFrame, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """``groups(unit binary, size long)``, each unit once -> ``(unit, shard)``."""
    n = groups.count()
    if not n:
        return groups.select("unit", F.lit(0).alias("shard"))
    ranked = F.struct("size", "unit")
    # two top-k of fixed size: the largest groups, and of the rest some by digest
    least = groups.orderBy(ranked.desc()).limit(max(1, fan_in // 4)).agg(F.min(ranked).alias("r")).first()["r"]
    limit = F.struct(F.lit(least["size"]).alias("size"), F.lit(bytes(least["unit"])).alias("unit"))
    chosen = groups.where(ranked < limit).orderBy("unit").limit(fan_in - fan_in // 4).agg(F.max("unit").alias("u")).first()["u"]
    late = (ranked >= limit) | (F.col("unit") <= F.lit(bytes(chosen or b"")))
    zeros = F.array(*[F.lit(0).cast("long")] * (shards - 1))
    parts = F.concat(F.array(F.col("size").cast("long")), zeros).alias("parts")
    large, units = groups.where(late).select("unit", parts), groups.where(~late).select("unit", parts)
    n, levels = max(1, n - fan_in), []  # levels[k](unit, up, place): where the parts of a unit lie in the unit above
    while True:
        buckets = -(-n // fan_in)
        last = buckets == 1
        bucket = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("unit"), F.lit(buckets))
        dealt = (units.unionByName(large) if last else units).withColumn("bucket", bucket)
        placed = staged(dealt.groupBy("bucket").applyInPandas(_level(shards), _PLACED), "shard-level")
        up = _name(len(levels), F.col("bucket"))
        levels.append(placed.select("unit", up.alias("up"), "place"))
        if last:
            break
        units = placed.groupBy("bucket").agg(F.first("sizes").alias("parts")).select(up.alias("unit"), "parts")
        n = buckets
    # from the top down, each level meets only the one above it; the late units sit in the top level itself
    above = levels[-1].select("unit", "place")
    for low in reversed(levels[:-1]):
        held = staged(above, "shard-followed")
        above = low.join(held.withColumnsRenamed({"unit": "up", "place": "over"}), "up").select("unit", F.transform("place", lambda p: F.get("over", p)).alias("place"))
    if len(levels) > 1:
        top = large.select("unit").join(levels[-1].select("unit", "place"), "unit")
        above = above.unionByName(top)
    return above.select("unit", F.get("place", F.lit(0)).alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, group, shard, slot)`` for each row of ``docs(doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"),
    )
    rows = staged(rows, "shard-rows")
    sized = rows.groupBy(F.col("group").alias("unit")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    groups = staged(sized, "shard-groups")
    found = balance(groups.select("unit", "size"), shards).join(groups.select("unit", "n"), "unit").withColumnRenamed("unit", "group")
    # a group of more than SALT rows is dealt over several salts, so that no task meets it whole
    salts = F.least(F.ceil(F.col("n") / SALT), F.lit(MOST_SALTS)).cast("int")
    salted = found.withColumn("salts", salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("group", "salt", "salts", "shard")
    salted = staged(salted, "shard-salted")
    hot = salted.where("salts > 1 and salt = 0").select("group", "salts")
    mark = F.xxhash64("doc_id", "group")
    # few groups are hot: at most rows / SALT
    rows = rows.join(hot, "group", "left").withColumn("salt", F.pmod(mark, F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    bins = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    out = rows.join(salted.drop("salts"), ["group", "salt"]).withColumn("bin", F.pmod(mark, F.lit(bins)))
    out = staged(out, "shard-dealt")
    counts = out.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    # bins of a shard's bins, so that no task holds all of a shard's
    counts = counts.withColumn("high", F.floor(F.col("bin") / SLOT_BINS))
    highs = counts.groupBy("shard", "high").agg(F.sum("n").alias("n"))

    def before(keys: list[str], order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    highs = highs.select("shard", "high", before(["shard"], "high").alias("base"))
    offsets = counts.withColumn("low", before(["shard", "high"], "bin")).join(highs, ["shard", "high"]).select("shard", "bin", (F.col("base") + F.col("low")).alias("offset"))
    within = Window.partitionBy("shard", "bin").orderBy("doc_id", "group")
    out = out.withColumn("slot", F.row_number().over(within) - 1).join(offsets, ["shard", "bin"])
    return out.select("doc_id", "size", "text_crc32", "group", "shard", (F.col("slot") + F.col("offset")).cast("long").alias("slot"))


def op3_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )

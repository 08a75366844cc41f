"""Sinks: JSON lines and Parquet, idempotent appends, resumable work, preference sets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.staging import staged


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_part(df: DataFrame, path: str, part: str) -> None:
    """Write ``df`` so that a rerun replaces the parts it holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the table at ``path`` does not hold; returns how many."""
    try:
        held = df.sparkSession.read.schema(df.select(key).schema).parquet(path)
        df = df.join(held.distinct(), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new = staged(df, "append")
    new.write.mode("append").parquet(path)
    return new.count()


def purge_errors(spark: SparkSession, path: str, schema: str, out: str | None = None) -> None:
    """Rewrite a cache without its failed entries, so that they are tried again; in place unless ``out`` is given.

    In place, the entries that stay are first written to the shared folder, whence they can be
    restored should the rewriting be cut off.
    """
    kept = spark.read.schema(schema).parquet(path).where("error is null")
    (kept if out else staged(kept, "purged")).write.mode("overwrite").parquet(out or path)


def preference_set(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Trainer rows ``(jpg_0, jpg_1, label_0, caption)``; ``images(file, content)``."""
    side = lambda name, out: images.select(F.col("file").alias(name), F.col("content").alias(out))
    rows = pairs.join(side("chosen", "jpg_0"), "chosen").join(side("rejected", "jpg_1"), "rejected")
    return rows.select("jpg_0", "jpg_1", F.lit(1).alias("label_0"), F.col("prompt").alias("caption"))


def bundle_lists(splits: DataFrame, anchor: str) -> dict[str, DataFrame]:
    """The four lists of a training bundle from ``(item_id, brand, split)``."""
    ours = F.col("brand") == anchor
    return {
        "train_pos": splits.where((F.col("split") == "train") & ours),
        "train_neg": splits.where((F.col("split") == "train") & ~ours),
        "val": splits.where(F.col("split") == "val"),
        "test": splits.where(F.col("split").isin("test", "temporal_test")),
    }

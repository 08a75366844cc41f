"""The exam index: eight instruments under one schema, with coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each instrument's label.
LABELS = {
    "pos_real": "on",
    "pos_temporal": "on",
    "neg_competitor": "off",
    "neg_masked": "off",
    "neg_clean": "off",
    "corrupt_prog": "off",
    "corrupt_gen": "off",
    "dial": "ordinal",
}
META = ("source_id", "brand", "certification", "dimension", "corruption", "severity", "strength", "prompt_idx", "seed", "adapter_scale")
_TYPES = {"severity": "int", "strength": "double", "prompt_idx": "int", "seed": "bigint", "adapter_scale": "double"}


def build_index(parts: dict[str, DataFrame]) -> DataFrame:
    """Instrument name -> ``(key, path, any META columns)``; one index with a sparse ``meta`` struct."""
    out = None
    for name, df in parts.items():
        meta = F.struct(*((F.col(m) if m in df.columns else F.lit(None)).cast(_TYPES.get(m, "string")).alias(m) for m in META))
        one = df.select(
            F.concat(F.lit(f"{name}:"), F.col("key").cast("string")).alias("item_id"), F.lit(name).alias("instrument"), F.col("path").cast("string").alias("path"),
            F.lit(LABELS[name]).alias("label"), meta.alias("meta"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def missing_paths(index: DataFrame, listing: DataFrame) -> DataFrame:
    return index.join(listing.select("path").distinct(), "path", "left_anti")


def coverage(index: DataFrame) -> DataFrame:
    return index.groupBy("instrument", "label").agg(F.count("*").alias("n"))


def with_scores(index: DataFrame, scores: DataFrame) -> DataFrame:
    """Index rows with each judge's score, flat for the report; an item without a score is dropped for that judge only."""
    rows = scores.where("score is not null").join(index, "item_id")
    return rows.select("judge", "item_id", "instrument", "label", "score", *(F.col(f"meta.{m}").alias(m) for m in ("dimension", "severity", "prompt_idx", "seed", "adapter_scale")))

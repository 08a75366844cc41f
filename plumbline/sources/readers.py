"""Sources: JSON arrays, JSON lines, folders of JSON, images, arrays of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: fetched files smaller than this are no images.
LEAST_BYTES = 5000


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_folder(spark: SparkSession, path: str, schema: str, required: str) -> DataFrame:
    """A folder of one-document files as a table; documents without the ``required`` field are left out."""
    return spark.read.schema(schema).option("multiLine", True).json(path).where(F.col(required).isNotNull())


def line_scores(spark: SparkSession, path: str, judge: str, key: str, field: str, scale: float = 1.0) -> DataFrame:
    """JSON lines -> ``(judge, item_id, score)``; of lines with one key the last in the file wins."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    rows = raw.select("f", "at", F.from_json("value", f"`{key}` string, `{field}` double").alias("v")).select("f", "at", f"v.{key}", f"v.{field}")
    rows = rows.where(F.col(field).isNotNull()).groupBy(key).agg(F.max_by(field, F.struct("f", "at")).alias("s"))
    return rows.select(F.lit(judge).alias("judge"), F.col(key).alias("item_id"), (F.col("s") * scale).alias("score"))


def folder_scores(spark: SparkSession, path: str, judge: str, field: str, scale: float) -> DataFrame:
    docs = json_folder(spark, path, f"item_id string, `{field}` double, error string", field)
    return docs.select(F.lit(judge).alias("judge"), "item_id", (F.col(field) / scale).alias("score"))


def npz_vectors(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``.npz`` files of ``files`` and ``vecs`` -> ``(id, vec)``, read by tasks, a file each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for frame in frames:
            for content in frame["content"]:
                held = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                for i in range(0, len(held["files"]), 4096):
                    ids = [f"{prefix}{f}" for f in held["files"][i : i + 4096]]
                    yield pd.DataFrame({"id": ids, "vec": list(held["vecs"][i : i + 4096].astype("float32"))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("content")
    return files.mapInPandas(run, "id string, vec array<float>")


def image_files(spark: SparkSession, path: str, brand_depth: int = 1) -> DataFrame:
    """``brand/file`` folders of images as bytes: ``(path, brand, file, length, sha1, content)``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return raw.select("path", F.element_at(parts, -1 - brand_depth).alias("brand"), F.element_at(parts, -1).alias("file"), "length", F.sha1("content").alias("sha1"), "content")


def landed_images(files: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Fetched files that are large enough to be images."""
    return files.where(F.col("length") >= least)


def decoded_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images as pixel rows, and the paths that could not be decoded."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    return rows.where("height > 0"), rows.where("height <= 0").select("origin")

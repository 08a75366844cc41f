"""Every stage over awkward rows: null ids and texts, long runs, cut keys, repeated rows, extra columns, an empty table."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline
from plumbline.staging import table

FOLDER = "/root/testdata/sf0.001"
CLASHES = ("spans", "blob", "digest", "copies", "size", "target", "n_words", "kept", "row_key", "rank")


def through(spark, docs, folder):
    held = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], FOLDER).write.parquet(f"{folder}/{i}")
        held.append(spark.read.parquet(f"{folder}/{i}"))
    return held


def test_awkward_rows(spark, tmp_path):
    given = table(spark, FOLDER, "documents")
    good = given.orderBy(F.length("text").desc()).select("text").first()["text"]
    gap = "-----BEGIN PRIVATE KEY-----" + " \n" * 50_000 + "A" * 64
    rows = [(None, None, None, None), (10**6, None, "en", "s"), (None, good + " one more", "en", None), (10**6 + 1, "x" + " " * 200_000 + "y", None, "s"), (10**6 + 2, good + " " + gap, "en", "s"), (10**6 + 3, (good + " ") * 40, "en", "s"), (10**6 + 4, "", "en", "s")]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    more = more.unionByName(more.where("doc_id = 1000003"))  # a repeated row
    docs = given.unionByName(more.select(*(F.col(c).cast(t) for c, t in given.dtypes))).withColumns({c: F.lit(f"clash {c}") for c in CLASHES})
    held = through(spark, docs, tmp_path)
    assert all(h.columns == docs.columns for h in held[1:-1])
    assert all(h.where(" or ".join(f"{c} <> 'clash {c}'" for c in CLASHES)).count() == 0 for h in held[1:-1])
    counts = [h.count() for h in held]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[4] == counts[5]
    before, after = ({r["doc_id"]: r["text"] for r in h.where("doc_id is not null").collect()} for h in (held[2], held[3]))
    assert before.keys() == after.keys() and all(len(before[d] or "") == len(after[d] or "") for d in before)
    assert not any("BEGIN PRIVATE KEY" in (t or "") or "A" * 64 in (t or "") for t in after.values())


def test_an_empty_table(spark, tmp_path):
    held = through(spark, table(spark, FOLDER, "documents").limit(0), tmp_path)
    assert [h.count() for h in held] == [0] * 6

"""Readers, sinks, report frames and small operators, each on files or rows made here."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import clusters, imaging, reports
from plumbline.sources import readers, sinks
from plumbline.streaming.resume import windowed_scores


def png(pixels: np.ndarray) -> bytes:
    """An RGB array as a PNG file."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture
def pictures(tmp_path):
    """Two brands of images, one file that is no image, one that is not looked at."""
    img = np.random.default_rng(1).integers(0, 256, (60, 50, 3)).astype(np.uint8)
    files = {"acme/a.png": png(img), "acme/b.jpg": b"no image", "zeta/c.png": png(img[:3]), "zeta/notes.txt": b"x"}
    for name, data in files.items():
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_bytes(data)
    return tmp_path / "img", files, img


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": "x", "n": 1}, {"k": "y"}]))
    (tmp_path / "b.json").write_text("[]")
    assert {tuple(r) for r in readers.json_array(spark, str(tmp_path), "k string, n int").collect()} == {("x", 1), ("y", None)}


def test_the_last_line_wins_over_split_files(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(json.dumps({"id": str(i % 50), "v": i}) for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = readers.line_scores(spark, str(path), "j", "id", "v").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {int(r["item_id"]): r["score"] for r in rows} == {i: 19950.0 + i for i in range(50)}


def test_image_walk_sizes_and_hashes(spark, pictures):
    folder, files, _ = pictures
    rows = readers.image_files(spark, str(folder))
    got = {(r["brand"], r["file"]): (r["length"], r["sha1"]) for r in rows.collect()}
    assert got == {tuple(n.split("/")): (len(d), hashlib.sha1(d).hexdigest()) for n, d in files.items() if not n.endswith("txt")}
    assert {r["file"] for r in readers.landed_images(rows).collect()} == {"a.png"}


def test_images_that_cannot_be_decoded_are_listed(spark, pictures):
    folder, _, img = pictures
    good, bad = readers.decoded_images(spark, str(folder / "acme"))
    assert [r["origin"].rsplit("/", 1)[1] for r in bad.collect()] == ["b.jpg"]
    row = imaging.from_image_source(good).first()
    assert (row["height"], row["width"]) == (60, 50) and bytes(row["pixels"]) == img.tobytes()


def test_appends_need_no_earlier_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    out = tmp_path / "out"
    out.mkdir()  # an empty folder holds no keys
    assert [sinks.append_missing(rows, str(out), "k") for _ in range(2)] == [1, 0]
    assert sinks.append_missing(rows, str(tmp_path / "none" / "yet"), "k") == 1


def test_parts_are_replaced_alone(spark, tmp_path):
    out, make = str(tmp_path / "out"), lambda rows: spark.createDataFrame(rows, "v int, part string")
    sinks.replace_part(make([(1, "a"), (2, "b")]), out, "part")
    sinks.replace_part(make([(9, "b")]), out, "part")
    assert {tuple(r) for r in spark.read.parquet(out).select("v", "part").collect()} == {(1, "a"), (9, "b")}


def test_purged_errors_are_due_again(spark, tmp_path):
    cache, out = str(tmp_path / "cache"), str(tmp_path / "out")
    spark.createDataFrame([("a", None), ("b", "http")], "item_id string, error string").write.parquet(cache)
    sinks.purge_errors(spark, cache, "item_id string, error string", out)
    assert [r["item_id"] for r in spark.read.parquet(out).collect()] == ["a"]


def test_preference_set_drops_pairs_without_an_image(spark):
    pairs = spark.createDataFrame([("x", "y", "say"), ("x", "gone", "no")], "chosen string, rejected string, prompt string")
    images = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"2"))], "file string, content binary")
    assert [tuple(r) for r in sinks.preference_set(pairs, images).collect()] == [(b"1", b"2", 1, "say")]


def test_bundle_lists(spark):
    rows = [(1, "us", "train"), (2, "it", "train"), (3, "us", "val"), (4, "it", "test"), (5, "us", "temporal_test")]
    got = sinks.bundle_lists(spark.createDataFrame(rows, "item_id int, brand string, split string"), "us")
    assert {k: sorted(r["item_id"] for r in v.collect()) for k, v in got.items()} == {"train_pos": [1], "train_neg": [2], "val": [3], "test": [4, 5]}


def test_gallery_and_contact_sheet(spark):
    mine = spark.createDataFrame([("g", i, s) for i, s in enumerate([0.1, 0.9, 0.9, 0.5])], "g string, item_id long, score double")
    other = spark.createDataFrame([(1, 0.2)], "item_id long, score double")
    got = {r["rank"]: (r["item_id"], r["other"]) for r in reports.gallery(mine, {"other": other}, ["g"], 2).collect()}
    assert got == {1: (1, 0.2), 2: (2, None)}
    paths = spark.createDataFrame([(1, "p1"), (2, "p2")], "item_id long, path string")
    row = reports.contact_sheet(spark.createDataFrame([(1, 2)], "query_id long, item_id long"), paths).first()
    assert (row["query_path"], row["path"]) == ("p1", "p2")


def test_linear_score(spark):
    row = spark.createDataFrame([(3.0, 1.0)], "a double, b double").select(scalars.linear_score(["a", "b"], [1.0, -2.0], 0.5, [1.0, 1.0], [2.0, 1.0])).first()
    assert row[0] == pytest.approx(1 / (1 + np.exp(-1.5)))


def test_nearest_of_palette_breaks_ties_low(spark):
    colours = spark.createDataFrame([(1, 5.0), (2, 9.0)], "colour_id int, x double")
    palette = spark.createDataFrame([(0, 4.0), (1, 6.0), (2, 8.5)], "entry int, y double")
    got = clusters.nearest_of_palette(colours, palette, F.abs(F.col("x") - F.col("y")))
    assert {tuple(r) for r in got.collect()} == {(1, 0, 1.0), (2, 2, 0.5)}


def test_hybrid_pairs_take_either_rule(spark):
    rows = [(1, "a", 0, [1.0, 0.0]), (2, "a", 1, [0.0, 1.0]), (3, "a", -1, [1.0, 0.0]), (4, "b", 0, [1.0, 0.0]), (5, "a", None, None), (6, "a", 0, [1.0, 0.0])]
    items = spark.createDataFrame(rows, "item_id long, brand string, hash long, vec array<double>")
    pairs = clusters.hybrid_pairs(items, "brand")
    got = {(r["u"], r["v"]): (r["by_hash"], r["by_vector"]) for r in pairs.collect()}
    assert got == {(1, 2): (True, False), (1, 3): (False, True), (3, 6): (False, True), (1, 6): (True, True)}
    assert {r[0]: r[1] for r in clusters.clusters(items, pairs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 1}


def test_windows_over_a_batch(spark):
    rows = [("j", datetime(2024, 1, 1, 0, 10), 1.0), ("j", datetime(2024, 1, 1, 0, 50), 3.0), ("j", datetime(2024, 1, 1, 1, 0), 5.0)]
    got = windowed_scores(spark.createDataFrame(rows, "judge string, ts timestamp, score double")).orderBy("start").collect()
    assert [(r["n"], r["mean"]) for r in got] == [(2, 2.0), (1, 5.0)]

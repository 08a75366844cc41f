"""Areas under boxes, colours around and in them, and painted boxes, against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import regions

BOX = "item_id long, x0 int, y0 int, x1 int, y1 int"


def pictures(spark, arrays):
    rows = [(i, a.shape[0], a.shape[1], bytearray(a.tobytes())) for i, a in arrays.items()]
    return spark.createDataFrame(rows, "item_id long, height int, width int, pixels binary")


def noise(seed, h=20, w=24):
    return np.random.default_rng(seed).integers(0, 7, (h, w, 3)).astype(np.uint8) * 40


def ground(img, box, ring=regions.RING):
    (x0, y0, x1, y1), (h, w) = box, img.shape[:2]
    around = np.zeros((h, w), bool)
    around[max(0, y0 - ring) : y1 + ring, max(0, x0 - ring) : x1 + ring] = True
    inner = np.zeros((h, w), bool)
    inner[max(0, y0) : y1, max(0, x0) : x1] = True
    ringed = around & ~inner
    return np.median(img[ringed if ringed.any() else inner], axis=0), img[inner]


def test_areas_of_unions(spark):
    rng = np.random.default_rng(3)
    boxes = [(i, *(int(v) for v in (x, y, x + rng.integers(-2, 15), y + rng.integers(-2, 15)))) for i in (1, 2) for x, y in rng.integers(-10, 40, (60, 2))]
    boxes += [(1, 3, 3, 9, 9)] * 3 + [(1, None, 0, 4, 4), (3, 90, 90, 99, 99), (9, 0, 0, 5, 5)]
    sizes = spark.createDataFrame([(1, 30, 33), (2, 41, 20), (3, 10, 10), (4, 5, 5), (5, 0, 0)], "item_id long, height int, width int")
    for pad in (0, 4):
        got = {r["item_id"]: r for r in regions.mask_areas(sizes, spark.createDataFrame(boxes, BOX), pad).collect()}
        assert set(got) == {1, 2, 3, 4, 5}  # images without boxes stay, boxes without an image go
        for i, h, w in [(1, 30, 33), (2, 41, 20), (3, 10, 10), (4, 5, 5)]:
            held = np.zeros((h, w), bool)
            for k, x0, y0, x1, y1 in boxes:
                if k == i and x0 is not None:
                    more = pad + 1 if pad else 0
                    held[max(0, y0 - pad) : max(0, y1 + more), max(0, x0 - pad) : max(0, x1 + more)] = True
            assert (got[i]["area"], got[i]["share"]) == (held.sum(), pytest.approx(held.mean()))
        assert got[5]["area"] == 0 and got[5]["share"] is None and got[4]["n_boxes"] == 0


def test_many_boxes_of_one_image_leave_few_rows(spark):
    """However many boxes an image has, a band's window holds one row for each column at most."""
    boxes = spark.range(40000).select(F.lit(1).cast("long").alias("item_id"), (F.col("id") % 20).cast("int").alias("x0"), (F.col("id") % 7).cast("int").alias("y0"), (F.col("id") % 20 + F.col("id") % 11 + 1).cast("int").alias("x1"), (F.col("id") % 7 + 1).cast("int").alias("y1"))
    sizes = spark.createDataFrame([(1, 8, 40)], "item_id long, height int, width int")
    row = regions.mask_areas(sizes, boxes, 0).first()
    assert (row["n_boxes"], row["area"]) == (20 * 7 * 11, 7 * 30)


def test_grounds_and_inks(spark):
    boxes = [(0, 5, 5, 12, 9), (0, 0, 0, 24, 20), (0, -4, -4, 3, 3), (0, 20, 15, 40, 40), (1, 2, 2, 3, 3), (1, 2, 2, 3, 3), (1, 30, 2, 33, 3), (1, 6, 4, 6, 9), (1, None, 1, 2, 2), (7, 1, 1, 2, 2)]
    arrays = {0: noise(1), 1: noise(2), 2: noise(3), 3: np.zeros((0, 4, 3), np.uint8)}
    got = {(r["item_id"], r["x0"], r["y0"], r["x1"], r["y1"]): r for r in regions.box_colours(pictures(spark, arrays), spark.createDataFrame(boxes, BOX)).collect()}
    assert set(got) == {(0, *b[1:]) for b in boxes[:4]} | {(1, 2, 2, 3, 3)}
    for (i, *box), r in got.items():
        around, inside = ground(arrays[i], box)
        far = np.linalg.norm(inside - around, axis=1)
        ink = np.median(inside[far >= np.percentile(far, 75) - 1e-9], axis=0)
        assert (r["ground"], r["ink"]) == (np.floor(around).tolist(), np.floor(ink).tolist())


def test_no_images_and_no_boxes(spark):
    images, none = pictures(spark, {0: noise(1)}), spark.createDataFrame([], BOX)
    assert regions.box_colours(images, none).count() == 0
    assert regions.box_colours(images.limit(0), spark.createDataFrame([(0, 1, 1, 2, 2)], BOX)).count() == 0
    assert regions.mask_areas(images.limit(0), none).count() == 0


def test_painted_boxes_and_their_order(spark):
    img = noise(4)
    fills = [(0, 1, 2, 2, 6, 6, [1, 2, 3]), (0, 1, 5, 5, 9, 9, [7, 8, 9]), (0, 2, 23, 19, 24, 20, [0, 0, 255])]
    frame = spark.createDataFrame(fills, "item_id long, severity int, x0 int, y0 int, x1 int, y1 int, colour array<int>")
    got = {r["severity"]: np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(20, 24, 3) for r in regions.painted(pictures(spark, {0: img, 1: img}), frame, ["item_id", "severity"], 2).collect()}
    want = img.copy()
    want[0:9, 0:9], want[3:12, 3:12] = (1, 2, 3), (7, 8, 9)
    last = img.copy()
    last[17:20, 21:24] = (0, 0, 255)
    assert set(got) == {1, 2} and (got[1] == want).all() and (got[2] == last).all()


def test_severities_remove_one_mark_all_marks_and_all_words(spark):
    words = [(0, "Acme", 90.0, 0, 0, 5, 16), (0, "ACME!", 70.0, 8, 0, 12, 15), (0, "care", 88.0, 14, 2, 18, 6), (0, "a.", 99.0, 20, 2, 21, 4), (0, "unsure", 30.0, 1, 17, 4, 19), (1, "care", 95.0, 1, 1, 4, 4)]
    frame = spark.createDataFrame(words, "item_id long, word string, conf double, x0 int, y0 int, x1 int, y1 int")
    made = regions.wordmark_removal(pictures(spark, {0: noise(5), 1: noise(6)}), frame, ["acme"])
    assert sorted((r["item_id"], r["severity"], r["removed"]) for r in made.collect()) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 3, 1)]
    row = made.where("item_id = 1").first()
    want = noise(6)
    want[0:7, 0:7] = ground(want, (1, 1, 4, 4))[0].astype(np.uint8)
    assert bytes(row["pixels"]) == want.tobytes()

"""Boxes of images are measured where their row stands."""

from __future__ import annotations

import numpy as np
import pytest
from test_regions import BOX, ground, noise, pictures

from plumbline.operators import regions

CUT = [(0, 5, 5, 12, 9), (0, 0, 0, 24, 20), (0, -4, -4, 3, 3), (0, 20, 15, 40, 40), (1, 2, 2, 3, 3)]


def colours(frame):
    return {(r["item_id"], r["x0"], r["y0"], r["x1"], r["y1"]): (r["ground"], r["ink"]) for r in frame.collect()}


def measured(around, inside):
    far = np.linalg.norm(inside - around, axis=1)
    return np.floor(around).tolist(), np.floor(np.median(inside[far >= np.percentile(far, 75) - 1e-9], axis=0)).tolist()


@pytest.mark.parametrize("together", [1, 700, 1 << 20])
def test_any_number_of_windows_together(spark, monkeypatch, together):
    monkeypatch.setattr(regions, "TOGETHER", together)
    arrays = {0: noise(1), 1: noise(2)}
    got = colours(regions.box_colours(pictures(spark, arrays), spark.createDataFrame(CUT, BOX)))
    assert got == {b: measured(*ground(arrays[b[0]], b[1:])) for b in CUT}


def test_images_of_one_id_are_one(spark):
    one, two = noise(3), noise(4)
    both = pictures(spark, {0: one}).unionByName(pictures(spark, {0: two}))
    box = (0, 4, 4, 9, 8)
    got = colours(regions.box_colours(both, spark.createDataFrame([box], BOX)))
    ring, inner = [], []
    for img in (one, two):
        held = np.zeros(img.shape[:2], bool)
        held[max(0, box[2] - 6) : box[4] + 6, max(0, box[1] - 6) : box[3] + 6] = True
        held[box[2] : box[4], box[1] : box[3]] = False
        ring.append(img[held])
        inner.append(ground(img, box[1:])[1])
    assert got == {box: measured(np.median(np.concatenate(ring), axis=0), np.concatenate(inner))}


def test_images_without_all_their_pixels_give_no_row(spark):
    rows = [(0, 4, 4, bytearray(47)), (1, 4, 4, None), (2, 4, 4, bytearray(48))]
    images = spark.createDataFrame(rows, "item_id long, height int, width int, pixels binary")
    got = colours(regions.box_colours(images, spark.createDataFrame([(i, 1, 1, 2, 2) for i in range(3)], BOX)))
    assert got == {(2, 1, 1, 2, 2): ([0, 0, 0], [0, 0, 0])}


def test_no_pixel_becomes_a_row(spark, capsys):
    """Before, windows were taken apart into rows of pixels, which a task's hash tables held."""
    regions.box_colours(pictures(spark, {0: noise(1)}), spark.createDataFrame(CUT, BOX)).explain()
    assert "Generate " not in capsys.readouterr().out


@pytest.mark.parametrize("pad", [0, 4])
def test_areas_are_alike_however_they_are_swept(spark, monkeypatch, pad):
    rng = np.random.default_rng(8)
    boxes = [(int(i), *(int(v) for v in (x, y, x + w, y + h))) for i, x, y, w, h in zip(rng.integers(0, 9, 150), *rng.integers(-6, 30, (2, 150)), *rng.integers(-1, 9, (2, 150)), strict=True)]
    boxes += [(3, 1, 1, 5, 5)] * 4 + [(3, None, 1, 5, 5), (None, 1, 1, 2, 2), (77, 1, 1, 2, 2)]
    sizes = [(i, 5 * i, 33 - i) for i in range(12)]
    frames = spark.createDataFrame(sizes, "item_id long, height int, width int"), spark.createDataFrame(boxes, BOX)
    more, want = pad + 1 if pad else 0, set()
    for i, h, w in sizes:
        held, some = np.zeros((h, w), bool), set()
        for k, x0, y0, x1, y1 in boxes:
            if k == i and x0 is not None:
                c = max(0, x0 - pad), max(0, y0 - pad), min(w, x1 + more), min(h, y1 + more)
                if c[0] < c[2] and c[1] < c[3]:
                    some.add(c)
                    held[c[1] : c[3], c[0] : c[2]] = True
        want.add((i, len(some), int(held.sum())))
    for most in (64, 15, 0):  # all in rows, some, none
        monkeypatch.setattr(regions, "LISTED", most)
        got = regions.mask_areas(*frames, pad).collect()
        assert len(got) == 12 and {(r["item_id"], r["n_boxes"], r["area"]) for r in got} == want


def test_boxes_of_an_image_do_not_become_bands(spark, capsys):
    """Before, each box was a row for each band it lies in, all sorted."""
    sizes = spark.createDataFrame([(1, 30, 33)], "item_id long, height int, width int")
    regions.mask_areas(sizes, spark.createDataFrame([(1, 2, 2, 9, 9), (1, 4, 4, 12, 20)], BOX)).explain()
    plan = capsys.readouterr().out
    assert "Generate " not in plan and "Window " not in plan

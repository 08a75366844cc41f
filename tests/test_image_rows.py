"""Perturbations and hashes shuffle images, not pixels."""

from __future__ import annotations

import numpy as np

from plumbline.functions import pixels
from plumbline.operators import imaging


def _images(spark, sizes):
    rng = np.random.default_rng(7)
    rows = [(i, h, w, rng.integers(0, 256, h * w * 3, np.uint8).tobytes()) for i, (h, w) in enumerate(sizes)]
    return spark.createDataFrame([*rows, (90, 0, 5, b""), (91, 2, 2, None)], "item_id long, height int, width int, pixels binary")


def test_ladder_and_hash_take_no_pixel_apart(spark):
    images = _images(spark, [(9, 13), (16, 16), (1, 1), (40, 3)])
    made, hashes = imaging.ladder(images), imaging.perceptual_hashes(images)
    for frame in (made, hashes):
        assert not any(word in frame._jdf.queryExecution().executedPlan().toString() for word in ("Join", "HashAggregate"))
    rows = made.collect()
    assert len(rows) == 4 * 15 and all(len(r["pixels"]) == len(r["base"]) == 3 * r["height"] * r["width"] for r in rows)
    assert {r["item_id"] for r in hashes.collect()} == {0, 1, 2, 3}
    assert imaging.ladder(images.limit(0)).count() == 0 and imaging.perceptual_hashes(images.limit(0)).count() == 0


def test_recolouring_without_change_and_sampling_at_one_size():
    img = np.random.default_rng(1).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert (pixels.sampled(img, 6, 5) == img).all()
    grey = np.repeat(img[..., :1], 3, -1)
    assert (pixels.recoloured(grey, 57, 320) == grey).all()
    faded = pixels.recoloured(img, 0, 0)
    assert (faded == img.max(-1, keepdims=True)).all()

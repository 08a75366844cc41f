"""Perturbations and hashes of images, in whole numbers.

An image is a row.  What is done to it (windows, sizes, colours, pasted items) is worked out in columns, a row for each image,
perturbation and severity, and the pixels of a row are changed by small functions on arrays (``functions.pixels``) where the
row stands, so nothing but the images is shuffled: rows are dealt out by number, since an image's work is large beside its bytes.
Weights are Lanczos' in 65536ths, so sums are whole, do not depend on their order, and come out alike in any
engine; a value is rounded once, at the end.  Choices that look random are digits of
the MD5 of the image's id and what is chosen, so a ladder differs in severity only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.pixels import badged, recoloured, sampled
from plumbline.staging import staged

#: Rows whose changed images are held together.
SLICE = 64
#: Severity ladders. Hue in 256ths of the circle, saturation in hundredths, areas and stretches in thousandths, pasted items and their size in hundredths of the shorter side.
TURN = {1: 13, 2: 28, 3: 57}
MORE = {1: 160, 2: 230, 3: 320}
LESS = {1: 55, 2: 30, 3: 8}
REMOVED = {1: 180, 2: 380, 3: 580}
STRETCH = {1: 1180, 2: 1450, 3: 1900}
PASTED = {1: (1, 12), 2: (3, 18), 3: (6, 26)}
#: Where a crop keeps to: 0 the low end, 1 the high end, 2 anywhere; across and down.
HOLDS = ((0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 0), (2, 1))
SEVERITIES = (1, 2, 3)
#: Colours of pasted items: fifths of the circle at full strength.
VIVID = ((255, 0, 0), (204, 255, 0), (0, 255, 102), (0, 102, 255), (204, 0, 255))


def digit(name: str, modulus: Column | int, item: str = "item_id") -> Column:
    """A whole number below ``modulus`` that the image's id and ``name`` choose."""
    key = F.md5(F.concat_ws("|", F.col(item).cast("string"), F.lit(name)).cast("binary"))
    return F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("long"), modulus if isinstance(modulus, Column) else F.lit(modulus))


def dealt(images: DataFrame) -> DataFrame:
    """The images that have pixels, dealt out by number."""
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return images.where("height * width > 0 and pixels is not null").repartition(parts, F.xxhash64("item_id"))


def changed(rows: DataFrame, change: Callable[[dict, np.ndarray], np.ndarray], keep: list[str]) -> DataFrame:
    """``(keep, pixels)``: each row's image (``height, width, pixels``) after ``change(row, image)``."""
    kind = rows.select(*keep, "pixels").schema
    plan = [c for c in rows.columns if c not in ("pixels", "base")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                made = []
                for row, pixels in zip(batch.select(plan).to_pylist(), batch.column("pixels"), strict=True):
                    img = np.frombuffer(pixels.as_buffer(), np.uint8).reshape(row["height"], row["width"], 3)
                    made.append(change(row, img).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.binary())], names=[*keep, "pixels"])

    return rows.mapInArrow(run, kind)


def _each_severity(images: DataFrame) -> DataFrame:
    return images.select("item_id", "height", "width", "pixels", F.explode(F.array(*map(F.lit, SEVERITIES))).alias("severity"))


def _of(ladder: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ladder.items() for x in pair)), F.col("severity"))


#: What each row of a ladder keeps.
_BY = ["item_id", "corruption", "severity", "height", "width", "base"]


def recolouring(images: DataFrame) -> DataFrame:
    """The ladder's rows of both recolourings."""
    each = _each_severity(images).withColumn("corruption", F.explode(F.array(F.lit("hue_rotation"), F.lit("saturation"))))
    hue = F.col("corruption") == "hue_rotation"
    percent = F.when(digit("saturation", 2) == 0, _of(MORE)).otherwise(_of(LESS))
    each = each.withColumns({"base": F.col("pixels"), "turn": F.when(hue, _of(TURN)).otherwise(0), "percent": F.when(hue, 100).otherwise(percent)})
    return changed(each, lambda row, img: recoloured(img, row["turn"], row["percent"]), _BY)


def windows(images: DataFrame) -> DataFrame:
    """The ladder's rows of crops and stretches: the window ``y0, x0, ch, cw`` at size ``hh, ww``, of which ``h, w`` from ``oy, ox`` on are kept."""
    h, w = F.col("height"), F.col("width")
    each = _each_severity(images)
    keep = F.sqrt(1 - _of(REMOVED) / 1000)
    crop = each.withColumns({"ch": F.greatest(F.round(h * keep), F.lit(1)).cast("int"), "cw": F.greatest(F.round(w * keep), F.lit(1)).cast("int"), "hold": digit("crop", 8)})
    at = lambda axis, room: F.when(axis == 0, 0).when(axis == 1, room)
    axis = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in HOLDS)), (F.col("hold") + 1).cast("int"))
    free = lambda name, room: digit(name, room + 1).cast("int")
    room_y, room_x = h - F.col("ch"), w - F.col("cw")
    crop = crop.select("item_id", "height", "width", "pixels", F.lit("crop_violation").alias("corruption"), "severity", F.coalesce(at(axis(1), room_y), free("down", room_y)).alias("y0"), F.coalesce(at(axis(0), room_x), free("across", room_x)).alias("x0"), "ch", "cw",
                       h.alias("hh"), w.alias("ww"), F.lit(0).alias("oy"), F.lit(0).alias("ox"), h.alias("h"), w.alias("w"))
    wide = digit("stretch", 2) == 1
    longer = lambda size: F.round(size * _of(STRETCH) / 1000).cast("int")
    aspect = each.withColumns({"hh": F.when(wide, h).otherwise(longer(h)), "ww": F.when(wide, longer(w)).otherwise(w)})
    half = lambda a, b: F.floor((F.col(a) - b) / 2).cast("int")
    aspect = aspect.select("item_id", "height", "width", "pixels", F.lit("aspect_distortion").alias("corruption"), "severity", F.lit(0).alias("y0"), F.lit(0).alias("x0"), h.alias("ch"), w.alias("cw"), "hh", "ww", half("hh", h).alias("oy"), half("ww", w).alias("ox"), h.alias("h"), w.alias("w"))

    def cut(row: dict, img: np.ndarray) -> np.ndarray:
        part = img[row["y0"] : row["y0"] + row["ch"], row["x0"] : row["x0"] + row["cw"]]
        kept = sampled(part, row["hh"], row["ww"])[row["oy"] : row["oy"] + row["h"], row["ox"] : row["ox"] + row["w"]]
        return np.minimum(kept, 255)

    return changed(crop.unionByName(aspect).withColumn("base", F.col("pixels")), cut, _BY)


def clutter(images: DataFrame) -> DataFrame:
    """The ladder's rows of clutter: toothed badges pasted one over the other, and a banner at the highest severity."""
    count = _of({s: n for s, (n, _) in PASTED.items()})
    share = lambda name, k: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("item_id").cast("string"), F.lit(name), k.cast("string")).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(1000))
    radius = F.greatest(F.lit(1.0), F.least("height", "width") * _of({s: n for s, (_, n) in PASTED.items()}) / 200)
    badge = lambda k: F.struct((share("cy", k) * F.col("height") / 1000).alias("cy"), (share("cx", k) * F.col("width") / 1000).alias("cx"), F.pmod(share("hue", k), F.lit(len(VIVID))).cast("int").alias("hue"), F.col("radius"))
    each = _each_severity(images).withColumns({"base": F.col("pixels"), "corruption": F.lit("clutter"), "radius": radius, "count": count})
    each = each.withColumn("badges", F.transform(F.sequence(F.lit(1), F.col("count")), badge))
    return changed(each, lambda row, img: badged(img, row["badges"], VIVID, row["severity"] == 3), _BY)


def ladder_rows(images: DataFrame) -> DataFrame:
    """``(item_id, corruption, severity, height, width, base, pixels)`` of every image under every perturbation."""
    images = staged(dealt(images.select("item_id", "height", "width", "pixels")), "images")
    return recolouring(images).unionByName(windows(images)).unionByName(clutter(images))


#: The first eight cosines over 32 places, in 4096ths.
BASIS = np.array([[round(4096 * math.cos(math.pi * (2 * n + 1) * k / 64)) for n in range(32)] for k in range(8)])


def perceptual_hashes(images: DataFrame) -> DataFrame:
    """``(item_id, phash)``: signs of the 64 lowest frequencies of the grey image against their median, the first highest."""

    def low(row: dict, img: np.ndarray) -> np.ndarray:
        grey = img.astype(np.int64) @ np.array([299, 587, 114])
        cells = (BASIS @ sampled(grey[..., None], 32, 32)[..., 0] @ BASIS.T).ravel()
        middle = np.sort(cells)[31:33].sum()
        return np.packbits(2 * cells > middle)

    found = changed(dealt(images.select("item_id", "height", "width", "pixels")), low, ["item_id"])
    return found.select("item_id", sum((F.call_function("shiftleft", F.conv(F.hex(F.substring("pixels", k + 1, 1)), 16, 10).cast("long"), F.lit(56 - 8 * k)) for k in range(1, 8)), F.call_function("shiftleft", F.conv(F.hex(F.substring("pixels", 1, 1)), 16, 10).cast("long"), F.lit(56))).alias("phash"))

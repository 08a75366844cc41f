"""Image operators: rows of pixels in, rows of pixels or numbers out.

Measurements are aggregates over the colours of an image with their counts
(``colour_counts``); perturbed pixels and the hash are joins of pixel rows
(``operators.resample``).  Rows carry ``(item_id, height, width, pixels)``, pixels being RGB bytes; rows
of Spark's image source hold BGR and go through ``from_image_source`` first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import colour
from plumbline.functions import pixels as px
from plumbline.functions.vectors import let
from plumbline.operators.masks import wordmarks
from plumbline.operators.resample import ladder_rows, perceptual_hashes  # noqa: F401  the hash is an image operator
from plumbline.staging import staged


def from_image_source(rows: DataFrame, most: int = 1024) -> DataFrame:
    """Spark image rows (BGR, three channels) -> RGB rows no larger than ``most`` a side."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                img = px.bounded(_array(r.data, r.height, r.width)[..., ::-1], most)
                out.append((r.origin, img.shape[0], img.shape[1], img.tobytes()))
            yield pd.DataFrame(out, columns=["item_id", "height", "width", "pixels"])

    return rows.where("nChannels = 3").select("origin", "height", "width", "data").mapInPandas(run, "item_id string, height int, width int, pixels binary")


def _array(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(bytes(data), np.uint8).reshape(height, width, 3)


def ladder(images: DataFrame) -> DataFrame:
    """``(source_id, corruption, severity, height, width, base, pixels)``: each image under each perturbation and severity.

    What is chosen for an image does not depend on the severity, so that severity is all that varies along a ladder.
    """
    return ladder_rows(images).select(F.col("item_id").cast("string").alias("source_id"), "corruption", "severity", "height", "width", "base", "pixels")


def _pixel(i: Column, name: str = "pixels") -> Column:
    return F.substring(F.col(name), i * 3 + 1, F.lit(3))


def _channels(code: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of three bytes."""
    r, g, b = (F.conv(F.hex(F.substring(code, i, 1)), 16, 10).cast("int") for i in (1, 2, 3))
    return r, g, b


def _pixel_numbers() -> Column:
    return F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)


def colour_changes(made: DataFrame, by: list[str], before: str = "base", after: str = "pixels") -> DataFrame:
    """``(by, delta_e)``: mean Lab distance of the pixels of two images of one size.

    Pairs of colours are counted before their distance is taken.  Rows without pixels give nothing.
    """
    both = F.transform(_pixel_numbers(), lambda i: F.struct(_pixel(i, before).alias("x"), _pixel(i, after).alias("y")))
    pairs = made.where("height * width > 0").select(*by, F.explode(both).alias("p")).groupBy(*by, "p").agg(F.count("*").alias("n"))
    change = colour.delta_e76(*(colour.rgb_to_lab(*_channels(F.col(c))) for c in ("p.x", "p.y")))
    return pairs.groupBy(*by).agg((F.sum(change * F.col("n")) / F.sum("n")).alias("delta_e"))


def colour_counts(images: DataFrame, by: list[str]) -> DataFrame:
    """``(by, r, g, b, n)``: the colours of each group of images with their number of pixels."""
    codes = F.transform(_pixel_numbers(), lambda i: _pixel(i))
    counted = images.where("height * width > 0").select(*by, F.explode(codes).alias("code")).groupBy(*by, "code").agg(F.count("*").alias("n"))
    return counted.select(*by, *(c.alias(n) for n, c in zip("rgb", _channels(F.col("code")), strict=True)), "n")


def _top_and_low() -> tuple[Column, Column]:
    return F.greatest("r", "g", "b"), F.least("r", "g", "b")


def colour_stats(counts: DataFrame, by: list[str]) -> DataFrame:
    """``(by, sat_mean, colorfulness)`` of ``colour_counts``; all sums are whole numbers, so exact in any order.

    Saturation is that of HSV in whole 255ths.  Colourfulness is Hasler and
    Suesstrunk's, the whole sum divided by 255.
    """
    top, low = _top_and_low()
    sat = F.when(top > 0, F.floor((top - low) * 255 / top)).otherwise(0)
    rg, yb2 = F.col("r") - F.col("g"), F.col("r") + F.col("g") - 2 * F.col("b")  # the second is doubled
    sums = {"sat": sat, "x": rg, "xx": rg * rg, "y": yb2, "yy": yb2 * yb2}
    rows = counts.groupBy(*by).agg(F.sum("n").alias("all"), *(F.sum(c.cast("long") * F.col("n")).alias(n) for n, c in sums.items()))
    square = lambda c: F.col(c).cast("double") / F.col("all") * F.col(c) / F.col("all")
    spread = F.col("xx") / F.col("all") - square("x") + (F.col("yy") / F.col("all") - square("y")) / 4
    shift = square("x") + square("y") / 4
    score = (F.sqrt(F.greatest(spread, F.lit(0.0))) + 0.3 * F.sqrt(shift)) / 255
    return rows.select(*by, (F.col("sat") / F.col("all") / 255).alias("sat_mean"), score.alias("colorfulness"))


def palettes(counts: DataFrame, by: list[str], k: int, steps: int, least_chroma: float, least_pixels: int = 0) -> DataFrame:
    """``(by, centres, share)``: k-means in Lab over the coloured pixels of each group, by falling share.

    Colours are points weighted by their pixels, so no pixel is left out and no
    group meets in one task: a step is a join with the group's centres and two
    aggregates of map-side combined sums.  Lab is held in whole thousandths, so
    sums and hence centres do not depend on the order of rows.  The first
    centres are the most frequent colours (ties to the smaller); a group with
    fewer colours has fewer centres, and one without coloured pixels is absent.
    Where less than ``least_pixels`` of a group are coloured, all count.
    """
    top, low = _top_and_low()
    coloured = F.when(top > 0, (top - low) / top).otherwise(0.0) >= least_chroma
    lab = [F.round(c * 1000).cast("long").alias(n) for n, c in zip("lab", colour.rgb_to_lab(*(F.col(c).cast("double") for c in "rgb")), strict=True)]
    code = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    points = counts.withColumn("coloured", coloured).select(*by, "coloured", code.alias("code"), "n", *lab)
    if least_pixels:
        many = points.groupBy(*by).agg((F.coalesce(F.sum(F.when(F.col("coloured"), F.col("n"))), F.lit(0)) >= least_pixels).alias("many"))
        points = points.join(many, by).where("coloured or not many").drop("many")
    else:
        points = points.where("coloured")
    points = staged(points.drop("coloured"), "colours")
    first = points.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "code"))).where(F.col("at") <= k)
    where = F.struct(*(F.col(c).cast("double").alias(c) for c in "lab"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", where.alias("c")))), lambda x: x["c"])
    centres = staged(first.groupBy(*by).agg(in_order.alias("centres")), "centres")
    for _ in range(steps):
        sums = _assigned(points, centres, by, k).agg(F.any_value("centres").alias("centres"), F.sum("n").alias("n"), *(F.sum(F.col(c) * F.col("n")).alias(c) for c in "lab"))
        mean = F.struct(*((F.col(c) / F.col("n")).alias(c) for c in "lab"))
        moved = sums.groupBy(*by).agg(F.any_value("centres").alias("centres"), F.map_from_entries(F.collect_list(F.struct("j", mean.alias("c")))).alias("moved"))
        step = F.transform("centres", lambda c, j: F.coalesce(F.try_element_at("moved", j), c))
        centres = staged(moved.select(*by, step.alias("centres")), "centres")
    held = _assigned(points, centres, by, k).agg(F.sum("n").alias("n")).join(centres, by)
    entry = F.struct((-F.col("n")).alias("n"), "j", F.get("centres", F.col("j")).alias("c"))
    rows = held.groupBy(*by).agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(entry)).alias("e"))
    centre = F.transform("e", lambda x: F.array(*(x["c"][c] / 1000 for c in "lab")))
    return rows.select(*by, centre.alias("centres"), F.transform("e", lambda x: -x["n"] / F.col("all")).alias("share"))


def _assigned(points: DataFrame, centres: DataFrame, by: list[str], k: int):
    """Points grouped by their nearest centre ``j``, ties to the first."""

    def reach(j: int) -> Column:
        c = F.get("centres", F.lit(j))
        gaps = [F.col(n) - c[n] for n in "lab"]
        return F.when(c.isNotNull(), F.struct((gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]).alias("d"), F.lit(j).alias("j")))

    nearest = F.least(*map(reach, range(k)), reach(0))
    return points.join(centres, by).withColumn("j", nearest["j"]).groupBy(*by, "j")


def rule_features(images: DataFrame, palette: list[list[float]], words: DataFrame | None = None, marks: list[str] | None = None) -> DataFrame:
    """``(item_id, palette_de, sat_mean, colorfulness, wordmark, text_frac)``; the palette is in Lab.

    ``palette_de`` is the share-weighted CIEDE2000 distance of the five dominant
    colours to the nearest palette colour.  ``wordmark`` and ``text_frac`` (the
    share of the image that sure words cover) come from recognised
    ``words(item_id, word, conf, x0, y0, x1, y1)`` and are 0 without any.
    """
    counts = staged(colour_counts(images, ["item_id"]), "colours")
    point = lambda c: (c[0], c[1], c[2])
    first = point(list(map(F.lit, palette[0])))
    nearest = lambda c: F.least(*(colour.ciede2000(point(c), tuple(map(F.lit, p))) for p in palette), colour.ciede2000(point(c), first))
    total = F.aggregate(F.zip_with("centres", "share", lambda c, s: nearest(c) * s), F.lit(0.0), lambda a, x: a + x)
    distance = palettes(counts, ["item_id"], 5, 15, 0.06, 100).select("item_id", total.alias("palette_de"))
    rows = distance.join(colour_stats(counts, ["item_id"]), "item_id")
    if words is None:
        return rows.withColumns({"wordmark": F.lit(0.0), "text_frac": F.lit(0.0)})
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    covered = words.where("conf >= 50").groupBy("item_id").agg(F.sum(area).alias("covered"))
    marked = wordmarks(words, marks or []).select("item_id", F.lit(1.0).alias("wordmark")).distinct()
    sizes = images.select("item_id", (F.col("height") * F.col("width")).alias("size"))
    rows = rows.join(sizes, "item_id").join(covered, "item_id", "left").join(marked, "item_id", "left")
    return rows.select(*distance.columns, "sat_mean", "colorfulness", F.coalesce("wordmark", F.lit(0.0)).alias("wordmark"), (F.coalesce("covered", F.lit(0)) / F.col("size")).alias("text_frac"))


def brand_palette(images: DataFrame, by: str, k: int = 6, steps: int = 25, least_chroma: float = 0.08) -> DataFrame:
    """Palette of each brand from all coloured pixels of its images: ``(brand, lab, share)``."""
    rows = images.withColumn("brand", F.col(by).cast("string"))
    found = palettes(colour_counts(rows, ["brand"]), ["brand"], k, steps, least_chroma)
    return found.select("brand", F.col("centres").alias("lab"), "share")


#: How far a colour moves by severity, and how near it must lie to the own palette.
REMAP_BLEND = {1: 0.45, 2: 0.75, 3: 1.0}
REMAP_REACH = 25.0


def colour_remap(images: DataFrame, own: list[list[float]], other: list[list[float]], severity: int) -> DataFrame:
    """Images with the colours near the own palette moved towards the nearest colour of another (both in Lab).

    Lightness moves by 15 %, so that shading stays.
    """
    fixed = lambda p: tuple(F.lit(float(x)) for x in p)
    share = (0.15, REMAP_BLEND[severity], REMAP_BLEND[severity])

    def moved(old: Column) -> Column:
        return let(F.array(*colour.rgb_to_lab(old[0], old[1], old[2])), lambda at: recoded_at(old, (at[0], at[1], at[2])))

    def recoded_at(old: Column, at: tuple) -> Column:
        gap = lambda p: colour.delta_e76(at, fixed(p))
        near = F.array_min(F.array(*map(gap, own))) < REMAP_REACH
        goal = F.array_min(F.array(*(F.struct(gap(p).alias("d"), F.array(*fixed(p)).alias("p")) for p in other)))["p"]
        lab = let(goal, lambda g: F.array(*(x + (g[c] - x) * share[c] for c, x in enumerate(at))))
        new = let(lab, lambda x: F.array(*colour.lab_to_rgb(x[0], x[1], x[2])))
        kept = let(F.when(near, new).otherwise(old), lambda x: F.concat(*(F.lpad(F.hex(F.round(x[c]).cast("long")), 2, "0") for c in range(3))))
        return kept

    recoded = F.unhex(F.array_join(F.transform(_pixel_numbers(), lambda i: let(F.array(*(c.cast("double") for c in _channels(_pixel(i)))), moved)), ""))
    return images.withColumn("pixels", F.when(F.col("height") * F.col("width") > 0, recoded).otherwise(F.col("pixels")))

"""Regions of images: areas that boxes cover, colours around and inside boxes, and boxes painted over.

Boxes are rows ``(item_id, x0, y0, x1, y1)`` in pixels, right and lower ends exclusive, and are cut
to their image.  An image's bytes meet its boxes in one join, and a box's window is taken out of them and measured
where the row stands, in whole numbers, so no pixel is shuffled on its own.  Boxes that are null in a
corner, empty, outside their image or of an image without (all) its pixels give no row; equal boxes of an image are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.masks import wordmarks
from plumbline.operators.resample import SEVERITIES
from plumbline.staging import staged

#: How far the ring around a box reaches, how far paint and masks reach beyond it, and what a legible word holds.
RING = 6
PAINT = 2
MASK_PAD = 4
LEGIBLE_CONF = 60
LEGIBLE_SIGNS = 3

CORNERS = ["x0", "y0", "x1", "y1"]
#: The most boxes of an image that are swept in one row.
LISTED = 64
#: Bytes of windows whose pixels are measured together; a window is never divided.
TOGETHER = 1 << 20


def _cut(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """Corners cut to the image of ``height`` and ``width``."""
    inside = lambda c, size: F.least(F.greatest(c, F.lit(0)), F.col(size)).cast("int")
    return [inside(x0, "width"), inside(y0, "height"), inside(x1, "width"), inside(y1, "height")]


def _grown(pad: int) -> list[Column]:
    """Corners moved outwards by ``pad``; as filled rectangles include their last row and column, one more there."""
    more = pad + 1 if pad else 0
    return [F.col("x0") - pad, F.col("y0") - pad, F.col("x1") + more, F.col("y1") + more]


def mask_areas(images: DataFrame, boxes: DataFrame, pad: int = MASK_PAD) -> DataFrame:
    """``(item_id, n_boxes, area, share)`` of every image of ``images(item_id, height, width)``: what its boxes cover together.

    A sweep: the upper and lower ends of an image's boxes cut it into bands; a box lies in whole bands,
    and in a band the covered stretches are joined from left to right.  The boxes of an image are swept in its row; images
    with more than ``LISTED`` boxes are swept over rows of bands.
    ``n_boxes`` counts different boxes that are left after cutting; an image without any has area 0, one
    without pixels a null share.
    """
    size = images.select("item_id", "height", "width")
    grown = boxes.dropna(subset=CORNERS).select("item_id", *(c.cast("long").alias(n) for c, n in zip(_grown(pad), CORNERS, strict=True)))
    crowded = staged(grown.where("item_id is not null").groupBy("item_id").count().where(F.col("count") > LISTED).select("item_id"), "crowded")
    if crowded.isEmpty():
        held = _swept_rows(size, grown)
    else:
        held = _swept_rows(size.join(crowded, "item_id", "left_anti"), grown.join(crowded, "item_id", "left_anti"))
        held = held.unionByName(_swept_bands(size.join(crowded, "item_id"), grown.join(crowded, "item_id")))
    return held.select("item_id", "n_boxes", "area", F.try_divide("area", F.col("height") * F.col("width")).alias("share"))


def _swept_rows(size: DataFrame, boxes: DataFrame) -> DataFrame:
    """``size`` with ``n_boxes`` and ``area``; an image has few boxes."""
    listed = boxes.groupBy("item_id").agg(F.collect_set(F.struct(*CORNERS)).alias("boxes"))
    cut = lambda b: F.struct(*(c.alias(n) for c, n in zip(_cut(*(b[n] for n in CORNERS)), CORNERS, strict=True)))
    some = lambda b: (b["x0"] < b["x1"]) & (b["y0"] < b["y1"])
    rows = size.join(listed, "item_id", "left").withColumn("boxes", F.array_sort(F.array_distinct(F.filter(F.transform("boxes", cut), some))))  # by x0
    rows = rows.withColumn("ends", F.array_sort(F.array_distinct(F.flatten(F.transform("boxes", lambda b: F.array(b["y0"], b["y1"]))))))
    none, zero = F.lit(0).cast("int"), F.lit(0).cast("long")

    def stretches(top: Column) -> Column:
        """What is covered of the band that begins at ``top``."""
        further = lambda held, b: F.struct(F.greatest(held["reach"], b["x1"]).alias("reach"), (held["wide"] + F.greatest(b["x1"] - F.greatest(b["x0"], held["reach"]), none)).alias("wide"))
        step = lambda held, b: F.when((b["y0"] <= top) & (b["y1"] > top), further(held, b)).otherwise(held)
        return F.aggregate("boxes", F.struct(none.alias("reach"), none.alias("wide")), step, lambda held: held["wide"])

    # above the first end nothing is covered
    band = lambda held, low: F.struct(low.alias("top"), (held["area"] + (low - held["top"]).cast("long") * stretches(held["top"])).alias("area"))
    area = F.aggregate("ends", F.struct(none.alias("top"), zero.alias("area")), band, lambda held: held["area"])
    return rows.select("item_id", "height", "width", F.coalesce(F.when(F.col("boxes").isNotNull(), F.size("boxes").cast("long")), zero).alias("n_boxes"), F.coalesce(area, zero).alias("area"))


def _swept_bands(size: DataFrame, boxes: DataFrame) -> DataFrame:
    """``_swept_rows`` for images of any number of boxes.

    In a band, boxes that begin at one column are one before the sort, so a window holds at most an image's width of rows.
    """
    cut = boxes.join(size, "item_id").select("item_id", *(c.alias(n) for c, n in zip(_cut(*map(F.col, CORNERS)), CORNERS, strict=True)))
    cut = staged(cut.where("x0 < x1 and y0 < y1").distinct(), "boxes")
    ends = cut.select("item_id", F.explode(F.array("y0", "y1")).alias("y")).distinct()
    ends = ends.groupBy("item_id").agg(F.array_sort(F.collect_list("y")).alias("ends"))  # at most height + 1
    bands = F.filter(F.arrays_zip(F.col("ends").alias("top"), F.slice("ends", F.lit(2), F.size("ends")).alias("low")), lambda b: (b["top"] >= F.col("y0")) & (b["top"] < F.col("y1")))
    rows = cut.join(ends, "item_id").select("item_id", "x0", "x1", F.explode(bands).alias("band"))
    rows = rows.groupBy("item_id", "band", "x0").agg(F.max("x1").alias("x1"))
    left = Window.partitionBy("item_id", "band").orderBy("x0").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("x1") - F.greatest("x0", F.coalesce(F.max("x1").over(left), F.lit(0))), F.lit(0))
    held = rows.select("item_id", (new * (F.col("band.low") - F.col("band.top"))).cast("long").alias("area"))
    held = held.groupBy("item_id").agg(F.sum("area").alias("area")).join(cut.groupBy("item_id").agg(F.count("*").alias("n_boxes")), "item_id")
    return size.join(held, "item_id", "left").select("item_id", "height", "width", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_boxes", "area")))


def _pieces(images: DataFrame, boxes: DataFrame, ring: int) -> DataFrame:
    """``(item_id, x0, y0, x1, y1, around, inside)``: the lines of pixels inside each box, and those of the ring about it, as bytes.

    A row is a box beside its image.  Images of one id count as one image of all their pixels.
    """
    alike = not images.groupBy("item_id").count().where("count > 1").isEmpty()  # reads ids only
    rows = images.where("height * width > 0 and octet_length(pixels) >= height * width * 3").select("item_id", "height", "width", "pixels")
    rows = rows.join(boxes.select("item_id", *CORNERS).dropna().distinct(), "item_id")
    cut, far = _cut(*map(F.col, CORNERS)), _cut(F.col("x0") - ring, F.col("y0") - ring, F.col("x1") + ring, F.col("y1") + ring)
    rows = rows.select("item_id", *CORNERS, "width", "pixels", *(c.alias(f"b{n}") for c, n in zip(cut, CORNERS, strict=True)), *(c.alias(f"w{n}") for c, n in zip(far, CORNERS, strict=True))).where("bx0 < bx1 and by0 < by1")

    def line(y: Column, left: str, right: str) -> Column:
        return F.substring(F.col("pixels"), (y * F.col("width") + F.col(left)) * 3 + 1, (F.col(right) - F.col(left)) * 3)

    beside = lambda y: F.when((y >= F.col("by0")) & (y < F.col("by1")), F.array(line(y, "wx0", "bx0"), line(y, "bx1", "wx1"))).otherwise(F.array(line(y, "wx0", "wx1")))
    around = F.flatten(F.transform(F.sequence("wy0", F.col("wy1") - 1), beside))
    rows = rows.select("item_id", *CORNERS, around.alias("around"), F.transform(F.sequence("by0", F.col("by1") - 1), lambda y: line(y, "bx0", "bx1")).alias("inside"))
    if alike:
        rows = rows.groupBy("item_id", *CORNERS).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("around", "inside")))
    return rows


def _pixels(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of all rows one after the other, and how many a row has."""
    joined = pc.binary_join(lines, b"").cast(pa.large_binary())
    at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].reshape(-1, 3), np.diff(at) // 3


def _twice_medians(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Twice the median of each channel over the pixels of each row, the two middle values added; no row is without pixels."""
    row, first = np.repeat(np.arange(len(counts)), counts) * 256, np.cumsum(counts) - counts
    ordered = [np.sort(row + values[:, k]) for k in range(3)]
    return np.stack([v[first + (counts - 1) // 2] % 256 + v[first + counts // 2] % 256 for v in ordered], 1)


def _sides(around: pa.Array, inside: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ground and ink of each row, as ``box_colours`` has them."""
    (ring, n_ring), (inner, n) = _pixels(around), _pixels(inside)
    row, first, bare = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n, n_ring == 0
    twice = np.empty((len(n), 3), np.int64)
    twice[~bare] = _twice_medians(ring, n_ring[~bare])
    twice[bare] = _twice_medians(inner[bare[row]], n[bare])
    far = ((2 * inner.astype(np.int64) - twice[row]) ** 2).sum(1)  # below 2 ** 20
    least = np.sort((row << 20) + far)[first + (3 * (n - 1) + 3) // 4] % (1 << 20)
    kept = far >= least[row]
    return twice // 2, _twice_medians(inner[kept], np.bincount(row[kept], minlength=len(n))) // 2


def box_grounds(images: DataFrame, boxes: DataFrame, ring: int = RING) -> DataFrame:
    """``(item_id, x0, y0, x1, y1, colour)``: the colour around each box, as in ``box_colours``."""
    return box_colours(images, boxes, ring).select("item_id", *CORNERS, F.col("ground").alias("colour"))


def box_colours(images: DataFrame, boxes: DataFrame, ring: int = RING) -> DataFrame:
    """``(item_id, x0, y0, x1, y1, ground, ink)``: the colour around each box and the colour of what is written in it.

    ``ground`` is the median of each channel in the ring around the box; a box that fills its
    window has no ring, and its own pixels stand in.  ``ink`` is the median of the box's pixels whose distance to
    the ground is no less than the upper quartile of such distances, interpolated between ranks as is usual: the pixels from rank
    ceil(3 (n - 1) / 4) on and those as far as they.  Medians between two values are rounded down.
    """
    rows = _pieces(images, boxes, ring)
    keep = ["item_id", *CORNERS]
    three = T.ArrayType(T.IntegerType())
    kind = T.StructType([*rows.select(*keep).schema, T.StructField("ground", three), T.StructField("ink", three)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, TOGETHER * len(whole) // max(whole.nbytes, 1))
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                ends = pa.array(np.arange(0, 3 * len(batch) + 1, 3, dtype=np.int32))
                sides = [pa.ListArray.from_arrays(ends, pa.array(c.ravel().astype(np.int32))) for c in _sides(batch.column("around"), batch.column("inside"))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *sides], names=[*keep, "ground", "ink"])

    return rows.mapInArrow(run, kind)


def painted(images: DataFrame, fills: DataFrame, by: list[str], pad: int = PAINT) -> DataFrame:
    """``(by, height, width, pixels)`` of images with boxes painted over; ``by`` begins with ``item_id``.

    ``fills(by, x0, y0, x1, y1, colour)`` may paint an image several times under different ``by``; each such image is a row, and one
    without fills is none.  Boxes reach ``pad`` further, last row and column included; where they overlap, the box whose
    corners come later in order wins.  An image is taken apart into lines, and a line meets the stretches painted in it.
    """
    size = images.where("height * width > 0").select("item_id", "height", "width")
    cut = fills.join(size, "item_id").select(*by, F.array(*CORNERS).alias("order"), "colour", *(c.alias(n) for c, n in zip(_cut(*_grown(pad)), CORNERS, strict=True))).where("x0 < x1 and y0 < y1")
    spans = cut.select(*by, F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), F.struct("order", "x0", "x1", "colour").alias("s"))
    spans = spans.groupBy(*by, "y").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    start = F.col("y") * F.col("width") * 3
    lines = images.where("height * width > 0").select("item_id", "width", "pixels", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    lines = lines.select("item_id", "y", F.hex(F.substring("pixels", start + 1, F.col("width") * 3)).alias("line"))
    each = cut.select(*by).distinct().join(lines, "item_id").join(spans, [*by, "y"], "left")

    def over(line: Column, s: Column) -> Column:
        code = F.concat(*(F.lpad(F.hex(F.get(s["colour"], F.lit(k)).cast("long")), 2, "0") for k in range(3)))
        return F.concat(F.substring(line, F.lit(1), s["x0"] * 6), F.repeat(code, s["x1"] - s["x0"]), F.substring(line, s["x1"] * 6 + 1, F.length(line)))

    new = F.when(F.col("spans").isNull(), F.col("line")).otherwise(F.aggregate("spans", F.col("line"), over))
    held = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y", new.alias("line")))).alias("p"))  # an image's lines
    return held.select(*by, F.unhex(F.array_join(F.transform("p", lambda p: p["line"]), "")).alias("pixels")).join(size, "item_id").select(*by, "height", "width", "pixels")


def removal_targets(words: DataFrame, marks: list[str]) -> DataFrame:
    """``(item_id, severity, x0, y0, x1, y1)``: the words that wordmark removal takes away.

    Severity 1: one wordmark, the first by the MD5 of its corners; 2: all wordmarks; 3: all wordmarks and all
    legible words (sure, with three letters or digits at least).  An image without a wordmark has no rows at 1 and 2.
    """
    corners = F.array(*map(F.col, CORNERS))
    found = wordmarks(words, marks, LEGIBLE_CONF).select("item_id", *CORNERS).distinct()
    one = found.groupBy("item_id").agg(F.min_by(corners, F.struct(F.md5(F.concat_ws(",", *CORNERS).cast("binary")), corners)).alias("c"))
    one = one.select("item_id", *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate(CORNERS)))
    signs = F.length(F.regexp_replace("word", r"[^\p{L}\p{N}]", ""))
    legible = words.where((F.col("conf") >= LEGIBLE_CONF) & (signs >= LEGIBLE_SIGNS)).select("item_id", *CORNERS)
    parts = [one, found, found.unionByName(legible).distinct()]
    rows = [p.select("item_id", F.lit(s).alias("severity"), *CORNERS) for s, p in zip(SEVERITIES, parts, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).dropna()


def wordmark_removal(images: DataFrame, words: DataFrame, marks: list[str], ring: int = RING, pad: int = PAINT) -> DataFrame:
    """``(item_id, severity, removed, height, width, pixels)``: words painted over in the colour around them, by severity.

    Colours are those around the words of the given image, whatever else is painted, so the order of words does
    not matter.  An image and severity with nothing to remove gives no row: it would be a clean image under a false label.
    """
    targets = staged(removal_targets(words, marks), "targets")
    grounds = staged(box_grounds(images, targets.select("item_id", *CORNERS), ring), "fills")
    fills = targets.join(grounds, ["item_id", *CORNERS])
    counted = fills.groupBy("item_id", "severity").agg(F.count("*").alias("removed"))
    made = painted(images, fills, ["item_id", "severity"], pad)
    return made.join(counted, ["item_id", "severity"]).select("item_id", "severity", "removed", "height", "width", "pixels")

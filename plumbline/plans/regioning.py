"""Queries of boxes in images."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import regions
from plumbline.operators.resample import digit
from plumbline.plans.probing import PIXELS_SQL, digit_sql, images
from plumbline.plans.registry import query, r6
from plumbline.staging import table


@query("""WITH bx AS (SELECT DISTINCT l_orderkey AS k, greatest(l_partkey % 110 - 4, 0) AS x0, greatest(l_suppkey % 90 - 4, 0) AS y0,
    least(l_partkey % 110 + l_quantity::int % 30 + 5, 120) AS x1, least(l_suppkey % 90 + 3 * l_linenumber + 5, 100) AS y1 FROM lineitem),
  ln AS (SELECT k, x0, x1, unnest(range(y0, y1)) AS y FROM bx),
  rt AS (SELECT k, x1 - greatest(x0, coalesce(max(x1) OVER (PARTITION BY k, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS d FROM ln),
  ar AS (SELECT k, sum(greatest(d, 0)) AS area FROM rt GROUP BY 1), nb AS (SELECT k, count(*) AS n FROM bx GROUP BY 1)
SELECT o_orderkey AS item_id, coalesce(n, 0)::bigint AS n_boxes, coalesce(area, 0)::bigint AS area, round(coalesce(area, 0) / 12000.0::double, 6) AS share FROM orders LEFT JOIN ar ON ar.k = o_orderkey LEFT JOIN nb ON nb.k = o_orderkey""")
def mask_areas(spark, sf):
    """Orders as images of 120 by 100, their lines as boxes to mask."""
    sizes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.lit(100).alias("height"), F.lit(120).alias("width"))
    x, y = F.col("l_partkey") % 110, F.col("l_suppkey") % 90
    boxes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), x.alias("x0"), y.alias("y0"), (x + F.round("l_quantity").cast("int") % 30).alias("x1"), (y + 3 * F.col("l_linenumber")).alias("y1"))
    return regions.mask_areas(sizes, boxes).withColumn("share", r6("share"))


#: Boxes of an image: two by its digits, and for a fifth of the images one that is all of it.
_NAMES = ("a", "b")


def _boxes(pictures):
    edge = lambda n, axis: digit(f"{n}{axis}", 14).cast("int")
    size = lambda n, axis: (1 + digit(f"{n}{axis} size", 6)).cast("int")
    made = [F.struct(edge(n, "x").alias("x0"), edge(n, "y").alias("y0"), (edge(n, "x") + size(n, "x")).alias("x1"), (edge(n, "y") + size(n, "y")).alias("y1")) for n in _NAMES]
    whole = F.when(digit("whole", 5) == 0, F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(16).alias("x1"), F.lit(16).alias("y1")))
    return pictures.select("item_id", F.explode(F.array(*made, whole)).alias("e")).select("item_id", "e.*").dropna()


_BOXES_SQL = " UNION ".join(
    f"SELECT item_id, {digit_sql(f'{n}x', 14)} AS x0, {digit_sql(f'{n}y', 14)} AS y0, x0 + 1 + {digit_sql(f'{n}x size', 6)} AS x1, y0 + 1 + {digit_sql(f'{n}y size', 6)} AS y1 FROM sh" for n in _NAMES
) + f" UNION SELECT item_id, 0, 0, 16, 16 FROM sh WHERE {digit_sql('whole', 5)} = 0"
_GROUNDS_SQL = """mt AS (SELECT bx.*, r, g, b, px.x >= x0 AND px.x < x1 AND px.y >= y0 AND px.y < y1 AS inside FROM bx JOIN px ON px.item_id = bx.item_id AND px.x >= x0 - 6 AND px.x < x1 + 6 AND px.y >= y0 - 6 AND px.y < y1 + 6),
  rg AS (SELECT *, inside <> bool_or(NOT inside) OVER (PARTITION BY item_id, x0, y0, x1, y1) AS around FROM mt),
  gd AS (SELECT item_id, x0, y0, x1, y1, median(r) FILTER (around) AS gr, median(g) FILTER (around) AS gg, median(b) FILTER (around) AS gb FROM rg GROUP BY ALL)"""


@query(f"""WITH {PIXELS_SQL}, bx AS ({_BOXES_SQL}), {_GROUNDS_SQL},
  dd AS (SELECT mt.*, gr, gg, gb, (r - gr) * (r - gr) + (g - gg) * (g - gg) + (b - gb) * (b - gb) AS d FROM mt JOIN gd USING (item_id, x0, y0, x1, y1) WHERE inside),
  lm AS (SELECT *, quantile_cont(sqrt(d), 0.75) OVER (PARTITION BY item_id, x0, y0, x1, y1) AS q FROM dd)
SELECT item_id, x0::int AS x0, y0::int AS y0, x1::int AS x1, y1::int AS y1, floor(any_value(gr))::int AS ground_r, floor(any_value(gg))::int AS ground_g, floor(any_value(gb))::int AS ground_b,
  floor(median(r))::int AS ink_r, floor(median(g))::int AS ink_g, floor(median(b))::int AS ink_b FROM lm WHERE sqrt(d) >= q - 1e-9 GROUP BY ALL""")
def box_colours(spark, sf):
    """Colours around and inside two or three boxes of every image."""
    pictures = images(spark, sf)
    found = regions.box_colours(pictures, _boxes(pictures))
    return found.select("item_id", *regions.CORNERS, *(F.get(side, F.lit(k)).alias(f"{side}_{c}") for side in ("ground", "ink") for k, c in enumerate("rgb")))


#: What the words of an image say, by its digits; two of five are the mark.
_TEXTS = ("Acme", "ACME!", "care", "a.", "new day")
_WORDS = ("u", "v", "w")


def _words(pictures):
    text = lambda n: F.element_at(F.array(*map(F.lit, _TEXTS)), (digit(f"{n} text", len(_TEXTS)) + 1).cast("int"))
    number = lambda n, what, modulus: digit(f"{n} {what}", modulus).cast("int")
    made = [
        F.struct(text(n).alias("word"), (40 + digit(f"{n} conf", 60)).cast("double").alias("conf"), number(n, "x", 14).alias("x0"), number(n, "y", 3).alias("y0"),
                 (number(n, "x", 14) + 1 + number(n, "width", 4)).alias("x1"), (number(n, "y", 3) + 12 + number(n, "height", 4)).alias("y1")) for n in _WORDS
    ]
    return pictures.select("item_id", F.explode(F.array(*made)).alias("e")).select("item_id", "e.*")


_WORDS_SQL = " UNION ALL ".join(
    f"SELECT item_id, [{', '.join(repr(t) for t in _TEXTS)}][{digit_sql(f'{n} text', len(_TEXTS))} + 1] AS word, 40 + {digit_sql(f'{n} conf', 60)} AS conf, {digit_sql(f'{n} x', 14)} AS x0, {digit_sql(f'{n} y', 3)} AS y0, x0 + 1 + {digit_sql(f'{n} width', 4)} AS x1, y0 + 12 + {digit_sql(f'{n} height', 4)} AS y1 FROM sh"
    for n in _WORDS
)


@query(f"""WITH {PIXELS_SQL}, wd AS ({_WORDS_SQL}), mk AS (SELECT DISTINCT item_id, x0, y0, x1, y1 FROM wd WHERE word IN ('Acme', 'ACME!') AND conf >= 60 AND y1 - y0 >= 14),
  tg AS (SELECT item_id, 1 AS severity, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5(concat_ws(',', x0, y0, x1, y1)), x0, y0, x1, y1) AS pos FROM mk) WHERE pos = 1
    UNION ALL SELECT item_id, 2, x0, y0, x1, y1 FROM mk
    UNION ALL (SELECT item_id, 3, x0, y0, x1, y1 FROM mk UNION SELECT item_id, 3, x0, y0, x1, y1 FROM wd WHERE conf >= 60 AND length(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) >= 3)),
  bx AS (SELECT DISTINCT item_id, x0, y0, x1, y1 FROM tg), {_GROUNDS_SQL},
  sv AS (SELECT item_id, severity, count(*) AS removed FROM tg GROUP BY ALL),
  hi AS (SELECT px.item_id, severity, px.y, px.x, arg_max([floor(gr), floor(gg), floor(gb)], [x0, y0, x1, y1]) AS c FROM tg JOIN gd USING (item_id, x0, y0, x1, y1) JOIN px ON px.item_id = tg.item_id AND px.x BETWEEN x0 - 2 AND x1 + 2 AND px.y BETWEEN y0 - 2 AND y1 + 2 GROUP BY ALL),
  pt AS (SELECT item_id, severity, removed, string_agg(printf('%02X%02X%02X', coalesce(c[1], r)::bigint, coalesce(c[2], g)::bigint, coalesce(c[3], b)::bigint), '' ORDER BY y, x) AS hex FROM sv JOIN px USING (item_id) LEFT JOIN hi USING (item_id, severity, y, x) GROUP BY ALL)
SELECT item_id, severity::int AS severity, removed::bigint AS removed, md5(hex) AS digest FROM pt""")
def wordmark_removal(spark, sf):
    """Three words of every image painted over by severity, with a digest of all pixels."""
    pictures = images(spark, sf)
    made = regions.wordmark_removal(pictures, _words(pictures), ["acme"])
    return made.select("item_id", "severity", "removed", F.md5(F.hex("pixels").cast("binary")).alias("digest"))

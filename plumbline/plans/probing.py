"""Audit and colour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import colour
from plumbline.operators import clusters, imaging, metrics, probes, resample, stacked
from plumbline.operators.calibrate import logistic, probabilities, standardised
from plumbline.plans.carriers import VECTORS_SQL, vectors
from plumbline.plans.judging import auc_sql
from plumbline.plans.registry import query, r6, rounded
from plumbline.staging import staged, table


def _sides(spark, sf):
    rows = vectors(spark, sf).withColumn("label", (F.col("label") < 5).cast("int"))
    return rows.where("item_id % 3 <> 0"), rows.where("item_id % 3 = 0")


@query()
def source_probe(spark, sf):
    """Can the low labels be read from the vectors?  A fit, so without SQL."""
    train, test = _sides(spark, sf)
    return rounded(probes.source_probe(train, test), "balanced_accuracy", "auc")


@query()
def permutation_floor(spark, sf):
    train, test = _sides(spark, sf)
    return rounded(probes.permutation_floor(train, test, "item_id"), "balanced_accuracy")


_STEPS, _RATE, _PENALTY = 12, 0.5, 0.01
_DESCENT = f"""WITH RECURSIVE {VECTORS_SQL}, xs AS (SELECT item_id, 0 AS i, 1.0::double AS x FROM ve WHERE item_id % 3 <> 0 UNION ALL SELECT item_id, unnest(range(1, 65)), unnest(vec)::double FROM ve WHERE item_id % 3 <> 0),
  ys AS (SELECT item_id, m, (CASE m WHEN 0 THEN label < 5 WHEN 1 THEN label % 2 = 0 ELSE item_id % 2 = 0 END)::int AS y FROM ve, range(0, 3) t(m) WHERE item_id % 3 <> 0 AND NOT (m = 1 AND label = 9)),
  c AS (SELECT m, count(*) AS n FROM ys GROUP BY m),
  gd AS (SELECT m, i, 0 AS k, 0.0::double AS w FROM range(0, 3) t(m), range(0, 65) u(i) UNION ALL
    SELECT m, i, k + 1, w - {_RATE} * (g / n + CASE WHEN i > 0 THEN {_PENALTY} * w ELSE 0 END) FROM (
      SELECT gd.m, gd.i, gd.k, gd.w, c.n, gr.g FROM gd JOIN c USING (m) JOIN (
        SELECT z.m, xs.i, sum((1 / (1 + exp(-z.z)) - ys.y) * xs.x) AS g FROM (SELECT h.m, xs.item_id, sum(h.w * xs.x) AS z FROM gd h JOIN xs ON xs.i = h.i GROUP BY h.m, xs.item_id) z
        JOIN ys ON ys.item_id = z.item_id AND ys.m = z.m JOIN xs ON xs.item_id = z.item_id GROUP BY z.m, xs.i) gr ON gr.m = gd.m AND gr.i = gd.i WHERE gd.k < {_STEPS}))
SELECT m::int AS model, i::int AS place, round(w, 6) AS w FROM gd WHERE k = {_STEPS}"""


@query(_DESCENT)
def stacked_descent(spark, sf):
    """Three models over the same vectors, a dozen gradient steps of all together; entry 0 is the intercept.  The second leaves out a label."""
    rows = vectors(spark, sf).where("item_id % 3 <> 0")
    labels = F.array(*(c.cast("double") for c in (F.col("label") < 5, F.when(F.col("label") != 9, F.col("label") % 2 == 0), F.col("item_id") % 2 == 0)))
    found = stacked.descend(rows.select(F.col("vec").alias("features"), labels.alias("labels"), F.array(*[F.lit(1.0)] * 3).alias("weights")), [_PENALTY] * 3, _STEPS, _RATE)
    cells = [(m, (i + 1) % len(w), float(x)) for m, w in enumerate(found) for i, x in enumerate(w)]
    return rounded(spark.createDataFrame(cells, "model int, place int, w double"), "w")


@query()
def rules_fit(spark, sf):
    """The penalised logistic judge over standardised features of documents."""
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").cast("double").alias("size"), F.regexp_count("text", F.lit("[,.;]")).cast("double").alias("marks")).join(table(spark, sf, "labels"), "doc_id")
    rows, mu, sd = standardised(docs, ["size", "marks"])
    w, b = logistic(rows.withColumn("f", F.array("size", "marks")), "f", "quality")
    scored = probabilities(rows.withColumn("f", F.array("size", "marks")), "f", w, b).withColumn("label", F.col("quality"))
    area = metrics.auc(scored, [], F.col("quality") == 1)
    return area.select(F.lit(round(w[0], 4)).alias("w_size"), F.lit(round(w[1], 4)).alias("w_marks"), F.lit(round(b, 4)).alias("b"), r6("auc").alias("auc"))


@query(f"""WITH {VECTORS_SQL}, n AS (SELECT label, count(DISTINCT item_id % 3) AS sources, count(*) AS n FROM ve GROUP BY label),
  s AS (SELECT vec[1]::double AS score, label, item_id FROM ve WHERE label IN (SELECT label FROM n WHERE sources > 1)) SELECT (SELECT count(*) FROM n WHERE sources > 1) AS mixed, n_pos, n_neg, auc FROM ({auc_sql('s', '', 'item_id % 2 = 0')})""")
def gold_mixed_auc(spark, sf):
    """Discrimination inside groups that hold more than one source."""
    rows = vectors(spark, sf)
    groups = rows.groupBy("label").agg(F.countDistinct(F.col("item_id") % 3).alias("s")).where("s > 1")
    scored = rows.join(groups, "label").select("label", "item_id", F.get("vec", F.lit(0)).cast("double").alias("score"))
    area = metrics.auc(scored, [], F.col("item_id") % 2 == 0)
    return area.join(F.broadcast(groups.agg(F.count("*").alias("mixed")))).select("mixed", "n_pos", "n_neg", r6("auc").alias("auc"))


def _colours(spark, sf):
    """Two colours of each part, from the MD5 of its key."""
    digest = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double")
    return table(spark, sf, "part").select("p_partkey", *(byte(i).alias(n) for i, n in enumerate(("r1", "g1", "b1", "r2", "g2", "b2"))))


def _labs(rows):
    one = colour.rgb_to_lab(F.col("r1"), F.col("g1"), F.col("b1"))
    two = colour.rgb_to_lab(F.col("r2"), F.col("g2"), F.col("b2"))
    return rows.withColumns({n: c for n, c in zip(("l1", "a1", "q1", "l2", "a2", "q2"), (*one, *two), strict=True)})


_BYTES = ", ".join(f"('0x' || substr(md5(p_partkey::varchar), {2 * i + 1}, 2))::int::double AS {n}" for i, n in enumerate(("r1", "g1", "b1", "r2", "g2", "b2")))
_LIN = "CASE WHEN {0} / 255 <= 0.04045 THEN {0} / 255 / 12.92 ELSE pow(({0} / 255 + 0.055) / 1.055, 2.4) END"
_BEND = "CASE WHEN {0} > 216.0 / 24389 THEN cbrt({0}) ELSE {0} / (3 * (36.0::double / 841)) + 4.0::double / 29 END"


def _lab_sql() -> str:
    lin = ", ".join(f"{_LIN.format(c)} AS {c}l" for c in ("r1", "g1", "b1", "r2", "g2", "b2"))
    rows = [(m, w) for m, w in zip(colour.RGB_TO_XYZ, colour.WHITE, strict=True)]
    xyz = ", ".join(f"(r{k}l * {m[0]}::double + g{k}l * {m[1]}::double + b{k}l * {m[2]}::double) / {w}::double AS {n}{k}" for k in (1, 2) for n, (m, w) in zip("xyz", rows, strict=True))
    bend = ", ".join(f"{_BEND.format(n + str(k))} AS {n}{k}" for k in (1, 2) for n in "xyz")
    lab = ", ".join(f"116 * y{k} - 16 AS l{k}, 500 * (x{k} - y{k}) AS a{k}, 200 * (y{k} - z{k}) AS q{k}" for k in (1, 2))
    return f"""co AS (SELECT p_partkey, {_BYTES} FROM part), li AS (SELECT p_partkey, {lin} FROM co), xy AS (SELECT p_partkey, {xyz} FROM li),
  be AS (SELECT p_partkey, {bend} FROM xy), lb AS (SELECT p_partkey, {lab} FROM be)"""


@query(f"WITH {_lab_sql()} SELECT p_partkey, round(l1, 4) AS l, round(a1, 4) AS a, round(q1, 4) AS b, round(sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (q1 - q2) * (q1 - q2)), 4) AS delta_e FROM lb")
def rgb_to_lab(spark, sf):
    rows = _labs(_colours(spark, sf))
    change = colour.delta_e76(tuple(map(F.col, ("l1", "a1", "q1"))), tuple(map(F.col, ("l2", "a2", "q2"))))
    return rows.select("p_partkey", F.round("l1", 4).alias("l"), F.round("a1", 4).alias("a"), F.round("q1", 4).alias("b"), F.round(change, 4).alias("delta_e"))


_DE2000 = """d1 AS (SELECT *, (sqrt(a1*a1+q1*q1) + sqrt(a2*a2+q2*q2)) / 2 AS cb FROM lb), d2 AS (SELECT *, 1 + 0.5 * (1 - sqrt(pow(cb, 7) / (pow(cb, 7) + pow(25.0::double, 7)))) AS g FROM d1),
  d3 AS (SELECT *, sqrt(g*a1*g*a1 + q1*q1) AS c1, sqrt(g*a2*g*a2 + q2*q2) AS c2, degrees(atan2(q1, g*a1)) AS t1, degrees(atan2(q2, g*a2)) AS t2 FROM d2),
  d4 AS (SELECT *, CASE WHEN t1 < 0 THEN t1 + 360 ELSE t1 END AS h1, CASE WHEN t2 < 0 THEN t2 + 360 ELSE t2 END AS h2 FROM d3),
  d5 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
    CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hb, (c1 + c2) / 2 AS cm, (l1 + l2) / 2 - 50 AS lm FROM d4),
  d6 AS (SELECT *, 1 - 0.17 * cos(radians(hb - 30)) + 0.24 * cos(radians(2 * hb)) + 0.32 * cos(radians(3 * hb + 6)) - 0.20 * cos(radians(4 * hb - 63)) AS t, 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0::double, 7))) AS rc, 30 * exp(-pow((hb - 275) / 25, 2)) AS dt FROM d5),
  d7 AS (SELECT p_partkey, (l2 - l1) / (1 + 0.015 * lm * lm / sqrt(20 + lm * lm)) AS dl, (c2 - c1) / (1 + 0.045 * cm) AS dc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * t) AS de, -sin(radians(2 * dt)) * rc AS rt FROM d6)"""


@query(f"WITH {_lab_sql()}, {_DE2000} SELECT p_partkey, round(sqrt(dl * dl + dc * dc + de * de + rt * dc * de), 4) AS ciede2000 FROM d7")
def ciede2000(spark, sf):
    rows = _labs(_colours(spark, sf))
    change = colour.ciede2000(tuple(map(F.col, ("l1", "a1", "q1"))), tuple(map(F.col, ("l2", "a2", "q2"))))
    return rows.select("p_partkey", F.round(change, 4).alias("ciede2000"))


def images(spark, sf):
    """Embeddings as images of 16 by 16: each component a block of four pixels' shade, tinted by its neighbours."""
    shade = lambda i: F.least(F.greatest(F.floor(128 + 400 * F.get("vec", i % 64).cast("double")), F.lit(0)), F.lit(255))
    place = lambda p: F.concat(*(F.lpad(F.hex(shade(p + 7 * c).cast("long")), 2, "0") for c in range(3)))
    four_rows = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), place), "")
    return vectors(spark, sf).select("item_id", "label", F.lit(16).alias("height"), F.lit(16).alias("width"), F.unhex(F.repeat(four_rows, F.lit(4))).alias("pixels"))


def _counts_sql(key: str) -> str:
    """The images' colours by ``key``: 64 places an image, four pixels each."""
    return f"""sh AS (SELECT vec_id AS item_id, label::varchar AS brand, [least(greatest(floor(128 + 400 * x::double), 0), 255)::int for x in embedding] AS s FROM embeddings),
  cc AS (SELECT {key} AS k, s[p + 1] AS r, s[(p + 7) % 64 + 1] AS g, s[(p + 14) % 64 + 1] AS b, 4 * count(*) AS n FROM sh, range(64) t(p) GROUP BY ALL)"""


def _palettes_sql(k: int, steps: int, least_chroma: float, least_pixels: int) -> str:
    """k-means of ``cc``, one pair of expressions a step; ends in ``shares(k, l, a, b, n, total, entry)``."""
    lin = ", ".join(f"{_LIN.format(f'{c}::double')} AS {c}l" for c in "rgb")
    xyz = ", ".join(f"(rl * {m[0]}::double + gl * {m[1]}::double + bl * {m[2]}::double) / {w}::double AS {n}" for n, m, w in zip("xyz", colour.RGB_TO_XYZ, colour.WHITE, strict=True))
    bend = ", ".join(f"{_BEND.format(n)} AS {n}" for n in "xyz")
    near = "SELECT p.k, p.code, any_value(p.n) AS n, any_value(p.l) AS l, any_value(p.a) AS a, any_value(p.b) AS b, min({{'d': (p.l - c.l) * (p.l - c.l) + (p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b), 'j': c.j}}).j AS j FROM po p JOIN c{0} c ON c.k = p.k GROUP BY p.k, p.code"
    out = [
        f"ch AS (SELECT *, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END >= {least_chroma}::double AS coloured FROM cc)",
        f"kp AS (SELECT * FROM (SELECT *, coalesce(sum(n) FILTER (coloured) OVER (PARTITION BY k), 0) AS m FROM ch) WHERE coloured OR m < {least_pixels})",
        f"li AS (SELECT k, n, r * 65536 + g * 256 + b AS code, {lin} FROM kp)",
        f"xy AS (SELECT k, n, code, {xyz} FROM li)",
        f"be AS (SELECT k, n, code, {bend} FROM xy)",
        "po AS MATERIALIZED (SELECT k, n, code, round((116 * y - 16) * 1000)::bigint AS l, round(500 * (x - y) * 1000)::bigint AS a, round(200 * (y - z) * 1000)::bigint AS b FROM be)",
        f"c0 AS MATERIALIZED (SELECT k, l::double AS l, a::double AS a, b::double AS b, pos - 1 AS j FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, code) AS pos FROM po) WHERE pos <= {k})",
    ]
    for t in range(steps):
        moved = f"SELECT k, j, sum(n * l)::double / sum(n) AS l, sum(n * a)::double / sum(n) AS a, sum(n * b)::double / sum(n) AS b FROM ({near.format(t)}) GROUP BY 1, 2"
        out.append(f"c{t + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce(m.l, c.l) AS l, coalesce(m.a, c.a) AS a, coalesce(m.b, c.b) AS b FROM c{t} c LEFT JOIN ({moved}) m ON m.k = c.k AND m.j = c.j)")
    out.append(f"""shares AS (SELECT k, l, a, b, n, sum(n) OVER (PARTITION BY k) AS total, row_number() OVER (PARTITION BY k ORDER BY n DESC, j) - 1 AS entry
    FROM (SELECT k, j, sum(n) AS n FROM ({near.format(steps)}) GROUP BY 1, 2) JOIN c{steps} USING (k, j))""")
    return ",\n  ".join(out)


def _case(ladder: dict[int, int]) -> str:
    return "CASE severity " + " ".join(f"WHEN {k} THEN {v}" for k, v in ladder.items()) + " END"


def digit_sql(name: str, modulus: object, more: str = "") -> str:
    return f"(('0x' || substr(md5(item_id || '|{name}'{more}), 1, 12))::bigint % ({modulus}))"


def _weights_sql(sizes: str) -> str:
    """``wt(n, m, o, i, w)`` for ``sizes``, a select of n and m."""
    return f"""sz AS (SELECT DISTINCT n, m FROM ({sizes})), wi AS (SELECT n, m, o, greatest(1.0::double, n::double / m) AS wide, (o + 0.5::double) * (n::double / m) AS centre FROM sz, LATERAL unnest(range(0, m)) t(o)),
  wx AS (SELECT n, m, o, i, (i + 0.5::double - centre) / wide AS x FROM wi, LATERAL unnest(range(0, n)) t(i)),
  wv AS (SELECT n, m, o, i, CASE WHEN x = 0 THEN 1.0::double ELSE sin(x * pi()) / (x * pi()) * (sin(x / 3 * pi()) / (x / 3 * pi())) END AS v FROM wx WHERE abs(x) < 3),
  wt AS (SELECT n, m, o, i, round(v / sum(v) OVER (PARTITION BY n, m, o) * 65536)::bigint AS w FROM wv)"""


PIXELS_SQL = """sh AS (SELECT vec_id AS item_id, label::varchar AS brand, [least(greatest(floor(128 + 400 * x::double), 0), 255)::bigint for x in embedding] AS s FROM embeddings),
  px AS (SELECT item_id, p // 16 AS y, p % 16 AS x, s[p % 64 + 1] AS r, s[(p + 7) % 64 + 1] AS g, s[(p + 14) % 64 + 1] AS b FROM sh, range(256) t(p))"""
_HELD = lambda k: "[" + ", ".join(str(x[k]) for x in resample.HOLDS) + "]"
_VIVID = lambda k: "[" + ", ".join(str(v[k]) for v in resample.VIVID) + "]"
_WIDE = f"{digit_sql('stretch', 2)} = 1"
_LONGER = f"round(16 * {_case(resample.STRETCH)} / 1000.0)::int"


def _ladder_sql() -> str:
    pick = lambda *c: f"[{', '.join(c)}][i % 6 + 1]"
    return f"""{PIXELS_SQL}, im AS (SELECT item_id, severity FROM sh, range(1, 4) t(severity)),
  pl AS (SELECT item_id, severity, 'hue_rotation' AS corruption, {_case(resample.TURN)} AS turn, 100 AS percent FROM im
    UNION ALL SELECT item_id, severity, 'saturation', 0, CASE WHEN {digit_sql('saturation', 2)} = 0 THEN {_case(resample.MORE)} ELSE {_case(resample.LESS)} END FROM im),
  h1 AS (SELECT item_id, corruption, severity, y, x, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d, turn, percent,
    CASE WHEN r = g AND g = b THEN 0 WHEN r = greatest(r, g, b) THEN g - b WHEN g = greatest(r, g, b) THEN b - r + 2 * (g - least(r, b)) ELSE r - g + 4 * (b - least(r, g)) END AS lead FROM px JOIN pl USING (item_id)),
  h2 AS (SELECT *, (255 * ((lead + 6 * greatest(d, 1)) % (6 * greatest(d, 1))) // (6 * greatest(d, 1)) + turn) % 256 AS h, least((255 * d // greatest(v, 1)) * percent // 100, 255) AS s FROM h1),
  h3 AS (SELECT *, 6 * h // 255 AS i, (6 * h) % 255 AS f FROM h2),
  h4 AS (SELECT *, (2 * v * (255 - s) + 255) // 510 AS p, (2 * v * (65025 - s * f) + 65025) // 130050 AS q, (2 * v * (65025 - s * (255 - f)) + 65025) // 130050 AS t FROM h3),
  re AS (SELECT item_id, corruption, severity, y, x, {pick('v', 'q', 'p', 'p', 't', 'v')} AS r, {pick('t', 'v', 'v', 'q', 'p', 'p')} AS g, {pick('p', 'p', 't', 'v', 'v', 'q')} AS b FROM h4),
  cr AS (SELECT *, greatest(round(16 * sqrt(1 - {_case(resample.REMOVED)} / 1000.0::double)), 1)::int AS c, {digit_sql('crop', 8)} AS hold FROM im),
  wn AS (SELECT item_id, severity, 'crop_violation' AS corruption, CASE {_HELD(1)}[hold + 1] WHEN 0 THEN 0 WHEN 1 THEN 16 - c ELSE {digit_sql('down', '17 - c')} END AS y0, CASE {_HELD(0)}[hold + 1] WHEN 0 THEN 0 WHEN 1 THEN 16 - c ELSE {digit_sql('across', '17 - c')} END AS x0, c AS ch, c AS cw, 16 AS hh, 16 AS ww FROM cr
    UNION ALL SELECT item_id, severity, 'aspect_distortion', 0, 0, 16, 16, CASE WHEN {_WIDE} THEN 16 ELSE {_LONGER} END, CASE WHEN {_WIDE} THEN {_LONGER} ELSE 16 END FROM im),
  {_weights_sql('SELECT ch AS n, hh AS m FROM wn UNION ALL SELECT cw, ww FROM wn')},
  r1 AS (SELECT item_id, corruption, severity, wt.o - (hh - 16) // 2 AS y, px.x - x0 AS j, cw, ww, sum(r * w) AS r, sum(g * w) AS g, sum(b * w) AS b FROM px JOIN wn USING (item_id) JOIN wt ON wt.n = ch AND wt.m = hh AND wt.i = px.y - y0
    WHERE px.x >= x0 AND px.x < x0 + cw AND wt.o - (hh - 16) // 2 BETWEEN 0 AND 15 GROUP BY ALL),
  r2 AS (SELECT item_id, corruption, severity, y, wt.o - (ww - 16) // 2 AS x, sum(r * w) AS r, sum(g * w) AS g, sum(b * w) AS b FROM r1 JOIN wt ON wt.n = cw AND wt.m = ww AND wt.i = j WHERE wt.o - (ww - 16) // 2 BETWEEN 0 AND 15 GROUP BY ALL),
  rs AS (SELECT item_id, corruption, severity, y, x, {', '.join(f"least(greatest({c} + 2147483648, 0) // 4294967296, 255)::bigint AS {c}" for c in 'rgb')} FROM r2),
  it AS (SELECT item_id, severity, k, {digit_sql('cy', 1000, " || '|' || k")} * 16 / 1000.0::double AS cy, {digit_sql('cx', 1000, " || '|' || k")} * 16 / 1000.0::double AS cx, {digit_sql('hue', 1000, " || '|' || k")} % 5 AS hue,
    greatest(1.0::double, 16 * {_case({s: n for s, (_, n) in resample.PASTED.items()})} / 200.0::double) AS radius FROM im JOIN range(1, 7) t(k) ON k <= {_case({s: n for s, (n, _) in resample.PASTED.items()})}),
  hi AS (SELECT item_id, severity, y, x, arg_max(hue, k) AS hue FROM px JOIN it USING (item_id) WHERE sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) <= radius * CASE WHEN cos(12 * atan2(y - cy, x - cx)) >= 0 THEN 1 ELSE 0.7::double END GROUP BY ALL),
  ct AS (SELECT item_id, 'clutter' AS corruption, severity, y, x, r, g, b, CASE WHEN severity = 3 AND y >= 14 THEN 0 ELSE hue END AS hue FROM px JOIN im USING (item_id) LEFT JOIN hi USING (item_id, severity, y, x)),
  al AS (FROM re UNION ALL FROM rs UNION ALL SELECT item_id, corruption, severity, y, x, {', '.join(f"coalesce({_VIVID(k)}[hue + 1], {c}) AS {c}" for k, c in enumerate('rgb'))} FROM ct)"""


@query(f"""WITH {_ladder_sql()}, pk AS (SELECT item_id, corruption, severity, string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x) AS hex FROM al GROUP BY ALL)
SELECT corruption, severity::int AS severity, count(*) AS n, bit_xor(('0x' || substr(md5(hex), 1, 15))::bigint) AS checksum FROM pk GROUP BY ALL""")
def image_ladder(spark, sf):
    """Perturbations of every image under each generator and severity, by checksum of all pixels."""
    made = imaging.ladder(images(spark, sf))
    sign = F.conv(F.substring(F.md5(F.hex("pixels").cast("binary")), 1, 15), 16, 10).cast("long")
    return made.groupBy("corruption", "severity").agg(F.count("*").alias("n"), F.bit_xor(sign).alias("checksum"))


@query()
def ladder_changes(spark, sf):
    """Mean colour change of each perturbation."""
    made = staged(imaging.ladder(images(spark, sf)), "ladder")
    by = ["source_id", "corruption", "severity"]
    return imaging.colour_changes(made, by).groupBy("corruption", "severity").agg(F.count("*").alias("n"), F.round(F.avg("delta_e"), 4).alias("mean_delta_e"))


#: Two brand colours, in Lab.
BRAND_LAB = ((60.0, 10.0, 10.0), (40.0, -20.0, 30.0))

_STATS = """st AS (SELECT k, sum(n) AS c, sum(n * (CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) * 255 // greatest(r, g, b) ELSE 0 END)) AS s,
    sum(n * (r - g))::double AS x, sum(n * (r - g) * (r - g))::double AS xx, sum(n * (r + g - 2 * b))::double AS y, sum(n * (r + g - 2 * b) * (r + g - 2 * b))::double AS yy FROM cc GROUP BY k),
  fe AS (SELECT k, s / c / 255 AS sat_mean, (sqrt(greatest(0, xx / c - x * x / c / c + (yy / c - y * y / c / c) / 4)) + 0.3::double * sqrt(x * x / c / c + y * y / c / c / 4)) / 255 AS colorfulness FROM st)"""
_PAIRS = "lb AS (SELECT {'k': k, 'entry': entry, 'share': n / total} AS p_partkey, l / 1000 AS l1, a / 1000 AS a1, b / 1000 AS q1, l2, a2, q2 FROM shares, (VALUES " + ", ".join(
    f"({', '.join(f'{x}::double' for x in p)})" for p in BRAND_LAB
) + ") t(l2, a2, q2))"
_WEIGHED = """pd AS (SELECT key.k AS k, sum(key.share * d) AS palette_de FROM (SELECT p_partkey AS key, min(sqrt(dl * dl + dc * dc + de * de + rt * dc * de)) AS d FROM d7 GROUP BY 1) GROUP BY 1)"""


@query(f"""WITH {_counts_sql('item_id')}, {_palettes_sql(5, 15, 0.06, 100)}, {_STATS}, {_PAIRS}, {_DE2000}, {_WEIGHED}
  SELECT k AS item_id, round(palette_de, 4) AS palette_de, round(sat_mean, 4) AS sat_mean, round(colorfulness, 4) AS colorfulness FROM pd JOIN fe USING (k)""")
def image_features(spark, sf):
    found = imaging.rule_features(images(spark, sf), [list(p) for p in BRAND_LAB])
    return found.select("item_id", *(F.round(c, 4).alias(c) for c in ("palette_de", "sat_mean", "colorfulness")))


@query(f"""WITH {PIXELS_SQL}, {_weights_sql('SELECT 16 AS n, 32 AS m')}, gr AS (SELECT item_id, y, x, 299 * r + 587 * g + 114 * b AS v FROM px),
  g1 AS (SELECT item_id, o AS y, x, sum(v * w) AS v FROM gr JOIN wt ON wt.i = y GROUP BY ALL), g2 AS (SELECT item_id, y, o AS x, (greatest(sum(v * w) + 2147483648, 0) // 4294967296)::bigint AS v FROM g1 JOIN wt ON wt.i = x GROUP BY ALL),
  bs AS (SELECT k, n, round(4096 * cos(pi() * (2 * n + 1) * k / 64))::bigint AS c FROM range(0, 8) t(k), range(0, 32) u(n)),
  d1 AS (SELECT item_id, k AS u, x, sum(v * c) AS v FROM g2 JOIN bs ON n = y GROUP BY ALL), d2 AS (SELECT item_id, u, k, sum(v * c)::hugeint AS v FROM d1 JOIN bs ON n = x GROUP BY ALL),
  md AS (SELECT item_id, list(v ORDER BY v)[32] + list(v ORDER BY v)[33] AS middle FROM d2 GROUP BY 1)
SELECT item_id, bit_or(CASE WHEN 2 * v > middle THEN CASE WHEN u = 0 AND k = 0 THEN (-9223372036854775808)::bigint ELSE 1::bigint << (63 - 8 * u - k)::int END ELSE 0 END) AS phash FROM d2 JOIN md USING (item_id) GROUP BY 1""")
def image_hashes(spark, sf):
    """Perceptual hashes of all images."""
    return imaging.perceptual_hashes(images(spark, sf))


@query(f"WITH {_counts_sql('brand')}, {_palettes_sql(6, 25, 0.08, 0)} SELECT k AS brand, entry::int AS entry, round(n / total, 4) AS share FROM shares")
def brand_palettes(spark, sf):
    """Six-colour palettes of ten labels, from all of their images."""
    found = imaging.brand_palette(images(spark, sf), "label")
    return found.select("brand", F.posexplode("share").alias("entry", "share")).withColumn("share", F.round("share", 4))


@query(f"""WITH {_lab_sql()}, ds AS (SELECT p_partkey, entry, round(sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (q1 - q2) * (q1 - q2)), 6) AS distance
    FROM (SELECT p_partkey, l1, a1, q1 FROM lb), (VALUES {', '.join(f"({i}, {', '.join(f'{x}::double' for x in p)})" for i, p in enumerate(BRAND_LAB))}) t(entry, l2, a2, q2))
  SELECT p_partkey, arg_min(entry, {{'d': distance, 'e': entry}})::int AS entry, min(distance) AS distance FROM ds GROUP BY 1""")
def nearest_palette_colour(spark, sf):
    """The brand colour nearest to the first colour of each part."""
    rows = _labs(_colours(spark, sf)).withColumnRenamed("p_partkey", "colour_id")
    entries = spark.createDataFrame([(i, *p) for i, p in enumerate(BRAND_LAB)], "entry int, pl double, pa double, pb double")
    gap = r6(colour.delta_e76(tuple(map(F.col, ("l1", "a1", "q1"))), tuple(map(F.col, ("pl", "pa", "pb")))))
    return clusters.nearest_of_palette(rows, entries, gap).withColumnRenamed("colour_id", "p_partkey")

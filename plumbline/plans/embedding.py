"""Embedding queries: centroids, calibration, neighbours, directions, near pairs, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import hamming, hash_from_hex
from plumbline.operators import calibrate, clusters, embedding, metrics, probes, similar
from plumbline.operators.components import connected_components
from plumbline.plans.carriers import VECTORS_SQL, vectors
from plumbline.plans.judging import auc_sql
from plumbline.plans.registry import query, r6, rounded
from plumbline.staging import table

#: Labels 0 are the anchor; even ids train.
ANCHOR = 0
COSINE = 0.25

_CENTROID = """pa AS (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM ve WHERE label = 0 AND item_id % 2 = 0),
  me AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x::double) AS m FROM pa GROUP BY i)),
  ce AS (SELECT list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM me)"""


def _centroid(spark, sf):
    train = vectors(spark, sf).where((F.col("label") == ANCHOR) & (F.col("item_id") % 2 == 0)).withColumn("judge", F.lit("frozen"))
    return embedding.centroid(train, ["judge"])


@query(f"WITH {VECTORS_SQL}, {_CENTROID} SELECT 'frozen' AS judge, i::int AS at, round(c[i + 1], 6) AS x FROM ce, range(0, 64) t(i)")
def centroid(spark, sf):
    return _centroid(spark, sf).select("judge", F.posexplode("centroid").alias("at", "x")).withColumn("x", r6("x"))


@query(f"WITH {VECTORS_SQL}, {_CENTROID} SELECT item_id, label, round(list_dot_product(vec::double[], c), 6) AS similarity FROM ve, ce")
def centroid_scores(spark, sf):
    rows = embedding.similarity(vectors(spark, sf), _centroid(spark, sf))
    return rows.select("item_id", "label", r6("similarity").alias("similarity"))


@query(f"WITH {VECTORS_SQL}, {_CENTROID} SELECT 'frozen' AS judge, item_id, round(1 / (1 + exp(-(12.5 * list_dot_product(vec::double[], c) + -3.25))), 6) AS score FROM ve, ce")
def platt_apply(spark, sf):
    params = _centroid(spark, sf).select("judge", "centroid", F.lit(12.5).alias("platt_a"), F.lit(-3.25).alias("platt_b"))
    return rounded(embedding.embedding_scores(vectors(spark, sf), params), "score")


#: Newton's steps in the SQL; each is of the last digit long before.
_NEWTON = 25


@query(f"""WITH RECURSIVE {VECTORS_SQL}, pa AS (SELECT label AS j, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM ve WHERE label IN (0, 1, 2) AND item_id % 2 = 0),
  me AS (SELECT j, list(m ORDER BY i) AS m FROM (SELECT j, i, avg(x::double) AS m FROM pa GROUP BY j, i) GROUP BY j), ce AS (SELECT j, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM me),
  sr AS (SELECT j, list_dot_product(vec::double[], c) AS x, (label = j)::int AS y FROM ve, ce WHERE item_id % 2 = 1), n AS (SELECT j, count(*) AS n FROM sr GROUP BY j),
  nw AS (SELECT j, 0 AS k, 0.0::double AS a, 0.0::double AS b FROM ce UNION ALL
    SELECT j, k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
      SELECT j, k, a, b, sum((p - y) * x) AS ga, sum(p - y) AS gb, sum(p * (1 - p) * x * x) + 1e-9 AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) + 1e-9 AS hbb
      FROM (SELECT nw.j, k, a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS p FROM nw JOIN sr USING (j) WHERE k < {_NEWTON}) GROUP BY j, k, a, b)),
  gd AS (SELECT j, 0 AS k, 20.0::double AS a, -10.0::double AS b FROM ce UNION ALL
    SELECT j, k + 1, a - 0.5 * avg((p - y) * x), b - 0.5 * avg(p - y) FROM (SELECT gd.j, k, a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS p FROM gd JOIN sr USING (j) WHERE k < 2000) GROUP BY j, k, a, b)
SELECT 'centroid ' || j AS judge, 'newton' AS method, n, round(a, 6) AS a, round(b, 6) AS b FROM nw JOIN n USING (j) WHERE k = {_NEWTON}
UNION ALL SELECT 'centroid ' || j, 'gd2000', n, round(a, 6), round(b, 6) FROM gd JOIN n USING (j) WHERE k = 2000""")
def platt_fit(spark, sf):
    """Both calibration methods for three judges, each the similarity to one label's centroid, on the odd ids: all judges in one job a step."""
    name = F.concat(F.lit("centroid "), F.col("label").cast("string"))
    train = vectors(spark, sf).where("label in (0, 1, 2) and item_id % 2 = 0").withColumn("judge", name)
    rows = embedding.similarity(vectors(spark, sf).where("item_id % 2 = 1"), embedding.centroid(train, ["judge"]))
    rows = rows.select("judge", "similarity", (name == F.col("judge")).cast("int").alias("label"))
    n = rows.groupBy("judge").agg(F.count("*").alias("n"))
    fits = calibrate.platt_newton_by(rows, ["judge"]).withColumn("method", F.lit("newton")).unionByName(calibrate.platt_descent_by(rows, ["judge"]).withColumn("method", F.lit("gd2000")))
    return fits.join(n, "judge").select("judge", "method", "n", r6("a").alias("a"), r6("b").alias("b"))


@query(f"""WITH {VECTORS_SQL}, pr AS (SELECT q.item_id AS query_id, b.item_id, list_dot_product(q.vec::double[], b.vec::double[]) AS s FROM ve q JOIN ve b ON q.item_id % 100 = 0 AND q.item_id <> b.item_id)
SELECT query_id, rank::int AS rank, item_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM pr) WHERE rank <= 5""")
def knn_top5(spark, sf):
    """Queries are the ids divisible by 100, against all rows."""
    rows = vectors(spark, sf).select("item_id", "vec")
    return rounded(embedding.neighbours(rows.where("item_id % 100 = 0"), rows, 5), "similarity")


_NEAREST = """pr AS (SELECT q.item_id AS query_id, b.item_id, list_dot_product(q.vec::double[], b.vec::double[]) AS s FROM ve q JOIN ve b ON q.item_id % 2 = 1 AND b.item_id % 2 = 0),
  ne AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM pr) WHERE rank = 1)"""


def _test_to_train(spark, sf):
    rows = vectors(spark, sf).select("item_id", "vec")
    return embedding.neighbours(rows.where("item_id % 2 = 1"), rows.where("item_id % 2 = 0"), 1)


@query(f"WITH {VECTORS_SQL}, {_NEAREST} SELECT count(*) AS n, round(avg((s >= 0.4)::int), 6) AS leak_rate FROM ne")
def twin_leak_rate(spark, sf):
    return rounded(probes.twin_leak(_test_to_train(spark, sf), 0.4), "leak_rate")


@query(f"WITH {VECTORS_SQL}, {_NEAREST} SELECT count(*) AS n, round(avg((a.label = b.label)::int), 6) AS same_label FROM ne JOIN ve a ON a.item_id = query_id JOIN ve b ON b.item_id = ne.item_id")
def nn_same_label(spark, sf):
    return rounded(probes.same_label_rate(_test_to_train(spark, sf), vectors(spark, sf).select("item_id", "label")), "same_label")


_DIRECTION = """pp AS (SELECT label = 0 AS p, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM ve WHERE item_id % 2 = 0),
  dd AS (SELECT list(d ORDER BY i) AS d FROM (SELECT i, avg(x::double) FILTER (p) - avg(x::double) FILTER (NOT p) AS d FROM pp GROUP BY i)),
  di AS (SELECT list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS d FROM dd)"""


def _direction(spark, sf):
    return embedding.difference_of_means(vectors(spark, sf).where("item_id % 2 = 0"), f"label = {ANCHOR}")


@query(f"WITH {VECTORS_SQL}, {_DIRECTION} SELECT i::int AS at, round(d[i + 1], 6) AS x FROM di, range(0, 64) t(i)")
def diff_of_means(spark, sf):
    return _direction(spark, sf).select(F.posexplode("direction").alias("at", "x")).withColumn("x", r6("x"))


_PROJECTED = """pj AS (SELECT item_id, label, list_transform(list_zip(vec, d), lambda z: z[1]::double - list_dot_product(vec::double[], d) * z[2]) AS v FROM ve, di),
  pn AS (SELECT item_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) AS v FROM pj)"""


@query(f"WITH {VECTORS_SQL}, {_DIRECTION}, {_PROJECTED}, {_CENTROID} SELECT item_id, label, round(list_dot_product(v, c), 6) AS similarity FROM pn, ce")
def project_out_scores(spark, sf):
    rows = embedding.without_direction(vectors(spark, sf), _direction(spark, sf))
    rows = embedding.similarity(rows, _centroid(spark, sf), "projected")
    return rows.select("item_id", "label", r6("similarity").alias("similarity"))


@query(f"""WITH {VECTORS_SQL}, {_DIRECTION}, {_PROJECTED}, {_CENTROID},
  b AS (SELECT label, round(list_dot_product(vec::double[], c), 9) AS score FROM ve, ce WHERE item_id % 2 = 1), t AS (SELECT label, round(list_dot_product(v, c), 9) AS score FROM pn, ce WHERE item_id % 2 = 1),
  x AS ({auc_sql('b', '', 'label = 0')}), y AS ({auc_sql('t', '', 'label = 0')})
SELECT x.auc AS auc_before, y.auc AS auc_after, (x.auc - y.auc > 2 * 0.02) AND (x.auc - y.auc > 0.1) AS single_direction FROM x, y""")
def direction_verdict(spark, sf):
    """Discrimination of the centroid before and after its main direction is taken out."""
    rows = embedding.without_direction(vectors(spark, sf).where("item_id % 2 = 1"), _direction(spark, sf))
    rows = rows.withColumn("judge", F.lit("frozen"))
    one = _centroid(spark, sf).drop("judge")
    both = embedding.similarity(rows, one).select("label", F.lit("before").alias("side"), F.round("similarity", 9).alias("score")).unionByName(
        embedding.similarity(rows, one, "projected").select("label", F.lit("after").alias("side"), F.round("similarity", 9).alias("score"))
    )
    found = rounded(metrics.auc(both, ["side"], f"label = {ANCHOR}"), "auc").groupBy().pivot("side", ["before", "after"]).agg(F.first("auc"))
    return found.select(
        F.col("before").alias("auc_before"), F.col("after").alias("auc_after"), embedding.single_direction(F.lit(0.0), F.col("before") - F.col("after")).alias("single_direction")
    )


@query(f"WITH {VECTORS_SQL} SELECT a.item_id AS u, b.item_id AS v, round(list_dot_product(a.vec::double[], b.vec::double[]), 6) AS cosine FROM ve a JOIN ve b ON a.label = b.label AND a.item_id < b.item_id AND list_dot_product(a.vec::double[], b.vec::double[]) >= 0.25")
def near_pairs_cosine(spark, sf):
    return rounded(clusters.cosine_pairs(vectors(spark, sf), "label", COSINE), "cosine")


SIGNS_SQL = "si AS (SELECT item_id, label, list_transform(vec, lambda x: (x > 0)::int) AS b FROM (SELECT vec_id AS item_id, label, embedding AS vec FROM embeddings))"


def sign_hashes(spark, sf):
    """A 64-bit hash from the signs of the components, first component highest."""
    nibble = lambda i: F.substring(F.hex(sum((F.when(F.get("vec", F.lit(4 * i + j)) > 0, 1 << (3 - j)).otherwise(0) for j in range(1, 4)), F.when(F.get("vec", F.lit(4 * i)) > 0, 8).otherwise(0)).cast("long")), 1, 1)
    return vectors(spark, sf).select("item_id", "label", hash_from_hex(F.concat(*(nibble(i) for i in range(16)))).alias("hash"))


@query("""WITH t AS (SELECT doc_id, lang, ('0x' || substr(md5((doc_id // 16)::varchar), 1, 15))::bigint AS h FROM documents),
  h AS (SELECT doc_id, lang, xor(h, ((1::bigint << (doc_id % 10)::int) - 1) << (doc_id % 50)::int) AS h FROM t),
  one AS (SELECT lang, h, min(doc_id) AS doc_id FROM h GROUP BY ALL)
SELECT a.doc_id AS u, b.doc_id AS v, bit_count(xor(a.h, b.h))::int AS bits FROM one a JOIN one b ON a.lang = b.lang AND a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 8
UNION ALL SELECT one.doc_id, h.doc_id, 0 FROM h JOIN one USING (lang, h) WHERE h.doc_id > one.doc_id""")
def near_pairs_hamming(spark, sf):
    """Documents in families of sixteen ids with one hash, none to nine neighbouring bits of it turned over: relatives lie up to eighteen bits apart, on both sides of the limit and of band edges."""
    return clusters.hamming_pairs(_family_hashes(spark, sf), "lang")


def _family_hashes(spark, sf):
    family = F.floor(F.col("doc_id") / 16).cast("string")
    bits = F.conv(F.substring(F.md5(family.cast("binary")), 1, 15), 16, 10).cast("long")
    turned = bits.bitwiseXOR(F.expr("shiftleft(shiftleft(1L, int(doc_id % 10)) - 1L, int(doc_id % 50))"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang", turned.alias("hash"))


_HYBRID = """ha AS (SELECT vec_id AS item_id, label, xor(h, ((1::bigint << (doc_id % 10)::int) - 1) << (doc_id % 50)::int) AS h
    FROM embeddings JOIN (SELECT doc_id, ('0x' || substr(md5((doc_id // 16)::varchar), 1, 15))::bigint AS h FROM documents) ON doc_id = vec_id),
  cl AS (SELECT u, v FROM ed UNION SELECT a.item_id, b.item_id FROM ha a JOIN ha b ON a.label = b.label AND a.item_id <> b.item_id AND bit_count(xor(a.h, b.h)) <= 8),
  rc AS (SELECT item_id AS n, item_id AS r FROM ve UNION SELECT rc.n, cl.v FROM rc JOIN cl ON cl.u = rc.r)"""


@query(f"WITH {SIGNS_SQL} SELECT a.item_id AS u, min(list_sum(list_transform(list_zip(a.b, b.b), lambda z: abs(z[1] - z[2]))))::int AS bits FROM si a JOIN si b ON a.label = b.label AND b.item_id = a.label GROUP BY 1")
def hamming_to_anchor(spark, sf):
    rows = sign_hashes(spark, sf)
    first = rows.where("item_id = label").select("label", F.col("hash").alias("h"))
    return rows.join(F.broadcast(first), "label").select(F.col("item_id").alias("u"), hamming("hash", "h").alias("bits"))  # at most one row a label


_EDGES = f"{VECTORS_SQL}, ed AS (SELECT a.item_id AS u, b.item_id AS v FROM ve a JOIN ve b ON a.label = b.label AND a.item_id <> b.item_id AND list_dot_product(a.vec::double[], b.vec::double[]) >= 0.25)"
COMPONENTS_SQL = f"{_EDGES}, rc AS (SELECT item_id AS n, item_id AS r FROM ve UNION SELECT rc.n, ed.v FROM rc JOIN ed ON ed.u = rc.r), cc AS (SELECT n AS item_id, min(r) AS component FROM rc GROUP BY n)"


def members(spark, sf):
    rows = vectors(spark, sf)
    return clusters.clusters(rows, similar.similar_links(rows, "label", COSINE))


@query(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT item_id, component FROM cc")
def components(spark, sf):
    return members(spark, sf)


@query(f"WITH RECURSIVE {_EDGES}, {_HYBRID} SELECT n AS item_id, min(r) AS component FROM rc GROUP BY n")
def hybrid_components(spark, sf):
    """Clusters of vectors linked by cosine or by the family hash of the document with the same id."""
    rows = vectors(spark, sf).join(_family_hashes(spark, sf).drop("lang"), "item_id", "left")
    return clusters.clusters(rows, clusters.hybrid_links(rows, "label", least=COSINE))


@query(f"WITH RECURSIVE {COMPONENTS_SQL}, s AS (SELECT component, count(*) AS n FROM cc GROUP BY 1) SELECT 'h' || lpad((row_number() OVER (ORDER BY n DESC, component) - 1)::varchar, 4, '0') AS cluster_id, component, n FROM s")
def cluster_numbers(spark, sf):
    return clusters.numbered(members(spark, sf))


@query("""WITH RECURSIVE d AS (SELECT c_custkey AS n, c_nationkey AS k FROM customer), e AS (SELECT DISTINCT o_custkey AS u, o_custkey // 2 AS v FROM orders WHERE o_custkey <> o_custkey // 2),
  b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS n, u AS m FROM b UNION SELECT r.n, b.v FROM r JOIN b ON b.u = r.m WHERE b.v < r.m)
SELECT n AS node, min(m) AS component FROM r GROUP BY n""")
def order_components(spark, sf):
    """Components over customers halving to a common root: long paths, one giant component."""
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("u"), F.floor(F.col("o_custkey") / 2).alias("v"))
    return connected_components(edges)

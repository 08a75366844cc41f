"""Ingestion, index, rubric and mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import exam, ingest, masks, rubric, sampling
from plumbline.plans.carriers import EXAM_SQL, INSTRUMENTS, K_SQL, event_k, exam_items
from plumbline.plans.registry import query, r6
from plumbline.staging import table

PAGES = {"en": "north", "de": "south", "fr": "west"}


def _ads(spark, sf):
    """Documents as ads: the language is the page, and its words become image URLs, some of them empty: two images, all others cards."""
    d = table(spark, sf, "documents")
    image = lambda w: F.struct(F.when(F.length(w) % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("http://x/"), w, F.lit("?v=1"))).alias("originalImageUrl"), F.concat(F.lit("http://y/"), w).alias("resizedImageUrl"))
    made, doc = F.col("made"), F.col("doc_id").cast("string")
    # columns of their own, so that what is used twice is worked out once, and no words where none are asked for
    d = d.withColumns({"made": F.transform(F.split("text", " "), image), "adArchiveId": F.when(F.col("doc_id") % 4 == 0, "").otherwise(doc), "otherId": F.when(F.col("doc_id") % 8 != 0, F.concat(F.lit("z"), doc))})
    return d.select(
        F.col("lang").alias("pageName"), "adArchiveId", "otherId", F.col("n_chars").cast("long").alias("startDate"), (F.col("doc_id") % 2 == 0).alias("isActive"),
        F.struct(F.col("source").alias("displayFormat"), F.slice(made, 1, 2).alias("images"), F.slice(made, F.lit(3), F.greatest(F.size(made), F.lit(0))).alias("cards")).alias("snapshot"), F.col("doc_id").alias("ad_pos"),
    )


_ADS_SQL = """wo AS (SELECT doc_id, lang, source, n_chars, string_split(text, ' ') AS w FROM documents WHERE lang IN ('en', 'de', 'fr')),
  ur AS (SELECT doc_id, lang, source, n_chars, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS idx FROM wo),
  us AS (SELECT *, CASE WHEN length(w) % 3 = 0 THEN 'http://y/' || w ELSE 'http://x/' || w || '?v=1' END AS url FROM ur),
  fs AS (SELECT *, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY doc_id, idx) AS nth FROM us)"""


@query(f"""WITH {_ADS_SQL} SELECT CASE lang WHEN 'en' THEN 'north' WHEN 'de' THEN 'south' ELSE 'west' END AS brand, CASE WHEN doc_id % 4 <> 0 THEN doc_id::varchar WHEN doc_id % 8 <> 0 THEN 'z' || doc_id ELSE 'unknown' END AS ad_id,
  n_chars AS start_date, source AS display_format, doc_id % 2 = 0 AS is_active, idx::int AS idx, url FROM fs WHERE nth = 1""")
def flatten_media(spark, sf):
    """Nested ads to one row an image, first seen only."""
    return ingest.ad_images(_ads(spark, sf), PAGES, ("adArchiveId", "otherId")).drop("ad_pos", "file")


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS texts, count(*) AS n FROM conversations GROUP BY conv_id),
  u AS (SELECT conv_id, unnest(CASE WHEN n % 2 = 0 THEN texts ELSE texts[1:1] END) AS url, generate_subscripts(CASE WHEN n % 2 = 0 THEN texts ELSE texts[1:1] END, 1) - 1 AS idx FROM c WHERE conv_id % 3 <> 2),
  f AS (SELECT *, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY conv_id, idx) AS nth FROM u WHERE url <> '')
SELECT CASE conv_id % 3 WHEN 0 THEN 'north' ELSE 'south' END AS brand, conv_id::varchar AS post_id, idx::int AS idx, md5(url) AS url_md5 FROM f WHERE nth = 1""")
def flatten_posts(spark, sf):
    """Conversations as posts: even ones are sets of images, odd ones single images."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("texts"))
    posts = c.select(
        F.concat(F.lit("o"), (F.col("conv_id") % 3).cast("string")).alias("ownerUsername"), F.lit("").alias("shortCode"), F.col("conv_id").cast("string").alias("id"), F.when(F.size("texts") % 2 == 0, "Sidecar").otherwise("Image").alias("type"),
        F.lit(None).cast("string").alias("timestamp"), F.get("texts", F.lit(0)).alias("displayUrl"), F.transform("texts", lambda t: F.struct(F.lit("Image").alias("type"), t.alias("displayUrl"))).alias("childPosts"), F.col("conv_id").alias("post_pos"),
    )
    return ingest.post_images(posts, {"o0": "north", "o1": "south"}).select("brand", "post_id", "idx", F.md5(F.col("url").cast("binary")).alias("url_md5"))


@query("SELECT page_id, split_part(url, '?', 1) AS clean FROM (SELECT *, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY page_id) AS nth FROM pages) WHERE nth = 1")
def url_first_seen(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", scalars.without_query("url").alias("clean"))
    return ingest.first_seen(rows, F.col("clean"), ["page_id"])


_REPLY = f"""re AS (SELECT event_id AS item_id, CASE event_id % 6
    WHEN 0 THEN '```json' || chr(10) || '{{"overall_consistency": ' || ({K_SQL} // 10) || ', "reason": "ok"}}' || chr(10) || '```' WHEN 1 THEN 'Sure: {{"overall_consistency": ' || ({K_SQL} // 10) || ', "mood": 3}} done' WHEN 2 THEN '[{{"overall_consistency": ' || ({K_SQL} // 10) || '}}, {{"mood": 1}}]'
    WHEN 3 THEN 'no object' WHEN 4 THEN '{{"mood": 1}} and {{"mood": 2}}' ELSE '{{"mood": 2}}' END AS text, {K_SQL} // 10 AS k FROM events)"""


def _replies(spark, sf):
    n = F.floor(event_k() / 10).cast("string")
    kinds = [
        F.concat(F.lit('```json\n{"overall_consistency": '), n, F.lit(', "reason": "ok"}\n```')), F.concat(F.lit('Sure: {"overall_consistency": '), n, F.lit(', "mood": 3} done')), F.concat(F.lit('[{"overall_consistency": '), n, F.lit('}, {"mood": 1}]')),
        F.lit("no object"), F.lit('{"mood": 1} and {"mood": 2}'), F.lit('{"mood": 2}'),
    ]
    return table(spark, sf, "events").select(F.col("event_id").alias("item_id"), F.get(F.array(*kinds), (F.col("event_id") % 6).cast("int")).alias("text"))


@query(f"WITH {_REPLY} SELECT item_id, CASE WHEN item_id % 6 IN (0, 1, 2) THEN k END::double AS overall_consistency, CASE item_id % 6 WHEN 1 THEN 3 WHEN 5 THEN 2 END::double AS mood, CASE item_id % 6 WHEN 3 THEN 'nojson' WHEN 4 THEN 'parse' END AS error FROM re")
def rubric_parse(spark, sf):
    return rubric.parse(_replies(spark, sf)).select("item_id", F.col("overall_consistency").cast("double"), F.col("mood").cast("double"), "error")


@query(f"WITH {_REPLY} SELECT 'api' AS judge, item_id, k / 10 AS score FROM re WHERE item_id % 6 IN (0, 1, 2)")
def rubric_scores(spark, sf):
    return rubric.scores(rubric.parse(_replies(spark, sf)), "api")


@query(f"WITH c AS (SELECT event_type AS judge, {K_SQL} * 10 AS i, {K_SQL} * 4 AS c, {K_SQL} % 7 AS o FROM events) SELECT judge, sum(i)::bigint AS tokens_in, sum(c)::bigint AS cached, sum(o)::bigint AS tokens_out, count(*) AS calls, round(CASE judge WHEN 'click' THEN ((sum(i) - sum(c)) * 2.5 + sum(c) * 1.25 + sum(o) * 10) / 1e6 WHEN 'view' THEN ((sum(i) - sum(c)) * 1.0 + sum(c) * 0.25 + sum(o) * 5) / 1e6 END, 6) AS dollars FROM c GROUP BY judge")
def usage_cost(spark, sf):
    """Tokens of each judge; dollars only for the two that have rates, null for the others."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("judge"), (event_k() * 10).alias("tokens_in"), (event_k() * 4).alias("cached"), (event_k() % 7).alias("tokens_out"))
    return rubric.usage(e, {"click": (2.5, 1.25, 10.0), "view": (1.0, 0.25, 5.0)}).withColumn("dollars", r6("dollars"))


@query("SELECT user_id::varchar AS item_id, substr(sha1(user_id::varchar), 1, 16) AS cache_key FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)")
def cache_todo(spark, sf):
    """Users without a usable cached reply: purchases over 60 stand for replies, other purchases for failed ones."""
    e = table(spark, sf, "events")
    users = e.select(F.col("user_id").cast("string").alias("item_id")).distinct()
    cache = e.where("event_type = 'purchase'").select(F.lit("api").alias("judge"), scalars.cache_key(F.col("user_id").cast("string")).alias("cache_key"), F.when(F.col("value") <= 60, "failed").alias("error"))
    return rubric.to_call(users, cache, "api")


@query("SELECT user_id, max_value, last_type FROM (SELECT user_id, value AS max_value, event_type AS last_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def last_row_wins(spark, sf):
    rows = sampling.last_wins(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", F.col("value").alias("max_value"), F.col("event_type").alias("last_type"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) WHERE nth = 1")
def first_row_wins(spark, sf):
    return sampling.first_wins(table(spark, sf, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id")


def _index(spark, sf):
    o = table(spark, sf, "orders").withColumn("key", F.col("o_orderkey")).withColumn("path", F.concat(F.lit("p/"), (F.col("o_orderkey") % 1000).cast("string"))).withColumn("brand", F.col("o_orderstatus"))
    o = o.withColumn("severity", F.when(F.col("o_orderkey") % 8 == 5, (F.floor(F.col("o_orderkey") / 8) % 3 + 1))).withColumn("prompt_idx", F.when(F.col("o_orderkey") % 8 == 7, F.col("o_custkey") % 50))
    return exam.build_index({name: o.where(F.col("o_orderkey") % 8 == i) for i, name in enumerate(INSTRUMENTS)})


_INDEX_SQL = f"""ix AS (SELECT DISTINCT instrument || ':' || item_id AS item_id, instrument, 'p/' || (item_id % 1000) AS path, CASE WHEN instrument LIKE 'pos%' THEN 'on' WHEN instrument = 'dial' THEN 'ordinal' ELSE 'off' END AS label,
  CASE WHEN instrument = 'corrupt_prog' THEN severity END::double AS severity, CASE WHEN instrument = 'dial' THEN prompt_idx END::double AS prompt_idx FROM ex)"""


@query(f"WITH {EXAM_SQL}, {_INDEX_SQL} SELECT * FROM ix")
def build_index(spark, sf):
    """Eight instruments under one schema."""
    return _index(spark, sf).select("item_id", "instrument", "path", "label", F.col("meta.severity").cast("double").alias("severity"), F.col("meta.prompt_idx").cast("double").alias("prompt_idx"))


@query(f"WITH {EXAM_SQL}, {_INDEX_SQL} SELECT instrument, label, count(*) AS n FROM ix GROUP BY ALL")
def index_coverage(spark, sf):
    return exam.coverage(_index(spark, sf))


@query(f"WITH {EXAM_SQL}, {_INDEX_SQL} SELECT item_id, path FROM ix WHERE path NOT IN (SELECT 'p/' || (p_partkey % 900) FROM part)")
def missing_paths(spark, sf):
    listing = table(spark, sf, "part").select(F.concat(F.lit("p/"), (F.col("p_partkey") % 900).cast("string")).alias("path"))
    return exam.missing_paths(_index(spark, sf), listing).select("item_id", "path")


@query(f"WITH {EXAM_SQL} SELECT judge, instrument, count(*) AS n, round(avg(score), 6) AS mean_score FROM ex WHERE item_id % 10 <> 3 OR judge = 'price' GROUP BY ALL")
def index_scores(spark, sf):
    """Index joined with scores: items that one judge lacks are dropped for that judge only."""
    index = _index(spark, sf)
    scores = exam_items(spark, sf).where("item_id % 10 <> 3 or judge = 'price'").select("judge", F.concat("instrument", F.lit(":"), F.col("item_id").cast("string")).alias("item_id"), "score")
    return exam.with_scores(index, scores).groupBy("judge", "instrument").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score"))


@query(r"""WITH w AS (SELECT doc_id AS item_id, unnest(string_split(text, ' ')) AS word FROM documents), t AS (SELECT item_id, trim(lower(word), '.,!?:;''"()') AS token FROM w)
SELECT item_id, token, count(*) AS n FROM t WHERE token IN ('the', 'license', 'apache', 'version') AND (token NOT IN ('the', 'version') OR item_id IN (SELECT item_id FROM t WHERE token IN ('brand', 'license'))) GROUP BY ALL""")
def lexicon_match(spark, sf):
    """Words of a lexicon; weak ones count only beside a strong one ('apache license' is a phrase of two parts)."""
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.explode(F.split("text", " ")).alias("word"))
    lexicon = spark.createDataFrame([("brand", p) for p in ("the", "license", "apache license", "version")], "brand string, phrase string")
    return masks.lexicon_hits(words, lexicon, "brand", ["the", "version"]).groupBy("item_id", "token").agg(F.count("*").alias("n"))


_LINES = "ln AS (SELECT doc_id AS item_id, unnest(string_split(text, chr(10))) AS phrase FROM documents)"


def _lines(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.explode(F.split("text", "\n")).alias("phrase"))
    return rows.withColumn("conf", (F.length("phrase") % 10) / F.lit(10.0))


@query(rf"""WITH {_LINES}, tk AS (SELECT item_id, phrase, (length(phrase) % 10) / 10.0 AS conf, trim(replace(lower(phrase), ' ', ''), '.,!?:;''"()™®') AS flat,
   len(list_filter(list_transform(string_split_regex(lower(phrase), '\s+'), lambda w: trim(w, '.,!?:;''"()™®')), lambda w: w IN ('license', 'version'))) AS weak FROM ln)
SELECT item_id, phrase FROM tk WHERE conf >= 0.2 AND (contains(flat, 'apache') OR contains(flat, 'licensedunder') OR weak >= 2)""")
def phrase_match(spark, sf):
    return masks.phrase_hits(_lines(spark, sf), "apache", ["licensed under", "mit", "version"], ["license", "version"]).select("item_id", "phrase")


@query(f"""WITH {_LINES}, lx AS (SELECT DISTINCT lower(word) AS phrase FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS word FROM benchmark) WHERE length(word) >= 5),
  fl AS (SELECT item_id, trim(replace(lower(phrase), ' ', ''), '.,!?:;''"()™®') AS flat, count(*) AS n FROM ln GROUP BY ALL)
SELECT phrase, sum(n)::bigint AS lines, count(DISTINCT item_id) AS items FROM fl JOIN lx ON contains(flat, phrase) GROUP BY phrase""")
def phrase_index(spark, sf):
    """How many lines and documents hold each of the thousands of words of the benchmark, blanks left out."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where(F.length("word") >= 5)
    rows = _lines(spark, sf).select("item_id", scalars.squeezed("phrase").alias("flat")).groupBy("item_id", "flat").agg(F.count("*").alias("n"))
    held = masks.held_phrases(rows, "flat", words.select(F.lower("word").alias("phrase")))
    per = held.select("item_id", "n", F.explode("held").alias("phrase")).groupBy("phrase", "item_id").agg(F.sum("n").alias("n"))
    return per.groupBy("phrase").agg(F.sum("n").alias("lines"), F.count("*").alias("items"))


@query(f"""WITH {_LINES} SELECT item_id, bool_or(contains(trim(replace(lower(phrase), ' ', ''), '.,!?:;''"()™®'), 'apache') AND (length(phrase) % 10) / 10.0 >= 0.4) AS contaminated FROM ln GROUP BY item_id""")
def contamination(spark, sf):
    return masks.contaminated(_lines(spark, sf), "apache")


@query("""WITH b AS (SELECT p_partkey, 100 + p_size * 10 AS w, 200 + p_size AS h, p_partkey % 90 AS x, p_partkey % 70 AS y, p_size AS rw, p_size / 2 AS rh FROM part)
SELECT p_partkey, trunc(greatest(0, w * x / 100 - w * rw / 100 * 0.1))::int AS x0, trunc(greatest(0, h * y / 100 - h * rh / 100 * 0.1))::int AS y0, trunc(least(w, w * x / 100 + w * rw / 100 + w * rw / 100 * 0.1))::int AS x1, trunc(least(h, h * y / 100 + h * rh / 100 + h * rh / 100 * 0.1))::int AS y1 FROM b""")
def region_boxes(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (100 + F.col("p_size") * 10).alias("w"), (200 + F.col("p_size")).alias("h"), (F.col("p_partkey") % 90).alias("x"), (F.col("p_partkey") % 70).alias("y"), F.col("p_size").alias("rw"), (F.col("p_size") / 2).alias("rh"))
    box = masks.region_box(F.col("w"), F.col("h"), {"x": F.col("x"), "y": F.col("y"), "w": F.col("rw"), "h": F.col("rh")}, 0.1)
    return rows.select("p_partkey", *(F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query("""SELECT o_custkey, count(*) AS n, CASE WHEN count(*) > 8 THEN 'boxes: ' || count(*) || ' of 8' WHEN avg(o_totalprice) / 500000 > 0.55 THEN 'covers too much' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'still readable' END AS reason FROM orders GROUP BY o_custkey""")
def drop_reasons(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 500000).alias("share"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("left"))
    return o.select("o_custkey", "n", masks.drop_reason(F.col("n"), F.col("share"), F.col("left"), 8, 0.55).alias("reason"))


@query("SELECT DISTINCT o_custkey AS item_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def candidate_union(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return masks.candidate_ids([o.select(F.col("o_custkey").alias("item_id")), c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("item_id"))], c.where("c_acctbal < 0").select(F.col("c_custkey").alias("item_id")))


@query("""SELECT p_partkey, 'fb' AS src, 'Brand#' || split_part(p_brand, '#', 2) AS brand, p_name AS rest, split_part('fb:' || p_brand || '/' || p_name, ':', 1) || '_' || replace(p_brand || '/' || p_name, '/', '_') || '__hue_s' || (p_size % 3 + 1) || '.jpg' AS out_name,
  upper(p_name) AS upper_name, list_aggregate(list_filter(string_split(upper(p_name), ''), lambda x: x <> ''), 'string_agg', ' ') AS spaced FROM part""")
def id_fields(spark, sf):
    """Fields of composite ids, output names and case changes."""
    item = F.concat(F.lit("fb:"), "p_brand", F.lit("/"), "p_name")
    return table(spark, sf, "part").select(
        "p_partkey", scalars.id_source(item).alias("src"), scalars.id_brand(item).alias("brand"), F.split_part(scalars.id_path(item), F.lit("/"), F.lit(2)).alias("rest"), scalars.output_name(item, F.lit("hue"), (F.col("p_size") % 3 + 1).cast("int")).alias("out_name"),
        F.upper("p_name").alias("upper_name"), scalars.spaced_out("p_name").alias("spaced"),
    )


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN floor(epoch(date_trunc('second', ts))) END::double AS epoch_s FROM events")
def iso_epoch(spark, sf):
    """ISO times with Z, without, and unreadable ones, which give null."""
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("not a time")
    return table(spark, sf, "events").select("event_id", scalars.iso_epoch(text).cast("double").alias("epoch_s"))


@query("SELECT p_partkey, (('0x' || substr(md5(p_name || '|' || p_partkey), 1, 12))::bigint % 2147483648) AS seed FROM part")
def item_seeds(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.item_seed("p_name", "p_partkey").alias("seed"))


@query("SELECT sha1(html) AS content_sha1, min(page_id) AS page_id, count(*) AS n FROM pages WHERE strlen(html) >= 5000 GROUP BY 1")
def content_hashes(spark, sf):
    """Landed pages large enough to keep, by content hash."""
    p = table(spark, sf, "pages").where(F.octet_length("html") >= 5000)
    return p.groupBy(F.sha1(F.col("html").cast("binary")).alias("content_sha1")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))

"""Nested scrape records to flat manifests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import first_truthy, without_query


def _urls(array: str) -> Column:
    held = F.coalesce(F.col(array), F.array().cast("array<struct<originalImageUrl: string, resizedImageUrl: string>>"))
    urls = F.transform(held, lambda s: F.coalesce(F.nullif(s["originalImageUrl"], F.lit("")), F.nullif(s["resizedImageUrl"], F.lit(""))))
    return F.filter(urls, lambda u: u.isNotNull())


def brand_map(pages: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pages.items() for x in kv])


def ad_images(ads: DataFrame, pages: dict[str, str], ids: tuple[str, ...] = ("adArchiveId", "adArchiveID")) -> DataFrame:
    """One row an image of the ads whose page is known: images first, then cards, in order.

    An image seen before (its URL without the query) is left out; the first ad
    in ``ad_pos``, then the first image, keeps it.  Two ``ids`` that differ only
    by case need ``spark.sql.caseSensitive``.
    """
    rows = ads.withColumn("brand", brand_map(pages)[F.col("pageName")]).where("brand is not null")
    rows = rows.select(
        "brand", "ad_pos", first_truthy(*ids, default="unknown").alias("ad_id"), F.col("startDate").alias("start_date"),
        F.col("snapshot.displayFormat").alias("display_format"), F.col("isActive").alias("is_active"),
        F.concat(_urls("snapshot.images"), _urls("snapshot.cards")).alias("urls"),
    )
    numbered = dict(rows.dtypes)["ad_pos"] in ("tinyint", "smallint", "int", "bigint")
    if numbered and rows.groupBy("ad_pos").count().where("count > 1").isEmpty():
        rows = _first_urls(rows)
    else:
        # outer, as the other form filters by the array's size first, which works the array out twice
        rows = rows.select("*", F.posexplode_outer("urls").alias("idx", "url")).where("url is not null").drop("urls")
        rows = first_seen(rows, without_query("url"), ["ad_pos", "idx"])
    return rows.withColumn("file", F.format_string("%s/%s_%d.jpg", "brand", "ad_id", "idx"))


def post_images(posts: DataFrame, owners: dict[str, str]) -> DataFrame:
    """One row an image of the posts whose owner is known: single images, or the images of a set."""
    kids = F.transform(F.filter("childPosts", lambda c: c["type"] == "Image"), lambda c: c["displayUrl"])
    urls = F.when(F.col("type") == "Image", F.array("displayUrl")).when(F.col("type") == "Sidecar", F.coalesce(kids, F.array().cast("array<string>")))
    rows = posts.withColumn("brand", brand_map(owners)[F.col("ownerUsername")]).where("brand is not null")
    rows = rows.select("brand", "post_pos", first_truthy("shortCode", "id", default="unknown").alias("post_id"), "timestamp", F.col("type").alias("post_type"), F.posexplode(urls).alias("idx", "url"))
    rows = first_seen(rows.where("url is not null and url <> ''"), without_query("url"), ["post_pos", "idx"])
    return rows.withColumn("file", F.format_string("%s/%s_%d.jpg", "brand", "post_id", "idx"))


def first_seen(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: a map-side-combined minimum, then one join on the key.

    A null key is a key like any other.  Rows of one key and equal order are told apart by a hash of
    all their columns (maps left out), and of wholly equal rows one stays.
    """
    whole = [c for c, kind in df.dtypes if "map<" not in kind]
    # never null, so that the join and the choice among ties share one partitioning
    rows = df.withColumn("_key", F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")))
    first = rows.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    met = rows.join(first, "_key").where(F.struct(*order).eqNullSafe(F.col("_first")))
    kept = met.groupBy("_key").agg(F.min_by(F.struct(*df.columns), F.xxhash64(*whole)).alias("_row"))
    return kept.select("_row.*")


#: More than any array has elements, so that an ad's and an image's number make one.
_PLACES = Decimal(1 << 32)


def _first_urls(ads: DataFrame) -> DataFrame:
    """``first_seen`` of ads that differ in ``ad_pos``, a whole number: one row ``idx, url`` for ``urls``, beside the ad's other columns.

    A place is one number, of which a hash table keeps the least before the shuffle (a struct would be sorted), and it is kept for each whole
    URL, so that the first URL of a key is known without another look at the arrays.
    """
    # null ads come first; the numbers of 2 ** 64 ads and 2 ** 32 images fit 38 digits
    ad = F.coalesce(F.col("ad_pos").cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(_PLACES)
    ads = ads.withColumn("_ad", ad.cast("decimal(37,0)"))
    each = ads.select("_ad", F.posexplode_outer("urls").alias("idx", "url")).where("url is not null")
    places = each.groupBy("url").agg(F.min(F.col("_ad") + F.col("idx")).alias("_place"))
    first = places.groupBy(without_query("url").alias("_key")).agg(F.min(F.struct("_place", "url")).alias("_first")).select("_first.*")
    idx = F.pmod("_place", F.lit(_PLACES))
    first = first.select((F.col("_place") - idx).cast("decimal(37,0)").alias("_ad"), idx.cast("int").alias("idx"), "url")
    return ads.drop("urls").join(first, "_ad").drop("_ad")


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Manifests of several sources under ids ``src:brand/file``."""
    out = None
    for src, df in parts.items():
        one = df.withColumn("src", F.lit(src)).withColumn("image_id", F.concat(F.lit(f"{src}:"), "file"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")

"""Queries over vendors' payloads, made of the driver's parts: a page, feed or response a part."""

from __future__ import annotations

import datetime as dt

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..sources import payloads
from .listings import table

COLUMNS = ("vendor_id", "vendor_sku", "title_raw", "url", "price_ils", "in_stock", "category_guess")
#: Stands for the part's key in the texts below.
K = object()


def _text(*parts) -> Column:
    key = F.col("p_partkey").cast("string")
    return F.concat(*(F.lit(x) if isinstance(x, str) else key if x is K else x for x in parts))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name")


def q_tile_listings(spark, sf_dir):
    """Two tiles of a part, of which the first counts, with a deal on each third, and stock from the availability of all but each fifth."""
    third, whole = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), '<span class="product-card__price-normal">₪ 1,'
    tile = _text('<div class="product-card"><div><span class="product-card__model"> S', K, '</span><div class="product-card__name"><a href="/p/', K, '">', F.col("p_name"), " &amp; co</a></div>", F.when(F.col("p_partkey") % 3 == 0, '<div class="stickers-product-wrapper">New PC</div>').otherwise(""), '<div class="product-card__price">', whole, third, '</span></div></div><i class="info-storage-button" data-claris-code="s', K, '"></i></div>')
    pages = _parts(spark, sf_dir).select(F.col("p_partkey").alias("page"), F.lit("https://tiles.example/x").alias("url"), F.lit("cpu").alias("category_guess"), _text(tile, F.replace(tile, F.lit("1,"), F.lit("9,"))).alias("html"))
    status = F.when(F.col("p_partkey") % 2 == 0, "in_stock").otherwise("on_the_way")
    answers = _parts(spark, sf_dir).where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("request"), _text('{"productsData":[{"Code":"S', K, '&lrm;","AvailabilityStatus":"', status, '","Color":null}]}').alias("json"))
    return payloads.tile_listings(pages, availability=payloads.availability_rows(answers)).select(*COLUMNS)


def q_fragment_listings(spark, sf_dir):
    """A product item of each part, and one without an id."""
    item = _text('<div class="pc-product-item" data-productid="', K, '"><a class="product-link" href="/p-', K, '"></a><span class="product-title" data-price="', K, '.50000000"> ', F.col("p_name"), ' </span></div><div class="pc-product-item"></div>')
    seeds = F.when(F.col("p_partkey") % 2 == 0, "158").otherwise("0")
    pages = _parts(spark, sf_dir).select(seeds.alias("seed"), F.lit("https://items.example/v").alias("url"), item.alias("html"))
    return payloads.fragment_listings(payloads.guessed(pages, "1pc")).select(*COLUMNS)


def q_feed_listings(spark, sf_dir):
    """A feed of each part: a head, its row, and a row of a division that is left out."""
    tail = "\td\tc\tv\ts\t55\tt\ti\t1\t"
    feed = _text("<pre>head</pre><pre>\n", K, " a\t", F.col("p_name"), tail, F.when(F.col("p_partkey") % 2 == 0, " CPUs").otherwise("memory"), "</pre><pre>x\ty", tail, "Cables</pre>")
    return payloads.feed_listings(_parts(spark, sf_dir).select(F.encode(feed, "UTF-8").alias("content"))).select(*COLUMNS)


def q_builder_listings(spark, sf_dir):
    """A response of each part: its own product and one that every response repeats, as a day's snapshot."""
    body = _text('{"Build":{"categories":[{"products":{"a":{"id":', K, ',"title":"', F.col("p_name"), '","barcode":"B', K, '","price":', K, ',"parent":"7","cuts":[3,', K, ']},"b":{"id":"all","title":"same"}}}]}}')
    rows = payloads.build_listings(_parts(spark, sf_dir).select(F.col("p_partkey").alias("request"), F.lit("cpu").alias("category_guess"), body.alias("json")))
    day = payloads.as_snapshot(rows, dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    return day.select(*COLUMNS, F.get_json_object("vendor_meta", "$.cuts").alias("cuts"), "last_seen", "stale")


def q_category_seeds(spark, sf_dir):
    return payloads.category_seeds(spark).groupBy("vendor_id").agg(F.count("*").alias("seeds"), F.max("ord").alias("last"))


def queries():
    return {f.__name__: f for f in (q_tile_listings, q_fragment_listings, q_feed_listings, q_builder_listings, q_category_seeds)}


def oracle_sql() -> dict[str, str]:
    key = "CAST(p_partkey AS VARCHAR)"
    return {
        "q_tile_listings": f"""SELECT 'tms' AS vendor_id, 'S' || {key} AS vendor_sku, p_name || ' & co' AS title_raw, 'https://tiles.example/p/' || {key} AS url, 1000 + p_partkey % 1000 AS price_ils,
            CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 2 = 0 END AS in_stock, CASE WHEN p_partkey % 3 = 0 THEN 'cpu:new-pc-deal' ELSE 'cpu' END AS category_guess FROM part""",
        "q_fragment_listings": f"""SELECT '1pc' AS vendor_id, {key} AS vendor_sku, p_name AS title_raw, 'https://items.example/p-' || {key} AS url, p_partkey + 1 AS price_ils, true AS in_stock,
            CASE WHEN p_partkey % 2 = 0 THEN 'cpu' END AS category_guess FROM part""",
        "q_feed_listings": f"""SELECT 'plonter' AS vendor_id, {key} || ' a' AS vendor_sku, p_name AS title_raw, 'https://www.plonter.co.il/detail.tmpl?sku=' || {key} || '%20a' AS url, '55' AS price_ils, true AS in_stock,
            CASE WHEN p_partkey % 2 = 0 THEN ' CPUs' ELSE 'memory' END AS category_guess FROM part""",
        "q_builder_listings": f"""SELECT 'ivory' AS vendor_id, vendor_sku, title_raw, 'https://www.ivory.co.il/catalog.php?id=' || id AS url, price_ils, true AS in_stock, 'cpu' AS category_guess, cuts, DATE '2024-01-02' AS last_seen, true AS stale
            FROM (SELECT {key} AS id, 'B' || {key} AS vendor_sku, p_name AS title_raw, {key} AS price_ils, '["3","' || {key} || '"]' AS cuts FROM part UNION ALL SELECT 'all', NULL, 'same', NULL, NULL)""",
        "q_category_seeds": "SELECT * FROM (VALUES ('tms', 16::BIGINT, 15), ('1pc', 10, 9), ('ivory', 13, 12)) AS t(vendor_id, seeds, last)",
    }

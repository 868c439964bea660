"""Products from assigned listings: summary, best offer, majority attributes and their conflicts."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..functions import fixed

#: A listing's place in its product: unique, as listing keys are.
PLACE = ("vendor", "listing_key")


def _place(*before: Column) -> Column:
    return F.struct(*before, *PLACE)


def name_rank() -> Column:
    """How well a listing's text names the product: branded, not too long, by vendor, long."""
    vendor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in fixed.VENDOR_RANK.items() for x in kv)), F.col("vendor")), F.lit(9))
    return _place(F.col("brand").isNull().alias("a"), (F.length("match_text") > 150).alias("b"), vendor.alias("c"), (-F.length("match_text")).alias("d"))


def offer_rank() -> Column:
    """In stock before unknown before out of stock, then cheap, fresh, by vendor. Among priced offers."""
    stock = F.when(F.col("in_stock"), 0).when(F.col("in_stock").isNull(), 1).otherwise(2)
    return F.struct(stock.alias("a"), "price", F.coalesce("stale", F.lit(False)).alias("b"), *PLACE)


def summarize(rows: DataFrame) -> DataFrame:
    """A row a product: counts, first category and brand, name, sole part number, bundle mark. Every aggregate combines before the shuffle."""
    name = F.coalesce(F.nullif(F.trim("match_text"), F.lit("")), F.nullif(F.trim("listing_key"), F.lit("")), F.lit("unknown"))
    # A few part numbers at most are told apart: the least and the greatest agree if there is one.
    return rows.groupBy("product_id").agg(
        F.count("*").alias("listings"), F.count_distinct(F.nullif("vendor", F.lit(""))).alias("vendor_count"),
        F.min_by("category", _place()).alias("category"), F.min_by("brand", F.when(F.col("brand").isNotNull(), _place())).alias("brand"),
        F.min_by(name, name_rank()).alias("canonical_name"), F.when(F.min("mpn") == F.max("mpn"), F.min("mpn")).alias("mpn"),
        F.bool_or("bundle_only").alias("bundle_only"),
    )


def best_offer(rows: DataFrame) -> DataFrame:
    """product_id and its best offer's columns; products without a price have none."""
    offer = F.struct("listing_key", "vendor", "price", "in_stock", "stale", "url")
    return rows.where("price is not null").groupBy("product_id").agg(F.min_by(offer, offer_rank()).alias("o")).select("product_id", "o.*")


def best_price(rows: DataFrame) -> DataFrame:
    """product_id, category and the best offer's price in one pass; products without a price have none."""
    rank = F.when(F.col("price").isNotNull(), offer_rank())
    return rows.groupBy("product_id").agg(F.min_by("category", _place()).alias("category"), F.min_by("price", rank).alias("price"))


def offers(rows: DataFrame) -> DataFrame:
    """Offers with their place in the product: by vendor, unpriced last, cheap first."""
    order = W.partitionBy("product_id").orderBy("vendor", F.col("price").isNull(), "price", "listing_key")
    return rows.withColumn("place", F.row_number().over(order))


def attribute_votes(rows: DataFrame) -> DataFrame:
    """product_id, key, norm, votes, first place and raw form of each value of the listings' attributes maps."""
    # Outer, or the plan would infer a filter on the map and work the attributes out twice.
    each = rows.select("product_id", *PLACE, F.explode_outer("attributes").alias("key", "raw")).where("raw is not null and raw <> ''")
    norm = F.lower(F.trim("raw"))
    return each.groupBy("product_id", "key", norm.alias("norm")).agg(F.count("*").alias("votes"), F.min(F.struct(*PLACE)).alias("seen"), F.min_by("raw", F.struct(*PLACE)).alias("raw"))


def majority(rows: DataFrame) -> DataFrame:
    """The most frequent value of each product's attribute, the first seen of equals, and how many values there are."""
    return attribute_votes(rows).groupBy("product_id", "key").agg(F.min_by("raw", F.struct(-F.col("votes"), "seen")).alias("value"), F.count("*").alias("n_values"))


def conflicts(rows: DataFrame) -> DataFrame:
    """The values of attributes on which a product's listings disagree, in the order seen."""
    seen = F.sort_array(F.collect_list(F.struct("seen", "raw")))
    return attribute_votes(rows).groupBy("product_id", "key").agg(seen.alias("v")).where(F.size("v") > 1).select("product_id", "key", F.array_join(F.transform("v", lambda x: x["raw"]), "|").alias("conflict"))

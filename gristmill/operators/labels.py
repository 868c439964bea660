"""Labels for opaque identifiers, learnt from the attributes of the listings that carry them."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

LEAST, SHARE = 2, 0.9


def learn(tallies: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """tallies: kind, id, attr, value, one row an occurrence. Labels: the value that `share` of at least `least` occurrences agree on.

    Above one half the winner is unique, so ties need no rule.
    """
    counts = tallies.where("value is not null and value <> ''").groupBy("kind", "id", "attr", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("kind", "id", "attr").agg(F.sum("n").alias("total"), F.max(F.struct("n", "value")).alias("top"))
    return best.where((F.col("total") >= least) & (F.col("top.n") / F.col("total") >= share)).select("kind", "id", "attr", F.col("top.value").alias("value"))


def apply(listings: DataFrame, labels: DataFrame, key: str = "listing_key", cuts: str = "cuts") -> DataFrame:
    """(key, attr, value) that a listing's cuts, in ascending order, give: the least labelled cut wins each attribute."""
    each = listings.select(key, F.explode(F.array_sort(cuts)).alias("cut"))
    found = each.join(labels.where("kind = 'cuts'").select(F.col("id").cast("long").alias("cut"), "attr", "value"), "cut")
    return found.groupBy(key, "attr").agg(F.min_by("value", "cut").alias("value"))


def tallies(listings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Occurrences of attribute values with listings' cuts (repeats count) and of categories with their parents, for `learn`."""
    known = F.map_filter("attributes", lambda k, v: k.isin(*keys))
    of_cuts = listings.select(F.explode("cuts").alias("id"), known.alias("known")).select(F.lit("cuts").alias("kind"), F.col("id").cast("string").alias("id"), F.explode_outer("known").alias("attr", "value"))
    of_parents = listings.where("parent is not null").select(F.lit("parents").alias("kind"), F.col("parent").alias("id"), F.lit("category").alias("attr"), F.col("category").alias("value"))
    return of_cuts.unionByName(of_parents)


def with_labels(listings: DataFrame, labels: DataFrame) -> DataFrame:
    """listings whose attributes take from labels what they lack: the cuts' values, and ivory_category from the parent."""
    from ..functions.attributes import first_wins

    none = F.create_map().cast("map<string,string>")
    mine = apply(listings, labels).groupBy("listing_key").agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("_labels"))
    up = labels.where("kind = 'parents' and attr = 'category'").select(F.col("id").alias("parent"), F.create_map(F.lit("ivory_category"), F.col("value")).alias("_up"))
    rows = listings.join(mine, "listing_key", "left").join(up, "parent", "left").withColumn("_more", first_wins(F.coalesce("_labels", none), F.coalesce("_up", none)))
    return rows.withColumn("attributes", first_wins(F.col("attributes"), F.col("_more"))).select(*listings.columns)

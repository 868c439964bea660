"""The best row of each listing."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def best_rank(tie: list[str]):
    """Rank of a row among its listing's: priced, cheap, in stock, fresh, recent, then by address and the tie columns. Least is best."""
    return F.struct(
        F.col("price").isNull().alias("unpriced"), F.coalesce("price", F.lit(0)).alias("price"), (~F.col("in_stock").eqNullSafe(True)).alias("not_in_stock"),
        F.coalesce("stale", F.lit(False)).alias("stale"), (-F.unix_date("last_seen")).alias("age"), F.coalesce("url", F.lit("")).alias("url"), *tie,
    )


def dedupe(listings: DataFrame, tie: list[str]) -> DataFrame:
    """One row a listing_key. An aggregate, not a window: each task first keeps its own best, so a frequent key costs a row a task."""
    rank = best_rank(tie)
    best = listings.groupBy("listing_key").agg(F.min_by(F.struct(*[c for c in listings.columns if c != "listing_key"]), rank).alias("best"))
    return best.select("listing_key", "best.*").select(*listings.columns)


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, "first.*").select(*rows.columns)

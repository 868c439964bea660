"""Listings to products: the ledger, then part numbers, then SKUs, else a product of its own."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.text import slug

LEAST_SKU = 5
#: Ledger keys up to which it is broadcast.
SMALL_LEDGER = 200_000


def assign(listings: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Adds product_id and matched_by. ledger: listing_key, manual_id; the first rule that applies decides.

    One projection: a part number or SKU names its product by itself, so nothing is joined but the ledger.
    """
    if ledger is None:
        rows = listings.withColumn("manual_id", F.lit(None).cast("string"))
    else:
        small = F.broadcast(ledger) if ledger.limit(SMALL_LEDGER + 1).count() <= SMALL_LEDGER else ledger
        rows = listings.join(small, "listing_key", "left")
    known = F.col("category").isNotNull() & ~F.col("category").isin("other", "")
    by_mpn = F.when(known & F.col("mpn").isNotNull() & (F.col("mpn") != ""), F.concat(F.lit("mpn:"), "category", F.lit(":"), F.lower("mpn")))
    usable = (F.length("sku_norm") >= LEAST_SKU) & ~F.col("sku_norm").rlike(r"^\d+$")
    by_sku = F.when(known & usable, F.concat(F.lit("sku:"), "category", F.lit(":"), F.lower("sku_norm")))
    alone = F.concat(F.coalesce("category", F.lit("other")), F.lit(":"), "vendor", F.lit(":"), slug("listing_key"))
    how = F.when(F.col("manual_id").isNotNull(), "manual").when(by_mpn.isNotNull(), "mpn").when(by_sku.isNotNull(), "sku").otherwise("singleton")
    return rows.withColumns({"product_id": F.coalesce("manual_id", by_mpn, by_sku, alone), "matched_by": how}).drop("manual_id")


def best_product_rule(rows: DataFrame) -> DataFrame:
    """matched_by of each product: the earliest rule that named it."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in {"manual": 0, "mpn": 1, "sku": 2, "singleton": 3}.items() for x in kv)), F.col("matched_by"))
    return rows.groupBy("product_id").agg(F.min_by("matched_by", rank).alias("matched_by"))

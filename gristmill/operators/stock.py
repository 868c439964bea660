"""Stock of tiles from an availability table."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import fixed
from ..functions.text import availability_key, grab


def stock_state(status: Column, color: Column) -> Column:
    """True, false or unknown, by status or the colour shown; a good colour outweighs a bad status."""
    s, c = F.coalesce(F.trim(status), F.lit("")), F.lower(F.coalesce(F.trim(color), F.lit("")))
    c = F.when(c.isin(*fixed.BLACKS), "#0000ff").otherwise(c)
    return F.when((s == "in_stock") | c.isin("#75a74d", "#0000ff"), True).when(s.isin("out_of_stock", "on_the_way") | c.isin("#b40001", "#c87b1d"), False)


def with_stock(tiles: DataFrame, availability: DataFrame, position: list[str], code: str = "code") -> DataFrame:
    """tiles with in_stock. availability: code, status, color; the last row of a code counts. Null where there is none."""
    rows = availability.withColumn("_key", availability_key("code")).where("_key is not null")
    last = rows.groupBy("_key").agg(F.max_by(stock_state(F.col("status"), F.col("color")), F.struct(*position)).alias("in_stock"))
    return tiles.withColumn("_key", availability_key(code)).join(last, "_key", "left").drop("_key")


def tile_price(normal: Column, block: Column) -> Column:
    """The normal price, else the first amount in the whole price block."""
    digits = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")
    return F.coalesce(digits(grab(normal, r"([\d,]+)")), digits(grab(block, r"₪\s*([\d,]+)")))


def is_deal(sticker: Column, normal: Column, block: Column) -> Column:
    """A deal's sticker, or no normal price and several amounts."""
    marked = F.coalesce(F.contains(sticker, F.lit(fixed.DEAL_PHRASES[0])) | F.contains(sticker, F.lit(fixed.DEAL_PHRASES[1])), F.lit(False))
    return marked | (grab(normal, r"([\d,]+)").isNull() & (F.size(F.regexp_extract_all(F.coalesce(block, F.lit("")), F.lit(r"₪\s*([\d,]+)"), F.lit(1))) > 1))


def tile_category(guess: Column, tile_text: Column, deal: Column) -> Column:
    bundle = F.contains(F.coalesce(tile_text, F.lit("")), F.lit(fixed.BUNDLE_PHRASE))
    return F.concat(guess, F.when(bundle, ":bundle-only").otherwise(""), F.when(deal, ":new-pc-deal").otherwise(""))

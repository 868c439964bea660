"""Who a listing is: vendor, category, brand, part number, key."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from . import fixed
from .text import _col, clean, compact_key, normalize_price, normalize_sku


def vendor(value) -> Column:
    v = F.lower(F.coalesce(_col(value), F.lit("")))
    return F.when(v.isin("1pc", "onepc"), "1pc").otherwise(v)


def title_category(title: Column) -> Column:
    """A category that a cleaned, lower-case title states by itself: the first rule that holds."""
    has = lambda *words: [F.contains(title, F.lit(w)) for w in words]
    any_of = lambda *words: F.array_contains(F.array(*has(*words)), True)
    rules = (
        (any_of("thermal paste", "thermal grease"), "thermal_paste"),
        (has("mounting kit")[0] & has("cooler not included")[0], "cooler_accessory"),
        (any_of("fan controller", "fan hub"), "fan_controller"),
        (has("splitter")[0] & any_of("fan", "rgb"), "fan_controller"),
        (any_of("light strip", "rgb led"), "rgb_lighting"),
        (any_of("starter kit", "expansion kit") & has("fan")[0], "case_fan"),
        (title.rlike(r"\b\d{2,3}\s*mm\b") & title.rlike(r"\bfans?\b"), "case_fan"),
        (any_of("liquid cooling", "aio"), "aio"),
        (any_of("cpu cooler", "air cooler"), "cooler_air"),
    )
    out = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def base_category(key: Column) -> Column:
    """The category that a compacted guess means. Only a bundle's suffix is dropped, so other suffixes lead to 'other' (but for cases)."""
    names = F.create_map(*(F.lit(x) for kv in fixed.CATEGORY_OF.items() for x in kv))
    return F.coalesce(F.try_element_at(names, key), F.when(key.startswith("case") & ~F.contains(key, F.lit("fan")), "case").otherwise("other"))


def refined_category(base: Column, hint: Column) -> Column:
    """A title's hint counts for accessories among cases, and for all of cooling."""
    return F.when((base == "case") & hint.isin(*fixed.ACCESSORIES), hint).when(base == "cooling", F.coalesce(hint, F.lit("cooling_other"))).otherwise(base)


def match_text(sku, title) -> Column:
    """Cleaned SKU and title; a null prints as None, as in the catalogues this must agree with."""
    return clean(F.concat_ws(" ", F.coalesce(_col(sku), F.lit("None")), F.coalesce(_col(title), F.lit("None"))))


def brand_order() -> list[tuple[str, str]]:
    return sorted(fixed.BRAND_OF.items(), key=lambda kv: -len(kv[0]))


def brand(text: Column) -> Column:
    """Brand of the longest alias that stands between spaces; of equally long ones the first listed.

    The words are looked up at once among the aliases, which keep their order; only those of several words are searched for.
    """
    order, low = brand_order(), F.lower(text)
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    several = [F.when(F.contains(padded, F.lit(f" {alias} ")), alias) for alias, _ in order if " " in alias]
    found = F.get(F.array_intersect(F.array(*(F.lit(alias) for alias, _ in order)), F.concat(F.split(low, " "), F.array(*several))), F.lit(0))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in order for x in pair)), found)


def part_number(text: Column) -> Column:
    """Longest find of any pattern; ties go to the earlier pattern, then position. Letters and digits only.

    A text is searched for each pattern only if it has a find of any.
    """
    upper = F.upper(text)
    finds = F.flatten(F.array(*(F.regexp_extract_all(upper, F.lit(p), F.lit(0)) for p in fixed.PART_NUMBERS)))
    ranked = F.transform(finds, lambda x, i: F.struct(-F.length(x), i, x.alias("x")))
    longest = F.regexp_replace(F.get(F.array_sort(ranked), F.lit(0))["x"], "[^A-Z0-9]", "")
    return F.when(upper.rlike("|".join(fixed.PART_NUMBERS)), longest)


def listing_key(vendor_id, sku, url, payload: Column | None = None) -> Column:
    """vendor:identifier. payload: JSON text that stands in where there is neither SKU nor address."""
    v, s, u = vendor(vendor_id), F.nullif(F.trim(_col(sku)), F.lit("")), F.nullif(F.trim(_col(url)), F.lit(""))
    number = F.when(v == "1pc", F.regexp_extract(u, r"product-(\d+)", 1)).when(v == "ivory", F.regexp_extract(u, r"[?&]id=(\d+)", 1))
    hashed = [F.substring(F.sha1(u), 1, 12)] + ([F.substring(F.sha1(payload), 1, 12)] if payload is not None else [])
    return F.concat(v, F.lit(":"), F.coalesce(F.nullif(number, F.lit("")), s, *hashed))


def identify(listings):
    """Raw listings with what tells them apart and ranks them: vendor, listing_key, price."""
    return listings.withColumns({"vendor": vendor("vendor_id"), "listing_key": listing_key("vendor_id", "vendor_sku", "url"), "price": normalize_price("price_ils")})


def describe(identified):
    """Listings with their category, match text, brand, part number, SKU and bundle mark.

    In steps, so that each text is cleaned once and not again for every rule that looks at it.
    """
    guess = F.coalesce("category_guess", F.lit("None"))
    rows = identified.withColumns({
        "match_text": match_text("vendor_sku", "title_raw"), "sku_norm": normalize_sku("vendor_sku"), "bundle_only": F.contains(F.lower(guess), F.lit("bundle-only")),
        "_title": F.lower(clean("title_raw")), "_base": base_category(F.replace(compact_key("category_guess"), F.lit("bundleonly"), F.lit(""))),
    })
    rows = rows.withColumns({"_hint": title_category(F.col("_title")), "brand": brand(F.col("match_text")), "mpn": part_number(F.col("match_text"))})
    return rows.withColumn("category", refined_category(F.col("_base"), F.col("_hint"))).drop("_title", "_base", "_hint")


def enrich(listings):
    """Both steps. Where listings are deduplicated, describe() is better applied to the rows that stay."""
    return describe(identify(listings))

"""Listings from vendors' payloads that are already at hand: tiles, fragments, a text feed, nested JSON."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import fixed
from ..functions.text import quote
from ..operators.dedupe import first_seen
from ..operators.stock import is_deal, tile_category, tile_price, with_stock
from .schemas import RAW_LISTING


def category_seeds(spark: SparkSession) -> DataFrame:
    """What each vendor's payloads are asked for, in order: vendor_id, ord, seed (a page, or an id), category_guess, platform. Small."""
    rows = [("tms", k, str(k), c, None) for k, c in enumerate(fixed.TILE_CATEGORIES)]
    rows += [("1pc", k, str(i), c, None) for k, (i, c) in enumerate(fixed.FRAGMENT_CATEGORIES.items())]
    rows += [("ivory", k, str(i), c, platform) for k, (c, platform, i) in enumerate(fixed.BUILDER_CATEGORIES)]
    return spark.createDataFrame(rows, "vendor_id string, ord int, seed string, category_guess string, platform string")


def guessed(payloads: DataFrame, vendor_id: str, seed_col: str = "seed") -> DataFrame:
    """payloads with the category_guess of the seed that they answer; those of no seed have none."""
    seeds = category_seeds(payloads.sparkSession).where(F.col("vendor_id") == vendor_id).select(F.col("seed").alias(seed_col), "category_guess")
    return payloads.withColumn(seed_col, F.col(seed_col).cast("string")).join(F.broadcast(seeds), seed_col, "left")  # some 40 rows


def as_snapshot(listings: DataFrame, day: dt.date, today: dt.date | None = None) -> DataFrame:
    """Listings of a payload as those of a day's snapshot: the columns of raw listings (null where the payload has none), last_seen and stale."""
    columns = [c.split() for c in RAW_LISTING.split(", ")]
    raw = [(F.col(c) if c in listings.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns]
    return listings.select(*raw, F.lit(day).alias("last_seen"), F.lit(today is not None and day != today).alias("stale"))


def availability_rows(responses: DataFrame, order: str = "request") -> DataFrame:
    """responses: request, json of availabilities. (request, nth, code, status, color) of each product's row; what is no JSON, or has none, gives nothing."""
    body = F.from_json("json", "productsData array<struct<Code:string,AvailabilityStatus:string,Color:string>>")
    each = responses.select(order, F.posexplode(body["productsData"]).alias("nth", "r")).where("r is not null")
    return each.select(order, "nth", F.col("r.Code").alias("code"), F.col("r.AvailabilityStatus").alias("status"), F.col("r.Color").alias("color"))


def select_nodes(html: Column, wanted: dict[str, str], outer: str) -> Column:
    """For each element that `outer` names, a map of the wanted parts' texts or attributes.

    A part is 'tag.class' (its text, the first of several), 'tag.class@attribute', or '*' (all text); tag or class may be
    left out; an empty tag and class mean the outer element. Parsed with the standard library, one text a row.
    """
    @F.pandas_udf("array<map<string,string>>")
    def parse(pages: pd.Series) -> pd.Series:
        from html.parser import HTMLParser

        void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

        def rule(text):
            body, _, attribute = text.partition("@")
            tag, _, name = body.partition(".")
            return tag, name, attribute

        def fits(tag, classes, r):
            return (not r[0] or r[0] == tag) and (not r[1] or r[1] in classes)

        around, rules = rule(outer), {k: (v if v == "*" else rule(v)) for k, v in wanted.items()}

        class Parser(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.stack, self.found, self.out = [], None, []

            def handle_starttag(self, tag, attrs):
                attrs = dict(attrs)
                classes = (attrs.get("class") or "").split()
                opens = self.found is None and fits(tag, classes, around)
                if opens:
                    self.found = {k: "" for k, r in rules.items() if r == "*"}
                    self.depth = len(self.stack)
                reads = []
                if self.found is not None:
                    for k, r in rules.items():
                        if r == "*" or not (opens if not (r[0] or r[1]) else fits(tag, classes, r)):
                            continue
                        if r[2]:
                            if r[2] in attrs:
                                self.found.setdefault(k, attrs[r[2]] or "")
                        elif k not in self.found:
                            self.found[k] = ""
                            reads.append(k)
                if tag not in void:
                    self.stack.append((tag, reads))
                elif opens:
                    self._close()

            def _close(self):
                self.out.append(self.found)
                self.found = None

            def handle_endtag(self, tag):
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == tag:
                        del self.stack[k:]
                        break
                if self.found is not None and len(self.stack) <= self.depth:
                    self._close()

            def handle_data(self, data):
                if self.found is None or self.stack and self.stack[-1][0] in ("script", "style"):
                    return
                for k in {k for _, reads in self.stack for k in reads}:
                    self.found[k] += data
                for k, r in rules.items():
                    if r == "*":
                        self.found[k] += data + " "

        def one(page):
            p = Parser()
            p.feed(page or "")
            p.close()
            return p.out + ([p.found] if p.found is not None else [])

        return pages.map(one)

    return parse(html)


def tile_listings(pages: DataFrame, order: str = "page", availability: DataFrame | None = None) -> DataFrame:
    """pages: page, url, category_guess, html of product tiles. Listings, the first of each SKU and address in the whole run.

    availability: see availability_rows; without it, and for codes that it lacks, in_stock is unknown.
    """
    parts = {"sku": ".product-card__model", "title": ".product-card__name", "href": "a@href", "normal": ".product-card__price-normal", "block": ".product-card__price", "sticker": ".stickers-product-wrapper", "code": ".info-storage-button@data-claris-code", "all": "*"}
    each = pages.select(order, "url", "category_guess", F.posexplode(select_nodes(F.col("html"), parts, "div.product-card")).alias("nth", "t"))
    t = lambda k: F.try_element_at("t", F.lit(k))
    deal = is_deal(t("sticker"), t("normal"), t("block"))
    site = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    address = F.when(t("href").startswith("/"), F.concat(site, t("href"))).otherwise(t("href"))
    rows = each.select(
        order, "nth", F.trim(t("sku")).alias("vendor_sku"), F.trim(t("title")).alias("title_raw"), address.alias("link"), tile_price(t("normal"), t("block")).alias("price_ils"),
        tile_category(F.col("category_guess"), t("all"), deal).alias("category_guess"), t("code").alias("code"),
    )
    first = first_seen(rows, ["vendor_sku", "link"], [order, "nth"]).withColumnRenamed("link", "url").withColumn("vendor_id", F.lit("tms"))
    if availability is None:
        return first.withColumn("in_stock", F.lit(None).cast("boolean"))
    return with_stock(first, availability, [c for c in availability.columns if c not in ("code", "status", "color")])


def fragment_listings(pages: DataFrame) -> DataFrame:
    """pages: url, category_guess, html of product items. Items without an id are left out."""
    parts = {"id": "@data-productid", "href": "a.product-link@href", "title": "span.product-title", "price": "span.product-title@data-price"}
    each = pages.select("url", "category_guess", F.explode(select_nodes(F.col("html"), parts, "div.pc-product-item")).alias("t"))
    t = lambda k: F.try_element_at("t", F.lit(k))
    site = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    price = F.round(t("price").try_cast("decimal(38,10)"), 0).cast("bigint")
    return each.where(t("id") != "").select(F.lit("1pc").alias("vendor_id"), t("id").alias("vendor_sku"), F.trim(t("title")).alias("title_raw"), F.concat(site, t("href")).alias("url"), price.alias("price_ils"), F.lit(True).alias("in_stock"), "category_guess")


def feed_listings(files: DataFrame) -> DataFrame:
    """files: content (bytes in windows-1255): every <pre> after the first is a row of tab-separated fields."""
    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("cp1255", "replace"))

    blocks = F.regexp_extract_all(decode("content"), F.lit(r"(?is)<pre[^>]*>(.*?)</pre>"), F.lit(1))
    row = F.regexp_replace(F.col("block"), r"^[\r\n]+|[\r\n]+$", "")
    fields = files.select(F.explode(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("block")).select(F.split(row, "\t").alias("f"))
    named = fields.select(*(F.get("f", F.lit(k)).alias(c) for k, c in enumerate(fixed.FEED_COLUMNS)))
    kept = named.where((F.col("sku") != "") & F.lower(F.trim("engdivision")).isin(*fixed.FEED_DIVISIONS))
    return kept.select(F.lit("plonter").alias("vendor_id"), F.col("sku").alias("vendor_sku"), F.col("title").alias("title_raw"), F.concat(F.lit("https://www.plonter.co.il/detail.tmpl?sku="), quote("sku")).alias("url"), F.col("price_total").alias("price_ils"), F.lit(True).alias("in_stock"), F.col("engdivision").alias("category_guess"))


def build_listings(responses: DataFrame, order: str = "request") -> DataFrame:
    """responses: request, category_guess, json of a builder's categories. The first product of each id over all requests; what is no JSON is left out."""
    product = "struct<id:string,title:string,barcode:string,price:string,parent:string,cuts:array<string>>"
    body = F.from_json("json", f"Build struct<categories:array<struct<products:map<string,{product}>>>>")
    cats = responses.select(order, "category_guess", F.posexplode(body["Build"]["categories"]).alias("c", "cat"))
    each = cats.select(order, "category_guess", "c", F.posexplode(F.map_values("cat.products")).alias("p", "x")).where("x.id is not null")
    rows = each.select(order, "c", "p", "category_guess", F.col("x.id").alias("id"), F.col("x.barcode").alias("vendor_sku"), F.col("x.title").alias("title_raw"), F.col("x.price").alias("price_ils"), F.col("x.parent").alias("parent"), F.col("x.cuts").alias("cuts"))
    first = first_seen(rows, ["id"], [order, "c", "p"])
    meta = F.to_json(F.struct("cuts", "parent"))
    return first.select(F.lit("ivory").alias("vendor_id"), "vendor_sku", "title_raw", F.concat(F.lit("https://www.ivory.co.il/catalog.php?id="), "id").alias("url"), "price_ils", F.lit(True).alias("in_stock"), "category_guess", meta.alias("vendor_meta"))

"""A view of the driver's tables as vendors' listings, the input of the catalogue's queries."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

BRANDS = ("ASUS", "MSI", "Gigabyte", "Lian Li", "Fractal Design", "Kingston", "Antec", "Intel", "AMD", "NoBrand")
SPECS = ("B760M DDR5 WIFI 6E mATX", "X670E ATX DDR5 2.5G LAN V2", "Ryzen 5 7600X Tray AM5", "Core i5-12400F Box LGA1700", "RTX 4070 TI 12GB GDDR6", "850W 80 PLUS GOLD FULL MODULAR", "DDR5 32GB (2x16GB) 6000MHz CL30", "120mm fan ARGB PWM white")
CATEGORIES = ("motherboards", "CPUs", "RAM", "display adapters", "power supply", "computer cases", "case fans", "case:bundle-only", "cpu:new-pc-deal", "fans and cooling solutions", "hdd", "ssd")
VENDORS = ("TMS", "onepc", "plonter", "ivory")
#: What tells rows of the view apart.
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_ils"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings from lineitem and part."""
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    k, v = F.col("l_partkey").cast("string"), F.col("l_suppkey") % 4
    part, line = F.col("l_partkey"), F.col("l_linenumber") % 4
    money = lambda t: F.col("l_extendedprice").cast(t).cast("string")
    sku = F.when(part % 5 == 0, F.concat(F.lit("FD-C-"), k, F.lit("-01"))).when(part % 5 == 1, F.concat(F.lit("GV-N"), k, F.lit("-8G"))).when(part % 5 == 2, k).when(part % 5 == 3, F.concat(F.lit("O11-"), k, F.lit("W")))
    url = F.when(v == 1, F.concat(F.lit("https://v.example/en/product-"), k, F.lit("-x"))).when(v == 3, F.concat(F.lit("https://v.example/catalog.php?id="), k)).otherwise(F.concat(F.lit("https://v.example/p/"), k))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pick(VENDORS, v).alias("vendor_id"), sku.alias("vendor_sku"), url.alias("url"),
        F.concat_ws(" ", pick(BRANDS, F.floor(part / 5) % 10), "p_name", pick(SPECS, F.floor(part / 12) % 8)).alias("title_raw"),
        F.when(line == 1, F.concat(F.lit("₪ "), money("decimal(18,2)"))).when(line == 2, money("decimal(20,8)")).when(line == 3, money("decimal(18,2)")).alias("price_ils"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("in_stock"),
        pick(CATEGORIES, part % 12).alias("category_guess"), F.to_date("l_shipdate").alias("last_seen"), (F.col("l_linestatus") == "O").alias("stale"),
    )

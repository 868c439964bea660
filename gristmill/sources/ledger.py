"""The ledger of products that people confirmed."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .schemas import LEDGER


def read_ledger(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listing_key, manual_id), products, (key_1, key_2) that must not be proposed. A missing file gives empty tables; a key's last product counts."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    raw = spark.read.schema(LEDGER).json(path, multiLine=True) if path and there else spark.createDataFrame([], LEDGER)
    products = raw.select(F.posexplode("products").alias("pos", "p")).select("pos", "p.*")
    keys = products.select("pos", "product_id", F.explode("listing_keys").alias("listing_key"))
    keys = keys.groupBy("listing_key").agg(F.max_by("product_id", "pos").alias("manual_id"))
    products = products.groupBy("product_id").agg(F.max_by(F.struct("canonical_name", "category", "brand", "model", "attributes"), "pos").alias("p")).select("product_id", "p.*")
    blocked = raw.select(F.explode("blocked_pairs").alias("b")).where("size(b) = 2").select(F.col("b")[0].alias("key_1"), F.col("b")[1].alias("key_2"))
    return keys, products, blocked

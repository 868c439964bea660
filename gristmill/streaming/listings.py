"""Listings as a stream: each micro-batch updates the table of best rows a listing, with the batch operators."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions.identity import enrich
from ..operators.dedupe import dedupe
from ..sources.schemas import RAW_LISTING


def listing_stream(spark: SparkSession, path: str) -> DataFrame:
    """New JSON files below path as raw listings, with the file's modification date as last_seen."""
    return spark.readStream.schema(RAW_LISTING).json(path).withColumns({"last_seen": F.to_date("_metadata.file_modification_time"), "stale": F.lit(False)})


def keep_best(stream: DataFrame, table: str, checkpoint: str):
    """Start a query that keeps `table` (a folder of versions) at the best row of each listing seen so far.

    A batch writes a new version from the last and its own rows; running a batch again writes the same version. Two
    versions stay: the newest, and the one that a batch which runs again needs.
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = enrich(batch)
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{table}/v={number - 1}"))
        dedupe(rows, ["scraped_at"]).write.mode("overwrite").parquet(f"{table}/v={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Listings seen a day and vendor, late rows admitted up to the delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("day"), "vendor").agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), "vendor", "n")

"""JSON lines, with what can be recovered from broken ones, and dated snapshots of them."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import fixed
from ..functions.identity import vendor
from .schemas import RAW_LISTING

LOOKBACK_DAYS = 14


def recover_objects(line: Column) -> Column:
    """The JSON objects of a line, as texts: all of it, else one after the other from each next opening bracket up to what can't be read.

    Values that are no objects are left out. Lines that are one whole object, as nearly all are, stay in the JVM.
    """
    @F.pandas_udf("array<string>")
    def recover(lines: pd.Series) -> pd.Series:
        import json
        import re

        decoder, opening = json.JSONDecoder(), re.compile(r"[{\[]")

        def one(line):
            line = (line or "").strip("﻿ \t\r\n\x0b\x0c")
            if not line:
                return []
            try:
                return [line] if isinstance(json.loads(line), dict) else []
            except ValueError:
                pass
            found, at = [], 0
            while m := opening.search(line, at):
                try:
                    value, at = decoder.raw_decode(line, m.start())
                except ValueError:
                    break
                if isinstance(value, dict):
                    found.append(line[m.start() : at])
            return found

        return lines.map(one)

    whole = line.rlike(r"^[ \t\r\n]*\{(?s:.*)\}[ \t\r\n]*$") & ~line.rlike(r"\}\s*[{\[]") & F.json_object_keys(line).isNotNull()
    return F.when(whole, F.array(line)).otherwise(recover(F.when(~F.coalesce(whole, F.lit(False)), line)))


def read_json_lines(spark: SparkSession, paths: list[str], schema: str = RAW_LISTING) -> DataFrame:
    """Rows of the objects in the files, with file and ord (the order of lines, then of objects in a line)."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    each = lines.select("file", "line", F.posexplode(recover_objects(F.col("value"))).alias("nth", "json"))
    return each.select("file", F.struct("line", "nth").alias("ord"), F.from_json("json", schema).alias("r")).select("r.*", "file", "ord")


def latest_snapshot(files: DataFrame, today: dt.date, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """files: vendor, date and any more columns. The newest date of each vendor within the lookback, today included; `stale` if it isn't today's."""
    near = files.where(F.col("date").between(F.date_sub(F.lit(today), lookback), F.lit(today)))
    rest = [c for c in files.columns if c != "vendor"]
    rank = F.struct(-F.unix_date("date"), *(["alias_rank"] if "alias_rank" in files.columns else []))
    best = near.groupBy("vendor").agg(F.min_by(F.struct(*rest), rank).alias("best")).select("vendor", "best.*")
    return best.withColumn("stale", F.col("date") != F.lit(today))


def snapshot_files(spark: SparkSession, root: str, today: dt.date, lookback: int = LOOKBACK_DAYS) -> list[tuple[str, dt.date, str]]:
    """(vendor, date, path) of each vendor's newest file. The file's being there counts, not its rows; a bounded number of paths is looked up."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for name in fixed.VENDORS:
        for days in range(lookback + 1):
            day = today - dt.timedelta(days)
            paths = [f"{root}/{day}/{alias}.jsonl" for alias in fixed.VENDOR_FILES.get(name, (name,))]
            there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
            if there:
                out.append((name, day, there[0]))
                break
    return out


def read_snapshots(spark: SparkSession, root: str, today: dt.date, lookback: int = LOOKBACK_DAYS) -> tuple[DataFrame, list[str]]:
    """All vendors' newest listings with last_seen and stale, and the vendors that have none."""
    chosen = snapshot_files(spark, root, today, lookback)
    out = spark.createDataFrame([], RAW_LISTING).withColumns({"last_seen": F.lit(today), "stale": F.lit(False), "ord": F.lit(None).cast("struct<vendor:int,line:bigint,nth:int>")})
    for name, day, path in chosen:
        rows = read_json_lines(spark, [path]).drop("file")
        place = F.struct(F.lit(fixed.VENDORS.index(name)).alias("vendor"), F.col("ord.line").alias("line"), F.col("ord.nth").alias("nth"))
        named = F.coalesce(F.nullif("vendor_id", F.lit("")), vendor(F.lit(name)))
        out = out.unionByName(rows.withColumns({"vendor_id": named, "last_seen": F.lit(day), "stale": F.lit(day != today), "ord": place}))
    return out, [v for v in fixed.VENDORS if v not in {c[0] for c in chosen}]

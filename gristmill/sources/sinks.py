"""Where the catalogue goes: tables that replace the old ones together, a document of the whole, raw snapshots, labels."""

from __future__ import annotations

import json
import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .schemas import LABELS

#: The order of each table in its exports; the review queue's equals follow the listings' order.
ORDER = {
    "listings": ["vendor_id", "listing_key"], "products": ["product_id"], "offers": ["product_id", "place"], "attributes": ["product_id", "key"], "conflicts": ["product_id", "key"],
    "review": ["-score", "category", "brand", "listing_key_a", "listing_key_b"],
}
CURRENT = "CURRENT"


class EmptyResult(ValueError):
    """A run that would publish nothing."""


def _store(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(at).getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, at: str, text: str) -> None:
    """Write a small file aside, then put it in its place."""
    path, store = _store(spark, at)
    aside = path(f"{at}.{uuid.uuid4().hex}")
    out = store.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(path(at), False)
    store.rename(aside, path(at))


def ordered(df: DataFrame, name: str) -> DataFrame:
    """A table in the order of its exports."""
    return df.orderBy(*(F.desc(k[1:]) if k.startswith("-") else F.col(k) for k in ORDER[name]))


def publish(tables: dict[str, DataFrame], root: str, must_have: tuple[str, ...] = ("listings", "products")) -> None:
    """Write the tables below root as a new version; one small file says which version counts, so readers see all of the old or all of the new.

    The tables that must have rows are counted before. The version before last is removed.
    """
    spark, version = next(iter(tables.values())).sparkSession, f"v-{uuid.uuid4().hex}"
    path, store = _store(spark, root)
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    for name in must_have:
        if name in tables and not spark.read.parquet(f"{root}/{version}/{name}").take(1):
            store.delete(path(f"{root}/{version}"), True)
            raise EmptyResult(f"{name} has no rows; nothing was published")
    old = current_version(spark, root)
    _write_text(spark, f"{root}/{CURRENT}", f"{version}\n{old or ''}")
    for status in store.listStatus(path(root)):
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in (version, old):
            store.delete(status.getPath(), True)


def current_version(spark: SparkSession, root: str) -> str | None:
    path, store = _store(spark, root)
    if not store.exists(path(f"{root}/{CURRENT}")):
        return None
    return spark.read.text(f"{root}/{CURRENT}", wholetext=True).first()[0].split("\n")[0]


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current_version(spark, root)}/{name}")


def write_raw(listings: DataFrame, root: str) -> None:
    """Raw JSON lines as <date>/<vendor>.jsonl, a folder of parts that read_snapshots takes for a file, replacing the same day's. An empty run writes nothing."""
    spark, aside = listings.sparkSession, f"{root}/_new-{uuid.uuid4().hex}"
    listings.write.partitionBy("date", "vendor").json(aside)
    path, store = _store(spark, root)
    for day in store.listStatus(path(aside)):
        if "=" in (at := day.getPath().getName()):
            for vendor in store.listStatus(day.getPath()):  # vendors of a day
                to = path(f"{root}/{at.split('=')[1]}/{vendor.getPath().getName().split('=')[1]}.jsonl")
                store.mkdirs(to.getParent())
                store.delete(to, True)
                store.rename(vendor.getPath(), to)
    store.delete(path(aside), True)


def run_summary(tables: dict[str, DataFrame], skipped: list[str]) -> DataFrame:
    """One row: when, how many listings, products and review pairs, and the vendors that had no snapshot."""
    spark = tables["listings"].sparkSession
    counts = [tables[k].count() if k in tables else 0 for k in ("listings", "products", "review")]
    row = spark.createDataFrame([(*counts, skipped)], "listings long, products long, review_queue_count long, skipped_vendors array<string>")
    return row.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def export_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines, in as many files as it has partitions."""
    df.write.mode("overwrite").json(path)


def export_document(tables: dict[str, DataFrame], skipped: list[str], at: str) -> None:
    """The catalogue as one JSON document: generated_at, listings and products in order, review_queue_count, skipped_vendors.

    Tasks write the rows, sorted by range; the file system's streams join their files. Nothing is collected.
    """
    summary = run_summary(tables, skipped).first()
    end = {"review_queue_count": summary.review_queue_count, "skipped_vendors": summary.skipped_vendors}
    _document(tables["listings"].sparkSession, at, {"generated_at": summary.generated_at}, {k: tables[k] for k in ("listings", "products")}, end)


def export_review(review: DataFrame, at: str) -> None:
    """The review queue as one JSON document: a list, the highest scores first."""
    _document(review.sparkSession, at, None, {"review": review}, None)


def _document(spark: SparkSession, at: str, head: dict | None, tables: dict[str, DataFrame], end: dict | None) -> None:
    path, store = _store(spark, at)
    copy, aside = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes, f"{at}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        rows = ordered(df, name)
        keys = [k.lstrip("-") for k in ORDER[name]]
        first, begins = rows.select(*keys).first(), F.lit(True)  # its keys are the row's own, so no other row begins the list
        for k in keys:
            begins = begins & F.col(k).eqNullSafe(F.lit(first[k] if first else None))
        rows.select(F.concat(F.when(begins, "").otherwise(","), F.to_json(F.struct("*")))).write.text(f"{aside}/{name}")
    out = store.create(path(f"{aside}/document"), True)
    say = lambda text: out.write(bytearray(text.encode()))
    if head is not None:
        say(json.dumps(head, ensure_ascii=False)[:-1])
    for name in tables:
        say(f', "{name}": [\n' if head is not None else "[\n")
        for part in sorted(str(f.getPath()) for f in store.listStatus(path(f"{aside}/{name}")) if f.getPath().getName().startswith("part-")):
            source = store.open(path(part))
            copy(source, out, 1 << 16, False)
            source.close()
        say("]")
    if end is not None:
        say(", " + json.dumps(end, ensure_ascii=False)[1:])
    out.close()
    store.delete(path(at), False)
    store.rename(path(f"{aside}/document"), path(at))
    store.delete(path(aside), True)


# ---------------------------------------------------------------- the file of learnt labels
def write_labels(labels: DataFrame, at: str) -> None:
    """Labels (kind, id, attr, value) as one JSON document: {kind: {id: {attr: value}}}. As many as the builder has ids."""
    kinds: dict = {"cuts": {}, "parents": {}}
    for r in labels.select("kind", "id", "attr", "value").orderBy("kind", "id", "attr").toLocalIterator():
        kinds[r.kind].setdefault(r.id, {})[r.attr] = r.value
    _write_text(labels.sparkSession, at, json.dumps(kinds, ensure_ascii=False, indent=2))


def read_labels(spark: SparkSession, at: str) -> DataFrame:
    """The labels of such a file; a missing or broken one gives none."""
    path, store = _store(spark, at)
    if not store.exists(path(at)):
        return spark.createDataFrame([], LABELS)
    body = F.from_json("value", "map<string,map<string,map<string,string>>>")
    kinds = spark.read.text(at, wholetext=True).select(F.explode(body).alias("kind", "ids"))
    return kinds.select("kind", F.explode("ids").alias("id", "values")).select("kind", "id", F.explode("values").alias("attr", "value"))

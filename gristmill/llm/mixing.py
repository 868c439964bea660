"""Mixing sources to target sizes by hash thresholds, without sorting.

A document takes part whole, as many times as its source's ratio of target to size has whole parts, and once
more if its hash lies under the source's threshold. The threshold is found from a histogram of sizes by
source and leading hash bits; only the bucket that holds the budget's boundary is refined, by further bits.
What reaches the driver is a few numbers a source.

Defined results: a null text has size 0, and a document of size 0 takes nothing; a null source is a source
of its own, ordered last; rows repeated with the same id and text share a hash, so they are taken or left
together; an empty table gives no rows; extra columns pass through mixed_rows whatever they are called, and are not read
by mix_sources; a very long text is one document, counted whole; the choice depends on the rows' content alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, few, named, numbered, place

BITS, LEVELS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def target_sizes(sizes: dict, weights: tuple[int, ...], most: int) -> dict:
    """Share the total by weight; what exceeds `most` times a source's size goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    free, left, out = set(order), float(sum(sizes.values())), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def _boundary(sizes: DataFrame, budgets: dict) -> dict:
    """For each source index: (threshold, taken): rows with u < threshold sum to about the budget."""
    spark = sizes.sparkSession
    state = {s: (0, 0) for s in budgets}  # prefix of the boundary bucket so far, sum below it
    done: dict = {}
    for level in range(1, LEVELS + 1):
        if not state:
            break
        shift, rows = 60 - BITS * level, sizes
        now = spark.createDataFrame([(s, p, float(budgets[s] - b)) for s, (p, b) in state.items()], "s int, prefix long, rest double")
        if level > 1:
            rows = rows.withColumn("prefix", F.shiftright("u", shift + BITS)).join(now.select("s", "prefix"), ["s", "prefix"], "left_semi")
        buckets = rows.groupBy("s", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("u").alias("low"), F.max("u").alias("high"))
        # At most 2**BITS rows a source, gathered to one row: the first bucket that the budget doesn't cover.
        ranked = buckets.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("bucket", "size", "low", "high"))).alias("b")).join(now.select("s", "rest"), "s")
        walk = F.expr("aggregate(b, named_struct('below', 0L, 'hit', cast(null as struct<bucket:bigint,size:bigint,low:bigint,high:bigint>)), (a, x) -> if(a.hit is null, if(a.below + x.size <= rest, named_struct('below', a.below + x.size, 'hit', a.hit), named_struct('below', a.below, 'hit', x)), a))")
        seen = set()
        for r in ranked.select("s", walk.alias("w")).collect():
            s, below, hit = r.s, r.w.below, r.w.hit
            seen.add(s)
            before = state[s][1] + below
            if hit is None:
                done[s] = (1 << 60, before) if level == 1 else ((state[s][0] + 1) << (shift + BITS), before)
            elif hit.low == hit.high:  # one hash value: take it if that is nearer
                take = 2 * (budgets[s] - before) > hit.size
                done[s] = (hit.low + take, before + take * hit.size)
            elif level == LEVELS:
                done[s] = (hit.bucket << shift, before)
            else:
                state[s] = (hit.bucket, before)
        for s in set(state) - seen:
            done[s] = (0, 0)
        state = {s: v for s, v in state.items() if s not in done}
    return done


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, and a row a source: source_size, target, whole copies, threshold."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "mix")
    rows = work.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("u")), "sizes")
    sums = {r.source: r.size for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = target_sizes(sums, weights, most)
    names = {s: k for k, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    whole = {s: int(targets[s] // sums[s]) if sums[s] else 0 for s in sums}
    index = few(spark.createDataFrame(list(names.items()), "source string, s int"), len(names))
    named = rows.join(index, rows.source.eqNullSafe(index.source)).drop(index.source)
    found = _boundary(named.where("size > 0").select("s", "size", "u"), {names[s]: targets[s] - whole[s] * sums[s] for s in sums})
    plan = [(s, sums[s], targets[s], whole[s], found[names[s]][0]) for s in sums]
    return rows, few(spark.createDataFrame(plan, "_source string, source_size long, target double, whole int, threshold long"), len(plan))


def _hash(id_col: str, text_col: str):
    """The first 60 bits of an MD5 of the row's content, which SQL engines have too."""
    content = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(content), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each document. Sources weigh `weights` in turn, by code point."""
    rows, plan = _plan(docs, id_col, text_col, source_col, weights, most)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + (F.col("u") < F.col("threshold")).cast("int"))
    return rows.join(plan, rows.source.eqNullSafe(plan["_source"])).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns."""
    own, own_id, own_text, own_source = numbered(docs), *(place(docs, c) for c in (id_col, text_col, source_col))
    _, plan = _plan(own, own_id, own_text, own_source, weights, most)
    rows = own.withColumns({"_size": word_count(F.col(own_text)), "_u": _hash(own_id, own_text)})
    rows = rows.join(plan, F.col(own_source).eqNullSafe(plan["_source"]))
    copies = F.col("whole") + (F.col("_u") < F.col("threshold")).cast("int")
    return named(rows.where((F.col("_size") > 0) & (copies > 0)).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))), docs)

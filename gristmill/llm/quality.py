"""Quality rules: counts of words, lines and symbols, and perplexity bands of a byte n-gram model per language.

Spark counts the n-grams of every whole text (each task sends one row a distinct n-gram) and works out the
interpolated modified Kneser-Ney probabilities of the highest order, level by level, with joins and windows of at
most 256 rows. They are stored as arrays sorted by 64-bit hashes in the shared folder: those of the most frequent
n-grams, RESIDENT at most, in one that each worker holds; the rest in ranges of the hash. A scan scores every text with
vectorised binary search in the first; n-grams that it lacks go, once a document, to the task of their range, which
searches that. As the model counts the texts that it scores, no look-up has to back off. Log probabilities are fixed-point
numbers, so sums and verdicts are the same wherever an n-gram is found, and nothing of the model is on the driver.

A text's score is the perplexity of a word that has a letter or digit (per byte, symbols strewn between words would
even out); per language, a histogram of the scores gives quartiles, and what lies further than REACH interquartile
ranges from them on either side is rejected: too predictable, or unlike its language.

Defined results: a null text has no words and fails; a null language is a language of its own; model and band of a
language come from its own documents, however few; repeated rows are scored alike; an empty table gives no rows;
other columns pass through, whatever they are called; a very long text is scored whole, by the task that reads it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SPACE, batchwise, mix, span_hashes, sums_by, text_slices, window_hashes, word_bounds
from .shared import Workspace, few, named, numbered, open_store, partitions, place

ORDER = 5
#: N-grams that a task gathers before it sends them, those that each worker holds, those of a range of the others.
HELD, RESIDENT, RANGE = 4_000_000, 2_000_000, 1 << 20
#: Log probabilities are multiples of 1 / UNIT.
UNIT = 1 << 20
#: Interquartile ranges from the quartiles, the least range, and bins a unit of log perplexity.
REACH, LEAST_RANGE, BINS = 3.0, 0.2, 128
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Letters, digits and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
METRICS = "_n_words long, _word_chars long, _n_symbols long, _n_dup_lines long, _n_repeat_words long, _base_failed boolean, _real long, _cost long, _row long, _rest array<long>, _times array<int>"


# ---------------------------------------------------------------- n-gram keys
def gram_keys(buf: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """For each byte the `order` bytes that end with it, big-endian in one integer; zeros stand before a text."""
    n = len(buf)
    out = np.zeros(n, np.uint64)
    place = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    wide = buf.astype(np.uint64)
    for k in range(order):
        part = wide[: n - k] << np.uint64(8 * k)
        out[k:] |= np.where(place[k:] >= k, part, np.uint64(0))
    return out


def _distinct(keys: np.ndarray, sizes: np.ndarray, langs: np.ndarray):
    """(language, distinct keys, how often each occurs, where each byte's key stands, its bytes) of a slice's languages."""
    for lang in np.unique(langs):
        mine = np.flatnonzero(np.repeat(langs == lang, sizes))
        u, at, n = np.unique(keys[mine], return_inverse=True, return_counts=True)
        yield int(lang), u, n, at, mine


def _count(order: int):
    schema = pa.schema([("l", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])

    def rows(held):
        for lang, (keys, n) in held.items():
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), lang)), pa.array(part), pa.array(n[k : k + 100_000])], schema=schema)

    def run(batches):
        held: dict = {}
        for batch in batches:
            langs = batch.column(1).to_numpy()
            for first, last, buf, offs in text_slices(batch.column(0)):
                for lang, new, n, _, _ in _distinct(gram_keys(buf, offs, order), np.diff(offs), langs[first:last]):
                    if lang in held:
                        new, at = np.unique(np.concatenate([held[lang][0], new]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([held[lang][1], n]), len(new)).astype(np.int64)
                    held[lang] = new, n
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    return run


# ---------------------------------------------------------------- the model
def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(l, gram, n, log_p) of the n-grams of the highest order, from (l, gram, n): interpolated modified Kneser-Ney."""
    levels = [counts.withColumnRenamed("n", "c")]
    for k in range(order - 1, 0, -1):  # how many different bytes precede each
        levels.append(levels[-1].groupBy("l", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("c")))
    many = counts.select("l").distinct().count()
    context, lower = Window.partitionBy("l", F.shiftright("gram", 8)), None
    for k, level in enumerate(reversed(levels), 1):
        full = level.join(few(_discounts(level), many), "l")
        full = full.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        full = full.withColumns({"total": F.sum("c").over(context), "left": F.sum("d").over(context)})
        base = F.lit(1 / 256)
        if k > 1:
            full = full.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(lower, ["l", "suffix"])
            base = F.col("base")
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("left") / F.col("total") * base
        lower = full.select("l", F.col("gram").alias("suffix"), "c", p.alias("base"))
        if k < order:
            lower = lower.drop("c")
    return lower.select("l", F.col("suffix").alias("gram"), F.col("c").alias("n"), F.log("base").alias("log_p"))


def _discounts(level: DataFrame) -> DataFrame:
    """(l, d1, d2, d3) from the counts of counts; where those are too few, the absolute discounts 0.5, 1, 1.5."""
    counts = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y, some = n1 / (n1 + 2 * n2), (n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0)
    raw = ((1.0, 0.5, 1 - 2 * y * n2 / n1), (2.0, 1.0, 2 - 3 * y * n3 / n2), (3.0, 1.5, 3 - 4 * y * n4 / n3))
    d = [F.when(some, F.least(F.greatest(x, F.lit(0.05)), F.lit(most))).otherwise(plain).alias(f"d{k}") for k, (most, plain, x) in enumerate(raw, 1)]
    return level.groupBy("l").agg(*counts).select("l", *d)


def gram_hashes(lang, grams: np.ndarray) -> np.ndarray:
    return mix(grams ^ mix(np.array([lang], np.int64).view(np.uint64))).view(np.int64)


def _hashed(batches):
    """(l, gram, n, log_p) to (h, n, cost)."""
    for batch in batches:
        langs, grams = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
        h = np.empty(len(grams), np.int64)
        for lang in np.unique(langs):
            h[langs == lang] = gram_hashes(lang, grams[langs == lang])
        cost = np.rint(-UNIT * batch.column(3).to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(2), pa.array(cost)], names=["h", "n", "cost"])


class Model:
    """Sorted hash arrays in the shared folder: `resident`, and `ranges` of the others by the upper `bits` of the hash."""

    _loaded: dict = {}  # noqa: RUF012  the last arrays that this worker has read

    def __init__(self, path: str, order: int, bits: int, rest: bool):
        self.path, self.order, self.bits, self.rest = path, order, bits, rest

    def arrays(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and costs of `resident` or of a range."""
        key, large = f"{self.path}/{name}", name == "resident"
        if self._loaded.get(large, ("",))[0] != key:
            store, path = open_store(key)
            table = pq.read_table(path, columns=["h", "cost"], filesystem=store, partitioning=None)
            h, cost = (table.column(c).to_numpy() for c in ("h", "cost"))
            by = np.argsort(h)
            self._loaded[large] = key, (h[by], cost[by])
        return self._loaded[large][1]

    @staticmethod
    def find(arrays: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs, and which are there."""
        known, cost = arrays
        if not len(known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        return np.where(hit, cost[at], 0), hit


def train_model(work: Workspace, docs: DataFrame, order: int = ORDER, resident: int = RESIDENT) -> Model:
    """docs: text, l. No n-gram comes to the driver."""
    counted = docs.mapInArrow(batchwise(_count(order)), "l long, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    counts = work.write(counted, "counts")
    entries = work.write(kneser_ney(counts, order).mapInArrow(batchwise(_hashed), "h long, n long, cost long"), "entries")
    work.drop("counts")
    by_size = {r.b: r["count"] for r in entries.groupBy(F.floor(F.log2("n")).alias("b")).count().collect()}  # 64 rows at most
    total, least = sum(by_size.values()), 0
    while sum(c for b, c in by_size.items() if b >= least) > resident:
        least += 1
    n = partitions(work.spark)
    often = F.col("n") >= (1 << least)
    work.write(entries.where(often).select("h", "cost").repartitionByRange(8, "h").sortWithinPartitions("h"), "resident")
    bits, rest = max(n, total // RANGE).bit_length(), any(b < least for b in by_size)
    if rest:
        ranged = entries.where(~often).select("h", "cost", F.shiftrightunsigned("h", 64 - bits).alias("slot"))
        ranged.repartition(n, "slot").sortWithinPartitions("slot", "h").write.partitionBy("slot").parquet(f"{work.path}/ranges")
    work.drop("entries")
    return Model(work.path, order, bits, rest)


# ---------------------------------------------------------------- one text's measures
def text_measures(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document of a slice."""
    n = len(offs) - 1
    starts, ends, doc = word_bounds(buf, offs)
    words = np.bincount(doc, minlength=n)
    per_doc = lambda flags: sums_by(flags.astype(np.int64), np.diff(offs))
    chars = per_doc(((buf & 0xC0) != 0x80) & ~SPACE[buf])
    # lines
    cut = buf == 10
    line_starts = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], np.flatnonzero(cut) + 1]))
    line_starts = line_starts[line_starts < len(buf)]
    line_ends = np.concatenate([line_starts[1:], [len(buf)]])[: len(line_starts)]
    line_doc = np.searchsorted(offs, line_starts, "right") - 1
    solid = np.concatenate([[0], np.cumsum(~SPACE[buf])])
    full = solid[line_ends] > solid[line_starts]
    line_starts, line_ends, line_doc = line_starts[full], line_ends[full], line_doc[full]
    line_ends = line_ends - cut[line_ends - 1]  # without the line's own end
    h = span_hashes(buf, line_starts, line_ends)
    by = np.lexsort((h, line_doc))
    again = (h[by][1:] == h[by][:-1]) & (line_doc[by][1:] == line_doc[by][:-1])
    dup_lines = np.bincount(line_doc[by][1:][again], minlength=n)
    # windows of three words found twice or more
    w = window_hashes(span_hashes(buf, starts, ends), 3)
    inside = doc[: len(w)] == doc[2:] if len(w) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    by = at[np.lexsort((w[at], doc[at]))]
    same = (w[by][1:] == w[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    repeated = np.zeros(len(doc) + 2, bool)
    for part in (by[1:][same], by[:-1][same]):
        for k in range(3):
            repeated[part + k] = True
    repeat_words = np.bincount(doc, repeated[: len(doc)], n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    letters = np.concatenate([[0], np.cumsum(LETTERS[buf])])
    real = np.bincount(doc[letters[ends] > letters[starts]], minlength=n)
    return {"real_words": real, "n_words": words, "word_chars": chars, "n_symbols": per_doc(SYMBOLS[buf]), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words}


def _score(model: Model, payload: int):
    """Append to the payload columns the measures, the cost of the n-grams that the worker holds, and the others; text and language are last."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            langs = batch.column(payload + 1).to_numpy()
            known = model.arrays("resident")
            for first, last, buf, offs in text_slices(batch.column(payload)):
                out, n = text_measures(buf, offs), last - first
                sizes, cost, doc, rest = np.diff(offs), np.zeros(len(buf), np.int64), [], []
                keys, of = gram_keys(buf, offs, model.order), np.repeat(np.arange(n), np.diff(offs))
                for lang, grams, _, at, mine in _distinct(keys, sizes, langs[first:last]):
                    h = gram_hashes(lang, grams)
                    value, hit = model.find(known, h)  # each is looked up once a slice
                    cost[mine] = value[at]
                    lacking = ~hit[at]
                    doc.append(of[mine[lacking]])
                    rest.append(h[at[lacking]])
                doc, rest = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, rest))
                by = np.lexsort((rest, doc))
                doc, rest = doc[by], rest[by]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1]))) if len(doc) else doc
                times = np.diff(np.append(new, len(doc))).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))]).astype(np.int32)
                failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
                made = [pa.array(out[k], pa.int64()) for k in counts]
                made += [pa.array(failed), pa.array(out["real_words"], pa.int64()), pa.array(sums_by(cost, sizes)), pa.array(part + row + np.arange(n))]
                made += [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (rest[new], times)]
                row += n
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[first:last] for c in range(payload)), *made], names=[*batch.schema.names[:payload], *(x.split()[0] for x in METRICS.split(", "))])

    return run


def _search(model: Model):
    """(row, cost) of n-grams that come range by range: slot, h, row, times."""

    def run(batches):
        for batch in batches:
            slots, h, row, times = (batch.column(k).to_numpy() for k in range(4))
            cost = np.zeros(len(h), np.int64)
            for slot in np.unique(slots):
                own = slots == slot
                cost[own] = model.find(model.arrays(f"ranges/slot={slot}"), h[own])[0]
            rows, at = np.unique(row, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(at, cost * times, len(rows)).astype(np.int64))], names=["_row", "_more"])

    return run


def _bands(scored: DataFrame) -> DataFrame:
    """(_band, _low, _high) of each language, from the histogram of its scores."""
    bins = scored.where("not _base_failed").groupBy(F.col("_l").alias("_band"), F.floor(F.col("_log_ppl") * BINS).alias("bin")).agg(F.count("*").alias("c"))
    own = Window.partitionBy("_band")
    seen = bins.withColumns({"total": F.sum("c").over(own), "seen": F.sum("c").over(own.orderBy("bin"))})
    mark = lambda quarter: (F.min(F.when(4 * F.col("seen") >= quarter * F.col("total"), F.col("bin"))) + 0.5) / BINS
    marks = seen.groupBy("_band").agg(mark(1).alias("q1"), mark(3).alias("q3"))
    wide = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_RANGE))
    return marks.select("_band", (F.col("q1") - wide).alias("_low"), (F.col("q3") + wide).alias("_high"))


def quality_scores(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", order: int = ORDER, resident: int = RESIDENT) -> DataFrame:
    """The columns of `keep`, then _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _base_failed, _log_ppl, _low, _high, _kept."""
    work = Workspace(docs.sparkSession, "quality")
    lang, text = F.xxhash64(F.col(lang_col).cast("string")), F.coalesce(F.col(text_col), F.lit(""))
    model = train_model(work, docs.select(text.alias("text"), lang.alias("l")), order, resident)
    rows = docs.select(*keep, lang.alias("_l"), text.alias("_text"), lang.alias("_lang"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    scored = work.write(rows.mapInArrow(batchwise(_score(model, len(keep) + 1)), f"{fields}, {METRICS}"), "scored")
    cost = F.col("_cost")
    if model.rest:
        lacking = scored.select("_row", F.explode(F.arrays_zip("_rest", "_times")).alias("x")).select(F.shiftrightunsigned("x._rest", 64 - model.bits).alias("slot"), F.col("x._rest").alias("h"), "_row", F.col("x._times").alias("times"))
        lacking = lacking.repartition(partitions(work.spark), "slot").sortWithinPartitions("slot")
        more = lacking.mapInArrow(batchwise(_search(model)), "_row long, _more long").groupBy("_row").agg(F.sum("_more").alias("_more"))
        scored, cost = scored.join(more, "_row", "left"), cost + F.coalesce("_more", F.lit(0))
    scored = scored.withColumn("_log_ppl", F.when(F.col("_n_words") > 0, cost / UNIT / F.greatest("_real", F.lit(1))))
    limits = work.write(_bands(scored), "bands")
    fits = F.col("_log_ppl").between(F.col("_low"), F.col("_high"))
    both = scored.join(few(limits, limits.count()), F.col("_l") == F.col("_band"), "left")
    return both.select(*keep, *(f"_{c}" for c in BASE), "_log_ppl", "_low", "_high", (~F.col("_base_failed") & F.coalesce(fits, F.lit(False))).alias("_kept"))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """doc_id, the measures, the verdict, and the perplexity a word with its band."""
    s = quality_scores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), ["doc_id"], **how)
    return s.select("doc_id", *(F.col(f"_{c}").alias(c) for c in BASE), F.col("_kept").alias("kept"), F.exp("_log_ppl").alias("perplexity"), F.exp("_low").alias("lower"), F.exp("_high").alias("upper"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns; nulls, repeats and empty tables as above. The texts are written once, beside their scores, and not shuffled."""
    own = numbered(docs)
    return named(quality_scores(own, own.columns, place(docs, text_col), place(docs, lang_col)).where("_kept"), docs)

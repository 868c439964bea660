"""Pairs of similar listings for review, inside blocks of one category and brand."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.text import grab

THRESHOLD = 88
#: What two listings' pair is judged by besides their texts; null contradicts nothing.
SINGLE = ("mpn", "c_ddr", "c_total_gb", "c_speed_mhz", "c_wattage", "c_pack_size")
#: Classes of a block that are expected in one part; two parts are compared by one task.
PART = 1024
#: Class pairs whose letters are compared at once.
LETTERS = 1 << 16


def critical(text: Column) -> dict[str, Column]:
    """What must not differ between listings of one product."""
    low = F.lower(text)
    tight = F.regexp_replace(low, r"\s+", "")
    pack = F.coalesce(grab(low, r"\b(\d+)\s*(?:pack|pcs|pieces)\b"), grab(low, r"\bpack of\s*(\d+)\b"))
    return {
        "ddr": grab(tight, "ddr([3-5])"), "total_gb": grab(tight, r"(\d+)gb"), "speed_mhz": grab(tight, r"(\d{3,4})mhz"),
        "wattage": grab(low, r"(\d{3,4})w\b"), "pack_size": pack, "revs": F.regexp_extract_all(low, F.lit(r"\b[vr]\d+\b"), F.lit(0)),
    }


def with_critical(listings: DataFrame) -> DataFrame:
    """Computed once a listing, not once a pair."""
    return listings.withColumns({f"c_{k}": v for k, v in critical(F.col("match_text")).items()})


def pair_allowed(a: str = "a", b: str = "b") -> Column:
    """No contradiction in part number or critical attributes. Unknown contradicts nothing."""
    same = [F.coalesce(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), F.lit(True)) for c in ("mpn", "c_ddr", "c_total_gb", "c_speed_mhz", "c_wattage", "c_pack_size")]
    revs = (F.size(f"{a}.c_revs") == 0) | (F.size(f"{b}.c_revs") == 0) | F.arrays_overlap(f"{a}.c_revs", f"{b}.c_revs")
    out = revs
    for s in same:
        out = out & s
    return out


def candidate_pairs(listings: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of one category and brand, of different products, not both in products of several listings, without contradiction.

    An equi-join with the rest as its residual condition, so AQE splits a popular brand's block.
    """
    several = listings.groupBy("product_id").agg((F.count("*") > 1).alias("multi"))
    rows = with_critical(listings).where("category not in ('other', '') and brand is not null and match_text <> ''").join(several, "product_id")
    rows = rows.select("category", "brand", "vendor", "listing_key", "product_id", "title_raw", "match_text", "mpn", "multi", *[f"c_{k}" for k in ("ddr", "total_gb", "speed_mhz", "wattage", "pack_size", "revs")])
    a, b = rows.alias("a"), rows.alias("b")
    order = F.struct("a.vendor", "a.listing_key") < F.struct("b.vendor", "b.listing_key")
    on = (F.col("a.category") == F.col("b.category")) & (F.col("a.brand") == F.col("b.brand")) & order & (F.col("a.product_id") != F.col("b.product_id")) & ~(F.col("a.multi") & F.col("b.multi")) & pair_allowed()
    pairs = a.join(b, on).select("a.category", "a.brand", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("listing_key", "title_raw", "match_text")))
    pairs = pairs.withColumnsRenamed({"title_raw_a": "title_a", "title_raw_b": "title_b"})
    if blocked is not None:
        low, high = F.least("key_1", "key_2").alias("low"), F.greatest("key_1", "key_2").alias("high")
        bars = blocked.select(low, high)
        pairs = pairs.join(bars, (F.least("listing_key_a", "listing_key_b") == bars.low) & (F.greatest("listing_key_a", "listing_key_b") == bars.high), "left_anti")
    return pairs


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: how alike two texts are as sets of words: the best of the three comparisons among what is common and what each adds."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 100.0
    gap = 1 if common else 0
    sx, sy = len(common) + gap + len(left), len(common) + gap + len(right)
    distance = len(left) + len(right) - 2 * _lcs(left, right)
    best = 100 * (1 - distance / (sx + sy))
    if common:
        best = max(best, 100 * (1 - (gap + len(left)) / (len(common) + sx)), 100 * (1 - (gap + len(right)) / (len(common) + sy)))
    return best


def score_bound(a: str, b: str) -> Column:
    """Never below the score: lengths alone bound the edit distance from below. Stays in the JVM."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    size = lambda w: F.aggregate(w, F.lit(0), lambda s, t: s + F.length(t) + 1)  # noqa: E731  with a space each
    common, left, right = F.array_intersect(words(a), words(b)), F.array_except(words(a), words(b)), F.array_except(words(b), words(a))
    joined = lambda w: F.greatest(size(w) - 1, F.lit(0))
    s, x, y = joined(common), joined(left), joined(right)
    g = (s > 0).cast("int")
    sx, sy = s + g + x, s + g + y
    edit = 100 * (1 - F.abs(x - y) / F.greatest(sx + sy, F.lit(1)))
    with_common = F.greatest(100 * (1 - (g + x) / F.greatest(s + sx, F.lit(1))), 100 * (1 - (g + y) / F.greatest(s + sy, F.lit(1))))
    return F.when((s > 0) & ((x == 0) | (y == 0)), 100.0).when(s > 0, F.greatest(edit, with_common)).otherwise(edit)


def score_pairs(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs that reach the threshold, with the whole part of their score. Only pairs that the bound lets through go to Python."""
    from ..runtime import ship_package

    ship_package(pairs.sparkSession)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    able = pairs.where(score_bound("match_text_a", "match_text_b") >= threshold)
    return able.withColumn("ratio", score("match_text_a", "match_text_b")).where(F.col("ratio") >= threshold).withColumn("score", F.floor("ratio").cast("int")).drop("ratio")


# ------------------------------------------------------------------ pairs counted, not listed
def _within(distance, total, threshold: int):
    """Whether 100 * (1 - distance / total) reaches the threshold, in whole numbers."""
    return 100 * distance <= (100 - threshold) * total


def _allowed(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Which classes of a (rows) may pair with which of b (columns)."""
    out = ~(a["multi"].to_numpy()[:, None] & b["multi"].to_numpy()[None, :])
    for c in SINGLE:
        codes = pd.factorize(pd.concat([a[c], b[c]]))[0]  # a null is -1
        x, y = codes[: len(a), None], codes[None, len(a) :]
        out &= (x == y) | (x < 0) | (y < 0)
    revs = _marks([list(r) for r in a["c_revs"]], [list(r) for r in b["c_revs"]])[0]
    x, y = revs[: len(a)], revs[len(a) :]
    return out & ((x @ y.T > 0) | ~(a["c_revs"].map(len).to_numpy() > 0)[:, None] | ~(b["c_revs"].map(len).to_numpy() > 0)[None, :])


def _marks(a: list[list[str]], b: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """A row for each word list of a, then of b, with a 1 for each of its words, and the words. Only words of both sides count."""
    both = {w for x in a for w in x} & {w for x in b for w in x}
    number = {w: k for k, w in enumerate(sorted(both))}
    out = np.zeros((len(a) + len(b), len(number)), np.float32)
    for k, words in enumerate(a + b):
        out[k, [number[w] for w in words if w in number]] = 1
    return out, list(number)


def _similar(left: list[str], right: list[str], open_pairs: np.ndarray, threshold: int) -> np.ndarray:
    """Of the open pairs, those whose token_set_ratio reaches the threshold.

    Word lengths decide most; of the rest, letters bound the edit distance from below, and only what that leaves is compared.
    """
    a, b = ([sorted(set(t.split())) for t in side] for side in (left, right))
    marks, words = _marks(a, b)
    x, y = marks[: len(a)], marks[len(a) :]
    common = ((x * np.array([len(w) + 1 for w in words], np.float32)) @ y.T).astype(np.int32)  # with a space each
    total = [np.array([sum(len(w) + 1 for w in t) for t in side], np.int32) for side in (a, b)]
    p, q = total[0][:, None] - common, total[1][None, :] - common
    some = common > 0
    s, gap = np.maximum(common - 1, 0), some.astype(np.int32)
    n, m = np.maximum(p - 1, 0), np.maximum(q - 1, 0)  # letters and spaces of what each side adds
    filled = open_pairs & (total[0] > 0)[:, None] & (total[1] > 0)[None, :]
    sure = some & ((p == 0) | (q == 0) | _within(gap + np.minimum(n, m), 2 * s + gap + np.minimum(n, m), threshold))
    whole = 2 * (s + gap) + n + m
    unsure = filled & ~sure & _within(np.abs(n - m), whole, threshold)
    out = filled & sure
    i, j = np.nonzero(unsure)
    if not len(i):
        return out
    texts = [" ".join(t) for t in a + b]
    letters = {c: k for k, c in enumerate(sorted(set("".join(texts))))}
    held = np.zeros((len(texts), len(letters)), np.int32)
    for k, t in enumerate(texts):
        np.add.at(held[k], [letters[c] for c in t], 1)
    most, known = whole[i, j], {}
    kept = [np.flatnonzero(_within(np.abs(held[i[k : k + LETTERS]] - held[len(a) + j[k : k + LETTERS]]).sum(1), most[k : k + LETTERS], threshold)) + k for k in range(0, len(i), LETTERS)]
    for k in np.concatenate(kept).tolist():
        u, v = a[i[k]], b[j[k]]
        shared = set(u) & set(v)
        pair = " ".join(w for w in u if w not in shared), " ".join(w for w in v if w not in shared)
        if pair not in known:
            known[pair] = len(pair[0]) + len(pair[1]) - 2 * _lcs(*pair)
        out[i[k], j[k]] = _within(known[pair], int(most[k]), threshold)
    return out


def _components(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component in a symmetric matrix."""
    out = np.arange(len(linked))
    meets = linked.any(1)
    out[meets] = -1
    for k in np.flatnonzero(meets).tolist():
        if out[k] < 0:
            new = np.zeros(len(linked), bool)
            new[k] = True
            while new.any():
                out[new] = k
                new = linked[new].any(0) & (out < 0)
    return out


def _compare(threshold: int | None):
    """A task's two parts of one block (or one with itself): each class's links there and its component's first class."""
    schema = pa.schema([("category", pa.string()), ("brand", pa.string()), ("class_id", pa.string()), ("links", pa.int64()), ("root", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().sort_values("class_id", kind="stable")
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        sides = [rows[rows["part"] == low], rows[rows["part"] == high]]
        linked = _allowed(*sides)
        if low == high:
            np.fill_diagonal(linked, False)
        if threshold is not None and linked.any():
            linked = _similar(*(side["match_text"].tolist() for side in sides), linked, threshold)
        size = [side["members"].to_numpy(np.int64) for side in sides]
        links = [linked @ size[1]]
        if low == high:
            square, both = linked, sides[0]
        else:
            links.append(linked.T @ size[0])
            n, both = len(sides[0]), pd.concat(sides)
            square = np.zeros((len(both), len(both)), bool)
            square[:n, n:], square[n:, :n] = linked, linked.T
        ids = both["class_id"].to_numpy(object)
        roots = ids if threshold is None else ids[_components(square)]
        return pa.table([both["category"].tolist(), both["brand"].tolist(), ids.tolist(), np.concatenate(links), roots.tolist()], schema=schema)

    return run


def _roots(table: pa.Table) -> pa.Table:
    """A block's classes with the smallest class that links reach, from (class, others of its component)."""
    above: dict[str, str] = {}

    def find(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for x, roots in zip(table["class_id"].to_pylist(), table["roots"].to_pylist(), strict=True):
        for y in roots:
            low, high = sorted((find(x), find(y)))
            above[high] = low
    return pa.table({"class_id": table["class_id"], "others": table["others"], "component_id": [find(x) for x in table["class_id"].to_pylist()]})


def link_counts(listings: DataFrame, threshold: int | None = None, part: int = PART) -> DataFrame:
    """Each listing that can have pairs: listing_key, category, brand, class_id, links and, with a threshold, component_id.

    links: its pairs as candidate_pairs has them, with a threshold only those whose token_set_ratio reaches it; none is listed.
    class_id: smallest listing_key of those that agree in all that pairs are judged by, so that they have the same links
    to others. component_id: smallest listing_key that links reach, its own included. A listing_key stands in one row.

    Classes are dealt over parts of their block by a hash, and every two parts are compared by a task of their own, so no block
    and no class of copies lands in one task. Two listings of one product are both in a product of several, which bars the pair.
    """
    from ..runtime import ship_package

    ship_package(listings.sparkSession)
    able = listings.where("product_id is not null").select("product_id", "listing_key", "category", "brand", "match_text", "mpn")
    several = able.withColumn("multi", F.count("*").over(Window.partitionBy("product_id")) > 1)  # one shuffle that all that follows reads
    rows = with_critical(several.where("category not in ('other', '') and brand is not null and match_text <> ''")).withColumn("c_revs", F.array_sort(F.array_distinct("c_revs")))
    alike = ["category", "brand", "multi", *SINGLE, "c_revs"] + ["match_text"] * (threshold is not None)
    rows = rows.select("listing_key", *alike)
    classes = rows.groupBy(*alike).agg(F.min("listing_key").alias("class_id"), F.count("*").alias("members"))

    block = ["category", "brand"]
    every = F.when(F.col("members") > 0, F.col("class_id"))  # all columns that the join below reads, so that the classes' shuffle serves both
    parts = classes.groupBy(*block).agg(F.ceil(F.count(every) / part).cast("int").alias("parts"))
    dealt = classes.join(parts, block).withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = dealt.select("*", other).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("parts", "other")
    compared = pairs.groupBy(*block, "low", "high").applyInArrow(_compare(threshold), "category string, brand string, class_id string, links long, root string")
    # two parts name each class of theirs, also those without links
    found = compared.groupBy(*block, "class_id").agg(F.sum("links").alias("others"), F.collect_set("root").alias("roots"))
    if threshold is None:
        known = found.select("class_id", "others")
    else:
        known = found.groupBy(*block).applyInArrow(_roots, "class_id string, others long, component_id string")

    on = F.lit(True)
    for c in alike:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    members = rows.alias("r").join(classes.alias("c"), on).select("listing_key", "class_id", "members", *(F.col(f"r.{c}").alias(c) for c in alike))
    copies = F.col("members") - 1  # they link with each other
    own = F.when(F.col("multi") if threshold is None else F.col("multi") | (F.trim("match_text") == ""), 0).otherwise(copies)
    out = members.join(known, "class_id").withColumn("links", F.col("others") + own)
    alone = [F.when(F.col("links") == 0, F.col("listing_key")).otherwise(F.col("component_id")).alias("component_id")] if threshold is not None else []
    return out.select("listing_key", *block, "class_id", "links", *alone)

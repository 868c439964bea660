"""Licence scan with DataFrame functions alone: sparse TF-IDF cosines to templates, then inheritance by path.

A file's header lines are compared with the templates' notices as TF-IDF vectors. Document frequencies are counted
over all files for the templates' vocabulary; a word outside it takes the largest idf, so it only lengthens a
line's vector. Any line may be a notice, so all lines of the whole text are looked at. A cosine is at most the
length of that part of the template's vector whose words occur: texts and lines in which too little of every
template occurs need no vector, and what is shuffled is a few words of likely notices.

Files are also compared with the standard headers and full texts of `license_texts`: windows of a text's length over
the file's words, across line ends, and the file as a whole. A cosine needs some least number of the text's words;
files with fewer need no vector. Notices wrapped over lines or inside a paragraph, and SPDX identifiers, are found as
the same words in the same order; a notice that is a line of its own counts as that line.

A file most of whose words stand in notices, that as a whole is a header or full text, or that begins with the title
of a long licence, is a licence file and holds for its directory and what lies below,
down to the next licence file. Directories, not files, are joined with their ancestors; the files then join
their directory, an equi-join that AQE splits if one directory holds a third of them.

Defined results: a null text has no lines; a null path lies in the root directory; equal cosines go to the
template, then the line, that comes first; of several licence files in one directory the best, then the first
by path, then by id, holds; repeated rows are scanned each; an empty table gives no rows; columns besides those named
are not read, whatever they are called; a very long text is split into its lines by the task that reads it.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import HEADERS, SPDX, TITLES
from .shared import Workspace

#: Notices by which works commonly state their licence.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the 2-Clause BSD License.",
    "BSD-3-Clause": "Licensed under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, Version 2.0.",
}
#: Least cosine of a notice; least share of a licence file's words that stand in notices.
COSINE, FILE_SHARE = 0.75, 0.25
SPLIT = "[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda x: x != "")


def template_weights(templates: dict[str, str], idf: dict[str, float]) -> dict[str, dict[str, float]]:
    """Unit vectors."""
    out = {}
    for name, text in templates.items():
        raw = {w: c * idf[w] for w, c in Counter(_words(text)).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out[name] = {w: v / norm for w, v in raw.items()}
    return out


def may_reach(weights: dict[str, dict[str, float]], cosine: float, occurs) -> Column:
    """Whether enough of some template's vector occurs for the cosine. occurs: a word's column."""
    parts = []
    for vector in weights.values():
        part = F.lit(0.0)
        for word, v in vector.items():
            part = part + F.when(occurs(word), v * v).otherwise(0.0)
        parts.append(part)
    return F.greatest(*parts, F.lit(0.0)) >= cosine * cosine - 1e-9


def enough_words(vector: dict[str, float], common: set[str], cosine: float, found: Column) -> Column:
    """Whether enough of a unit vector occurs for the cosine. First, how many words must occur besides the common ones."""
    need, total, least = cosine * cosine - 1e-9, sum(v * v for w, v in vector.items() if w in common), 0
    for v in sorted((v for w, v in vector.items() if w not in common), reverse=True):
        if total >= need:
            break
        total, least = total + v * v, least + 1
    rare = F.array(*map(F.lit, sorted(vector.keys() - common)))
    parts = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(v * v).alias("v")) for w, v in sorted(vector.items())))
    occurring = F.filter(parts, lambda x: F.array_contains(found, x["w"]))
    return (F.size(F.array_intersect(rare, found)) >= least) & (F.aggregate(occurring, F.lit(0.0), lambda a, x: a + x["v"]) >= need)


def scan_licenses(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, templates: dict[str, str] = TEMPLATES, cosine: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """doc_id, path, own_license, own_cosine, is_license_file, license, origin (header, inherited or none), from_path."""
    spark, work = files.sparkSession, Workspace(files.sparkSession, "license")
    at = F.coalesce(path if path is not None else F.col("path"), F.lit(""))
    rows = files.select(F.col(id_col).alias("doc_id"), at.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocabulary = sorted({w for t in templates.values() for w in _words(t)})

    texts = [(name, text, _words(text)) for name, each in HEADERS.items() for text in each]
    wide = sorted({*vocabulary, "spdx", *(w for _, _, own in texts for w in own), *(w for t in TITLES.values() for w in _words(t))})
    there = F.array_intersect(F.array(*map(F.lit, wide)), F.split(F.lower("text"), SPLIT))
    seen = rows.select(F.explode(there).alias("term"))
    df = {r.term: r["count"] for r in seen.groupBy("term").count().collect()}  # a row a template word
    n = rows.count()
    idf_all = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in wide}
    idf = {w: idf_all[w] for w in vocabulary}
    outside = math.log(1 + n) + 1
    weights = template_weights(templates, idf)
    text_weights = [template_weights({name: text}, idf_all)[name] for name, text, _ in texts]

    # Lines that may be notices.
    reaches = lambda found: may_reach(weights, cosine, lambda w: F.array_contains(found, w))
    common = {w for w in wide if df.get(w, 0) > n / 10}
    enough = lambda found: [enough_words(v, common, cosine, found) for v in text_weights]
    titled = lambda found: [F.size(F.array_intersect(F.array(*map(F.lit, sorted(set(_words(t))))), found)) == len(set(_words(t))) for t in TITLES.values()]
    any_of = lambda found: reduce(lambda a, b: a | b, [reaches(found), F.array_contains(found, "spdx"), *titled(found), *enough(found)])
    likely = rows.where(F.get(F.transform(F.array(there), any_of), F.lit(0)))  # the text is split once, not once a word
    likely = likely.withColumns({"row": F.monotonically_increasing_id(), "words": F.size(terms(F.col("text"))), "found": there})
    likely = work.write(likely, "likely")
    each = F.transform(F.split("text", "\n"), lambda body, k: F.struct(k.alias("line"), terms(body).alias("terms")))
    lines = likely.select("row", "doc_id", "path", "words", F.explode(F.filter(each, lambda x: reaches(x["terms"]))).alias("x"))
    lines = lines.select("row", "doc_id", "path", "words", "x.line", "x.terms")
    lines = lines.withColumn("here", F.size("terms"))
    words = lines.select("row", "line", "doc_id", "path", "words", "here", F.explode("terms").alias("term"))
    kept = [F.first(c).alias(c) for c in ("doc_id", "path", "words", "here")]
    counted = words.groupBy("row", "line", "term").agg(F.count("*").alias("c"), *kept)
    names = list(weights)
    table = [(w, idf[w], *(weights[k].get(w, 0.0) for k in names)) for w in vocabulary]
    table = spark.createDataFrame(table, "term string, idf double, " + ", ".join(f"w{k} double" for k in range(len(names))))
    value = F.col("c") * F.coalesce("idf", F.lit(outside))
    vectors = counted.join(F.broadcast(table), "term", "left").withColumn("v", value)  # a row a template word
    sums = vectors.groupBy("row", "line").agg(*kept, F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), *(F.sum(F.col("v") * F.coalesce(f"w{k}", F.lit(0.0))).alias(f"dot{k}") for k in range(len(names))))
    scores = F.array(*(F.struct((-F.round(F.col(f"dot{k}") / F.col("norm"), 6)).alias("worse"), F.lit(name).alias("license")) for k, name in enumerate(names)))
    notices = sums.select("row", "line", "doc_id", "path", "words", "here", F.array_min(scores).alias("best")).where(F.col("best.worse") <= -cosine)
    by_line = notices.groupBy("row").agg(F.min("best").alias("best"), (F.sum("here") >= file_share * F.first("words")).alias("is_file"))

    # The notices' words in a row anywhere, SPDX identifiers, and titles that a file begins with.
    plain = F.concat(F.lit(" "), F.array_join(terms(F.col("text")), " "), F.lit(" "))
    phrases = [(name, " ".join(_words(t)), False) for name, t in templates.items()]
    phrases += [(name, " ".join(_words("SPDX-License-Identifier " + x)), False) for name, each in SPDX.items() for x in each]
    phrases += [(name, " ".join(_words(t)), True) for name, t in TITLES.items()]
    hits = [F.when(F.col("plain").startswith(f" {x} ") if title else F.col("plain").contains(f" {x} "), F.struct(F.lit(-1.0).alias("worse"), F.lit(name).alias("license"), F.lit(len(x.split())).alias("here"), F.lit(title).alias("title"))) for name, x, title in phrases]
    said = likely.select("row", "words", plain.alias("plain")).select("row", "words", F.explode(F.array_compact(F.array(*hits))).alias("x"))
    by_phrase = said.groupBy("row").agg(F.min(F.struct("x.worse", "x.license")).alias("best"), (F.max("x.title") | (F.sum("x.here") >= file_share * F.first("words"))).alias("is_file"))

    # Windows of each text's length, an eighth of it apart, and the whole file.
    sizes = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(len(own)).alias("m")) for k, (_, _, own) in enumerate(texts)))
    may = F.array(*enough(F.col("found")))
    pairs = likely.select("row", "words", terms(F.col("text")).alias("terms"), F.explode(F.filter(sizes, lambda x: F.get(may, x["k"]))).alias("x")).select("row", "words", "terms", "x.k", "x.m")
    last = F.greatest(F.col("words") - F.col("m"), F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.greatest(F.floor(F.col("m") / 8), F.lit(1)).cast("int")), F.array(last)))
    spans = F.concat(F.transform(starts, lambda x: F.struct(x.alias("start"), F.col("m").alias("size"))), F.array(F.struct(F.lit(-1).alias("start"), F.col("words").alias("size"))))
    spans = pairs.select("row", "k", "terms", F.explode(spans).alias("x"))
    spans = spans.select("row", "k", "x.start", F.explode(F.slice("terms", F.greatest(F.col("x.start"), F.lit(0)) + 1, F.col("x.size"))).alias("term"))
    table = [(w, idf_all[w], [float(v.get(w, 0.0)) for v in text_weights]) for w in wide]
    table = spark.createDataFrame(table, "term string, idf double, ws array<double>")
    vectors = spans.groupBy("row", "k", "start", "term").agg(F.count("*").alias("c")).join(F.broadcast(table), "term", "left").withColumn("v", value)
    sums = vectors.groupBy("row", "k", "start").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.sum(F.col("v") * F.coalesce(F.get("ws", F.col("k")), F.lit(0.0))).alias("dot"))
    names = F.array(*(F.lit(name) for name, _, _ in texts))
    near = sums.select("row", "start", F.struct((-F.round(F.col("dot") / F.col("norm"), 6)).alias("worse"), F.get(names, F.col("k")).alias("license")).alias("best")).where(F.col("best.worse") <= -cosine)
    by_text = near.groupBy("row").agg(F.min("best").alias("best"), F.max(F.col("start") < 0).alias("is_file"))

    one = lambda df, k: df.select("row", F.lit(k).alias("kind"), "best", "is_file")
    every = one(by_line, 0).union(one(by_phrase, 1)).union(one(by_text, 2)).groupBy("row").agg(
        F.min(F.when(F.col("kind") == 0, F.col("best"))).alias("line"), F.min(F.when(F.col("kind") == 1, F.col("best"))).alias("phrase"),
        F.min(F.when(F.col("kind") == 2, F.col("best"))).alias("text"), F.max("is_file").alias("is_file"),
    )
    found = every.join(likely.select("row", "doc_id", "path"), "row").withColumn("best", F.least(F.coalesce("line", "phrase"), F.col("text")))
    found = work.write(found.select("doc_id", "path", F.col("best.license").alias("own_license"), (-F.col("best.worse")).alias("own_cosine"), "is_file"), "found")

    # Directories of files, and the nearest ancestor (itself included) with a licence file.
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    holds = found.where("is_file").groupBy(directory.alias("up")).agg(F.min(F.struct((-F.col("own_cosine")).alias("worse"), "path", "doc_id", "own_license")).alias("best"))
    holds = holds.select("up", F.col("best.own_license").alias("license"), F.col("best.path").alias("from_path"))
    folders = rows.select(directory.alias("folder")).distinct()
    parts = F.split("folder", "/")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(parts))
    ups = folders.select("folder", F.explode(F.sequence(F.lit(0), depth)).alias("depth"), parts.alias("parts"))
    ups = ups.select("folder", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice("parts", 1, F.greatest("depth", F.lit(1))), "/")).alias("up"))
    near = ups.join(holds, "up").groupBy("folder").agg(F.max(F.struct("depth", "license", "from_path")).alias("near"))
    near = work.write(near.select("folder", F.col("near.license").alias("inherited"), F.col("near.from_path").alias("from_path")), "near")

    own = found.groupBy(F.col("doc_id").alias("d2"), F.col("path").alias("p2")).agg(F.min(F.struct((-F.col("own_cosine")).alias("worse"), "own_license")).alias("best"), F.max("is_file").alias("is_file"))
    full = rows.select("doc_id", "path", directory.alias("folder")).join(near, "folder", "left")
    full = full.join(own, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("path") == F.col("p2")), "left")
    mine = F.col("best.own_license")
    return full.select(
        "doc_id", "path", mine.alias("own_license"), (-F.col("best.worse")).alias("own_cosine"),
        F.coalesce("is_file", F.lit(False)).alias("is_license_file"), F.coalesce(mine, "inherited").alias("license"),
        F.when(mine.isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(mine.isNull(), F.col("from_path")).alias("from_path"),
    )


def document_path() -> Column:
    """Where documents lie, as files: source/lang/thousand/ten/doc_id."""
    d = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(d / 1000).cast("string"), F.floor(d / 10).cast("string"), d.cast("string"))


def oracle_sql() -> str:
    """DuckDB SQL for the scan of documents, without any short cut."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEMPLATES.items())
    words = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
    WITH files AS (
        SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 10 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path
        FROM documents
    ), t AS (SELECT * FROM (VALUES {listed}) v(license, notice)),
    tw AS (SELECT license, w, count(*) AS c FROM (SELECT license, unnest({words('notice')}) AS w FROM t) GROUP BY ALL),
    dw AS (SELECT doc_id, unnest(list_distinct({words('text')})) AS w FROM files),
    n AS (SELECT count(*) AS n FROM files),
    idf AS (SELECT w, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS v
            FROM (SELECT DISTINCT w FROM tw) LEFT JOIN (SELECT w, count(*) AS df FROM dw WHERE w IN (SELECT w FROM tw) GROUP BY w) USING (w), n),
    tv AS (SELECT license, w, c * v / sqrt(sum(c * v * c * v) OVER (PARTITION BY license)) AS x FROM tw JOIN idf USING (w)),
    ln AS (SELECT doc_id, path, len({words('text')}) AS words, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM files),
    lw AS (SELECT doc_id, path, words, line, w, count(*) AS c FROM (SELECT doc_id, path, words, line, unnest({words('body')}) AS w FROM ln) GROUP BY ALL),
    lv AS (SELECT lw.*, c * coalesce(v, ln(1 + n) + 1) AS x FROM lw LEFT JOIN idf USING (w), n),
    nrm AS (SELECT doc_id, line, sqrt(sum(x * x)) AS nrm, sum(c) AS here FROM lv GROUP BY ALL),
    sc AS (SELECT lv.doc_id, lv.path, lv.words, lv.line, nrm.here, tv.license, round(sum(lv.x * tv.x) / any_value(nrm.nrm), 6) AS cosine
           FROM lv JOIN tv USING (w) JOIN nrm USING (doc_id, line) GROUP BY lv.doc_id, lv.path, lv.words, lv.line, nrm.here, tv.license),
    notice AS (SELECT * FROM sc WHERE cosine >= {COSINE} QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY cosine DESC, license) = 1),
    found AS (SELECT doc_id, path, min_by(license, struct_pack(a := -cosine, b := license)) AS own_license, max(cosine) AS own_cosine, sum(here) >= {FILE_SHARE} * any_value(words) AS is_file
              FROM notice GROUP BY doc_id, path),
    holds AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS up, own_license AS license, path AS from_path FROM found WHERE is_file
              QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY own_cosine DESC, path, doc_id) = 1),
    f2 AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder FROM files),
    near AS (SELECT folder, license AS inherited, from_path FROM (SELECT DISTINCT folder FROM f2) JOIN holds ON up = '' OR folder = up OR starts_with(folder, up || '/')
             QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(up) DESC) = 1)
    SELECT f2.doc_id, f2.path, own_license, own_cosine, coalesce(is_file, false) AS is_license_file, coalesce(own_license, inherited) AS license,
           CASE WHEN own_license IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
           CASE WHEN own_license IS NULL THEN near.from_path END AS from_path
    FROM f2 LEFT JOIN near USING (folder) LEFT JOIN found USING (doc_id, path)
    """

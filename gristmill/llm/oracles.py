"""DuckDB SQL that gives the rows of the queries which SQL can express."""

from __future__ import annotations

from .licenses import oracle_sql as licenses_sql

SPACE = "\\x20\\x09-\\x0D"

EXACT = f"""
    WITH t AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[{SPACE}]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents
    ), g AS (
        SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS rn,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size
        FROM t
    )
    SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


def quality_sql(order: int = 5) -> str:
    """Base counts, the Kneser-Ney model over hexadecimal digits of bytes, and the bands."""
    levels = [f"level{k} AS (SELECT l, substr(g, 3) AS g, count(*) AS c FROM level{k + 1} GROUP BY ALL)" for k in range(order - 1, 0, -1)]
    for k in range(1, order + 1):
        plain = "n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0"
        raw = [("1 - 2 * y * n2 / n1", 0.5, 1), ("2 - 3 * y * n3 / n2", 1, 2), ("3 - 4 * y * n4 / n3", 1.5, 3)]
        cases = ", ".join(f"CASE WHEN {plain} THEN least(greatest({x}, 0.05::DOUBLE), {most}::DOUBLE) ELSE {other}::DOUBLE END AS d{j}" for j, (x, other, most) in enumerate(raw, 1))
        base = f"JOIN p{k - 1} AS b ON b.l = v.l AND b.g = substr(v.g, 3)" if k > 1 else ""
        levels += [
            f"n{k} AS (SELECT l, {', '.join(f'count(*) FILTER (c = {j})::DOUBLE AS n{j}' for j in (1, 2, 3, 4))} FROM level{k} GROUP BY l)",
            f"d{k} AS (SELECT l, {cases} FROM (SELECT *, n1 / (n1 + 2 * n2) AS y FROM n{k}))",
            f"c{k} AS (SELECT v.l, v.g, c, CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d FROM level{k} AS v JOIN d{k} USING (l))",
            f"v{k} AS (SELECT *, sum(c) OVER x AS total, sum(d) OVER x AS rest FROM c{k} WINDOW x AS (PARTITION BY l, substr(g, 1, {2 * k - 2})))",
            f"p{k} AS (SELECT v.l, v.g, (c - d) / total + rest / total * {'b.p' if k > 1 else '(1 / 256::DOUBLE)'} AS p FROM v{k} AS v {base})",
        ]
    return f"""
    WITH t AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce('x' || lang, '') AS l, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS ws FROM documents
    ), words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
    triples AS (SELECT r, i, w || ' ' || lead(w) OVER x || ' ' || lead(w, 2) OVER x AS s FROM words WINDOW x AS (PARTITION BY r ORDER BY i)),
    repeated AS (SELECT r, i FROM triples WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
    n_repeats AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM repeated, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
    n_lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^{SPACE}]') GROUP BY r),
    base AS (
        SELECT t.*, len(ws) AS n_words, length(regexp_replace(text, '[{SPACE}]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(ws, lambda w: regexp_matches(w, '[0-9A-Za-z]|[^\\x00-\\x7F]'))) AS real_words
        FROM t LEFT JOIN n_repeats USING (r) LEFT JOIN n_lines USING (r)
    ), tested AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
    raw AS (SELECT r, l, '{"00" * (order - 1)}' || hex(encode(text)) AS h FROM t),
    pieces AS (SELECT r, l, substr(h, 512 * j + 1, {512 + 2 * order - 2}) AS h FROM (SELECT r, l, h, unnest(range(length(h) // 512 + 1)) AS j FROM raw)),
    grams AS (SELECT r, l, substr(h, 2 * i + 1, {2 * order}) AS g FROM (SELECT r, l, h, unnest(range(length(h) // 2 - {order - 1})) AS i FROM pieces)),
    level{order} AS (SELECT l, g, count(*) AS c FROM grams GROUP BY ALL),
    {", ".join(levels)},
    scores AS (SELECT r, sum(round(-1048576 * ln(p))::BIGINT)::BIGINT AS cost FROM grams JOIN p{order} USING (l, g) GROUP BY r),
    scored AS (SELECT tested.*, cost / 1048576 / greatest(real_words, 1) AS score FROM tested LEFT JOIN scores USING (r)),
    bins AS (SELECT l, floor(score * 128) AS bin, count(*) AS c FROM scored WHERE NOT base_failed GROUP BY ALL),
    seen AS (SELECT *, sum(c) OVER (PARTITION BY l) AS total, sum(c) OVER (PARTITION BY l ORDER BY bin) AS seen FROM bins),
    marks AS (SELECT l, (min(bin) FILTER (4 * seen >= total) + 0.5) / 128 AS q1, (min(bin) FILTER (4 * seen >= 3 * total) + 0.5) / 128 AS q3 FROM seen GROUP BY l)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(score BETWEEN q1 - 3 * greatest(q3 - q1, 0.2) AND q3 + 3 * greatest(q3 - q1, 0.2), false) AS kept
    FROM scored LEFT JOIN marks USING (l)
    """


JACCARD = f"""
    WITH RECURSIVE t AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') AS ws FROM documents
    ), words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
    windows AS (SELECT r, concat_ws(' ', w, lead(w) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x, lead(w, 4) OVER x) AS s, i = 1 OR lead(w, 4) OVER x IS NOT NULL AS whole FROM words WINDOW x AS (PARTITION BY r ORDER BY i)),
    shingles AS MATERIALIZED (SELECT DISTINCT r, s FROM windows WHERE whole),
    sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
    common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes AS x ON x.r = a JOIN sizes AS y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    reached(r, c) AS (SELECT r, r FROM t UNION SELECT links.b, reached.c FROM reached JOIN links ON links.a = reached.r)
    SELECT x.doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM t AS x LEFT JOIN sizes USING (r) JOIN (SELECT reached.r, min(doc_id) AS component_id FROM reached JOIN t ON t.r = reached.c GROUP BY reached.r) USING (r)
"""

REPEATS = """
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
    pieces AS (SELECT r, o, 256 * j AS low, substr(h, 512 * j + 1, 610) AS h FROM (SELECT r, o, h, unnest(range(length(h) // 512 + 1)) AS j FROM t)),
    strings AS (SELECT r, o, low + i AS i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, o, low, h, unnest(range(length(h) // 2 - 49)) AS i FROM pieces)),
    marked AS (SELECT r, i FROM (SELECT r, i, o, min(o) OVER (PARTITION BY s) AS least FROM strings) WHERE least < o),
    runs AS (SELECT r, i, i > coalesce(lag(i) OVER x, -100) + 50 AS new FROM marked WINDOW x AS (PARTITION BY r ORDER BY i)),
    spans AS (SELECT r, min(i) AS low, max(i) + 50 AS high FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM runs) GROUP BY r, k),
    cuts AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM (FROM spans UNION ALL SELECT r, length(h) // 2, NULL FROM t)),
    kept AS (SELECT r, count(high) AS n_spans, coalesce(sum(high - low), 0)::BIGINT AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low, high NULLS LAST) AS kept FROM cuts JOIN t USING (r) GROUP BY r)
    SELECT doc_id, length(h) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN kept USING (r)
"""

MIX = f"""
    WITH RECURSIVE t AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS u
        FROM documents
    ), sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM t GROUP BY source),
    rounds AS (
        SELECT 0 AS k, s, 1 + (s - 1) % 3 AS w, source_size, (sum(source_size) OVER ())::DOUBLE AS rest FROM sources
        UNION ALL
        SELECT k + 1, s, w, source_size, rest - gone
        FROM (SELECT *, bool_or(over) OVER () AS any_over, sum(3 * source_size) FILTER (over) OVER () AS gone
              FROM (SELECT *, rest * w / sum(w) OVER () > 3 * source_size AS over FROM rounds))
        WHERE any_over AND NOT over
    ), shares AS (SELECT *, rest * w / sum(w) OVER (PARTITION BY k) AS share FROM rounds),
    plan AS (
        SELECT s, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::INT END AS whole, source_size
        FROM (SELECT s, source_size, CASE WHEN share > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE share END AS target FROM shares QUALIFY row_number() OVER (PARTITION BY s ORDER BY k DESC) = 1)
    ), named AS (SELECT t.*, s FROM t JOIN sources ON t.source IS NOT DISTINCT FROM sources.source),
    draws AS (SELECT s, u, sum(size) AS z FROM named WHERE size > 0 GROUP BY ALL),
    below AS (SELECT s, u, z, sum(z) OVER (PARTITION BY s ORDER BY u) - z AS before, target - whole * source_size AS budget FROM draws JOIN plan USING (s)),
    edges AS (SELECT s, u + (2 * (budget - before) > z)::INT AS threshold FROM below WHERE before + z > budget QUALIFY row_number() OVER (PARTITION BY s ORDER BY u) = 1),
    taken AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + (u < coalesce(threshold, 1 << 60))::INT END AS copies FROM named JOIN plan USING (s) LEFT JOIN edges USING (s))
    SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": EXACT, "op2_quality": quality_sql(), "op3_licenses": licenses_sql(), "op4_jaccard": JACCARD, "op5_repeats": REPEATS, "op7_source_mix": MIX}

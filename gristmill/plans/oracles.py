"""DuckDB SQL for the catalogue's queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from ..functions import fixed
from .catalog import LEDGER, SNAPSHOT_DAY
from .listings import BRANDS, CATEGORIES, SPECS, VENDORS

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9#+/.&()-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def grab(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def price(x: str) -> str:
    return f"CAST(round(TRY_CAST(replace(regexp_replace({x}, '[^0-9.,-]', '', 'g'), ',', '') AS DECIMAL(38,10)), 0) AS BIGINT)"


def category_of_title(t: str) -> str:
    has = lambda w: f"contains({t}, {q(w)})"
    return f"""CASE WHEN {has("thermal paste")} OR {has("thermal grease")} THEN 'thermal_paste'
        WHEN {has("mounting kit")} AND {has("cooler not included")} THEN 'cooler_accessory'
        WHEN {has("fan controller")} OR {has("fan hub")} THEN 'fan_controller'
        WHEN {has("splitter")} AND ({has("fan")} OR {has("rgb")}) THEN 'fan_controller'
        WHEN {has("light strip")} OR {has("rgb led")} THEN 'rgb_lighting'
        WHEN ({has("starter kit")} OR {has("expansion kit")}) AND {has("fan")} THEN 'case_fan'
        WHEN {rlike(t, r"\b\d{2,3}\s*mm\b")} AND {rlike(t, r"\bfans?\b")} THEN 'case_fan'
        WHEN {has("liquid cooling")} OR {has("aio")} THEN 'aio'
        WHEN {has("cpu cooler")} OR {has("air cooler")} THEN 'cooler_air' END"""


def base_category(key: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.CATEGORY_OF.items())
    return f"CASE {key} {whens} ELSE CASE WHEN starts_with({key}, 'case') AND NOT contains({key}, 'fan') THEN 'case' ELSE 'other' END END"


def brand_of(text: str) -> str:
    order = sorted(fixed.BRAND_OF.items(), key=lambda kv: -len(kv[0]))
    return "CASE " + " ".join(f"WHEN contains(' ' || lower({text}) || ' ', {q(f' {a} ')}) THEN {q(b)}" for a, b in order) + " END"


def _mpn_list(text: str) -> str:
    """The first find of the greatest length, pattern by pattern."""
    finds = " || ".join(f"regexp_extract_all(upper({text}), {q(p)})" for p in fixed.PART_NUMBERS)
    return f"regexp_replace(list_filter({finds}, lambda x: length(x) = list_max(list_transform({finds}, lambda y: length(y))))[1], '[^A-Z0-9]', '', 'g')"


L = f"""L AS (
    SELECT {KEYS}, ({listed(VENDORS)})[CAST(l_suppkey % 4 + 1 AS INT)] AS vendor_id,
        CASE l_partkey % 5 WHEN 0 THEN 'FD-C-' || l_partkey || '-01' WHEN 1 THEN 'GV-N' || l_partkey || '-8G' WHEN 2 THEN CAST(l_partkey AS VARCHAR) WHEN 3 THEN 'O11-' || l_partkey || 'W' END AS vendor_sku,
        CASE l_suppkey % 4 WHEN 1 THEN 'https://v.example/en/product-' || l_partkey || '-x' WHEN 3 THEN 'https://v.example/catalog.php?id=' || l_partkey ELSE 'https://v.example/p/' || l_partkey END AS url,
        ({listed(BRANDS)})[CAST((l_partkey // 5) % 10 + 1 AS INT)] || ' ' || p_name || ' ' || ({listed(SPECS)})[CAST((l_partkey // 12) % 8 + 1 AS INT)] AS title_raw,
        CASE l_linenumber % 4 WHEN 1 THEN '₪ ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) WHEN 2 THEN CAST(CAST(l_extendedprice AS DECIMAL(20,8)) AS VARCHAR) WHEN 3 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS price_ils,
        CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS in_stock,
        ({listed(CATEGORIES)})[CAST(l_partkey % 12 + 1 AS INT)] AS category_guess, CAST(l_shipdate AS DATE) AS last_seen, l_linestatus = 'O' AS stale
    FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

E1 = f"""E1 AS (
    SELECT *, CASE WHEN lower(vendor_id) IN ('1pc', 'onepc') THEN '1pc' ELSE lower(vendor_id) END AS vendor, {price("price_ils")} AS price,
        replace(regexp_replace(lower(category_guess), '[^a-z0-9]+', '', 'g'), 'bundleonly', '') AS guess_key, lower({clean("title_raw")}) AS title_clean,
        {clean("coalesce(vendor_sku, 'None') || ' ' || coalesce(title_raw, 'None')")} AS match_text,
        upper(regexp_replace(coalesce(vendor_sku, ''), '[^A-Za-z0-9]', '', 'g')) AS sku_norm, contains(lower(category_guess), 'bundle-only') AS bundle_only
    FROM L
)"""
E2 = f"E2 AS (SELECT *, {base_category('guess_key')} AS base, {category_of_title('title_clean')} AS hint FROM E1)"
ENRICHED = f"""E AS (
    SELECT * EXCLUDE (base, hint), CASE WHEN base = 'case' AND hint IN ('thermal_paste', 'fan_controller', 'rgb_lighting', 'cooler_accessory') THEN hint WHEN base = 'cooling' THEN coalesce(hint, 'cooling_other') ELSE base END AS category,
        vendor || ':' || coalesce(CASE WHEN vendor = '1pc' THEN {grab("url", "product-([0-9]+)")} WHEN vendor = 'ivory' THEN {grab("url", "[?&]id=([0-9]+)")} END, nullif(trim(vendor_sku), ''), substring(sha1(url), 1, 12)) AS listing_key,
        {brand_of("match_text")} AS brand, {_mpn_list("match_text")} AS mpn
    FROM E2
)"""
WITH_E = f"WITH {L}, {E1}, {E2}, {ENRICHED}"
WITH_D = WITH_E + """, D AS (
    SELECT * FROM E QUALIFY row_number() OVER (PARTITION BY listing_key ORDER BY price IS NULL, coalesce(price, 0), NOT coalesce(in_stock, false), stale, last_seen DESC, url,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, price_ils NULLS FIRST) = 1
)"""
WITH_M = (
    WITH_D
    + f""", ledger(listing_key, manual_id) AS (VALUES {", ".join(f"({q(a)}, {q(b)})" for a, b in LEDGER)}),
M0 AS (
    SELECT D.*, manual_id, CASE WHEN category NOT IN ('other', '') AND mpn <> '' THEN 'mpn:' || category || ':' || lower(mpn) END AS by_mpn,
        CASE WHEN category NOT IN ('other', '') AND length(sku_norm) >= 5 AND NOT regexp_matches(sku_norm, '^[0-9]+$') THEN 'sku:' || category || ':' || lower(sku_norm) END AS by_sku
    FROM D LEFT JOIN ledger USING (listing_key)
), M AS (
    SELECT * EXCLUDE (manual_id, by_mpn, by_sku),
        coalesce(manual_id, by_mpn, by_sku, category || ':' || vendor || ':' || trim(regexp_replace(lower(listing_key), '[^a-z0-9]+', '-', 'g'), '-')) AS product_id,
        CASE WHEN manual_id IS NOT NULL THEN 'manual' WHEN by_mpn IS NOT NULL THEN 'mpn' WHEN by_sku IS NOT NULL THEN 'sku' ELSE 'singleton' END AS matched_by
    FROM M0
)"""
)


# ------------------------------------------------------------------ attributes
def socket(t):
    return f"coalesce(replace(upper({grab(t, fixed.SOCKET)}), ' ', ''), 'LGA' || {grab(t, fixed.SOCKET_NUMBER)})"


def form_factor(t):
    return "CASE " + " ".join(f"WHEN {rlike(t, p)} THEN {q(n)}" for p, n in fixed.FORM_FACTORS) + " END"


def wifi(t):
    return f"CASE WHEN {rlike(t, fixed.WIFI_STANDARD)} OR {rlike(t, fixed.WIFI)} THEN true END"


def wifi_standard(t):
    return f"CASE WHEN {rlike(t, fixed.WIFI_STANDARD)} THEN upper('WIFI' || regexp_extract({t}, {q(fixed.WIFI_STANDARD)}, 1) || regexp_extract({t}, {q(fixed.WIFI_STANDARD)}, 2)) END"


def _plain(t):
    return {"socket": socket(t), "chipset": f"upper({grab(t, fixed.CHIPSET)})", "memory_type": f"'DDR' || {grab(t, fixed.DDR)}", "form_factor": form_factor(t), "wifi": wifi(t), "wifi_standard": wifi_standard(t), "lan": f"{grab(t, fixed.LAN)} || 'G'"}


def _by_category(t: str) -> dict[str, dict[str, str]]:
    plain = _plain(t)
    info = lambda k: "CASE " + plain["chipset"] + " " + " ".join(f"WHEN {q(c)} THEN {q(v[k])}" for c, v in fixed.CHIPSETS.items() if v[k]) + " END"
    number = lambda p: f"TRY_CAST({grab(t, p)} AS INT)"
    ex = lambda p, g: f"regexp_extract({t}, {q(p)}, {g})"
    cooling = {"size_mm": number(fixed.SIZE_MM), "argb": f"CASE WHEN {rlike(t, r'(?i)\bARGB\b')} THEN true END", "rgb": f"CASE WHEN NOT {rlike(t, r'(?i)\bARGB\b')} AND {rlike(t, r'(?i)\bRGB\b')} THEN true END", "pwm": f"CASE WHEN {rlike(t, r'(?i)\bPWM\b')} THEN true END"}
    revision = f"CASE WHEN {rlike(t, r'\b[Vv]\d+\b')} THEN 'V' || {ex(r'\b[Vv](\d+)\b', 1)} WHEN {rlike(t, r'\b[Rr]\d+\b')} THEN 'R' || {ex(r'\b[Rr](\d+)\b', 1)} WHEN {rlike(t, r'(?i)\bREV\.?\s?\d')} THEN 'REV' || {ex(r'(?i)\bREV\.?\s?(\d+(?:\.\d+)?)\b', 1)} WHEN {rlike(t, r'\bIII\b')} THEN 'V3' WHEN {rlike(t, r'\bII\b')} THEN 'V2' END"
    brand = f"CASE WHEN {rlike(t, fixed.AMD_CPU)} THEN 'AMD' WHEN {rlike(t, fixed.INTEL_CPU)} OR {rlike(t, fixed.XEON_CPU)} THEN 'Intel' END"
    model = f"CASE WHEN {rlike(t, fixed.AMD_CPU)} THEN 'Ryzen ' || {ex(fixed.AMD_CPU, 1)} || ' ' || upper({ex(fixed.AMD_CPU, 2)}) WHEN {rlike(t, fixed.INTEL_CPU)} THEN 'Core ' || upper({ex(fixed.INTEL_CPU, 1)}) || ' ' || trim(upper({ex(fixed.INTEL_CPU, 2)})) WHEN {rlike(t, fixed.XEON_CPU)} THEN 'Xeon ' || replace({ex(fixed.XEON_CPU, 1)}, ' ', '') END"
    colors = "CASE " + " ".join(f"WHEN {rlike(t, rf'(?i)\b{c}\b')} THEN {q(c.title())}" for c in fixed.COLORS) + " END"
    return {
        "motherboard": plain | {"socket": f"coalesce({plain['socket']}, {info(0)})", "memory_type": f"coalesce({plain['memory_type']}, {info(1)})", "memory_slots": number(fixed.MEMORY_SLOTS), "revision": revision},
        "cpu": {"socket": plain["socket"], "packaging": f"CASE WHEN {rlike(t, r'(?i)\bTRAY\b')} THEN 'Tray' WHEN {rlike(t, r'(?i)\bBOX\b|\bWOF\b')} THEN 'Box' END", "brand": brand, "model": model},
        "gpu": {"gpu_chip": f"upper({grab(t, fixed.GPU_CHIP)})", "vram_gb": number(fixed.VRAM), "memory_type": f"'GDDR' || {grab(t, fixed.GDDR)}"},
        "psu": {"wattage_w": number(fixed.WATTS), "efficiency": f"upper({grab(t, fixed.EFFICIENCY)})", "modular": f"upper({grab(t, fixed.MODULAR)})"},
        "memory": {"memory_type": plain["memory_type"], "total_gb": f"TRY_CAST(nullif(regexp_extract(replace(lower({t}), ' ', ''), '([0-9]+)gb', 1), '') AS BIGINT)", "kit": f"CASE WHEN {rlike(t, fixed.KIT)} THEN {ex(fixed.KIT, 1)} || 'x' || {ex(fixed.KIT, 2)} || 'GB' END", "speed_mhz": number(fixed.SPEED), "cas_latency": number(fixed.LATENCY)},
        "case": {"form_factor": plain["form_factor"], "color": colors},
        "case_fan": cooling, "aio": cooling, "cooler_air": cooling,
    }


KINDS = ("socket", "chipset", "memory_type", "form_factor", "wifi", "wifi_standard", "lan", "memory_slots", "revision", "packaging", "brand", "model", "gpu_chip", "vram_gb", "wattage_w", "efficiency", "modular", "total_gb", "kit", "speed_mhz", "cas_latency", "color", "size_mm", "argb", "rgb", "pwm")


def parts_of(title: str) -> str:
    """Cleaned parts of a title of three or more, else none."""
    body = clean("p")
    return f"CASE WHEN len(string_split({title}, '-')) >= 3 THEN list_filter(list_transform(string_split({title}, '-'), lambda p: {body}), lambda p: p <> '') ELSE [] END"


def fragment_columns(parts: str) -> dict[str, str]:
    plain = _plain("p")
    first = lambda e: f"list_filter(list_transform({parts}, lambda p: {e}), lambda x: x IS NOT NULL)[1]"
    radio = f"list_filter({parts}, lambda p: {plain['wifi']})[1]"
    return {k: first(v) for k, v in plain.items() if not k.startswith("wifi")} | {"wifi": wifi(radio), "wifi_standard": wifi_standard(radio)}


def attribute_columns(source: str, prefix: str = "") -> str:
    """A CTE A with the attributes of `source`, as text."""
    by, frag = _by_category("match_text"), fragment_columns("parts")
    columns = []
    for k in KINDS:
        whens = " ".join(f"WHEN {q(c)} THEN CAST({f[k]} AS VARCHAR)" for c, f in by.items() if k in f)
        own = f"CASE category {whens} END"
        columns.append(f"{f'coalesce({own}, CAST({frag[k]} AS VARCHAR))' if k in frag else own} AS a_{k}")
    return f"{prefix}A AS (SELECT *, {', '.join(columns)} FROM (SELECT *, {parts_of('title_raw')} AS parts FROM {source}))"


def attribute_rows(extra: str) -> str:
    """A CTE V of (extra columns, key, raw) with the known attributes of A."""
    each = " || ".join(f"CASE WHEN a_{k} <> '' THEN [{{'key': {q(k)}, 'raw': a_{k}}}] ELSE [] END" for k in KINDS)
    return f"V AS (SELECT {extra}, u.key AS key, u.raw AS raw FROM (SELECT *, unnest({each}) AS u FROM A))"


VOTES = "N AS (SELECT product_id, key, lower(trim(raw)) AS norm, count(*) AS votes, min(struct_pack(a := vendor, b := listing_key)) AS seen, arg_min(raw, struct_pack(a := vendor, b := listing_key)) AS raw FROM V GROUP BY ALL)"
PAIR = " AND ".join(f"coalesce(a.{c} = b.{c}, true)" for c in ("mpn", "c_ddr", "c_total_gb", "c_speed_mhz", "c_wattage", "c_pack_size"))
CRITICAL = f"""{grab("tight", "ddr([3-5])")} AS c_ddr, {grab("tight", "([0-9]+)gb")} AS c_total_gb, {grab("tight", "([0-9]{3,4})mhz")} AS c_speed_mhz, {grab("low", r"(\d{3,4})w\b")} AS c_wattage,
    coalesce({grab("low", r"\b(\d+)\s*(?:pack|pcs|pieces)\b")}, {grab("low", r"\bpack of\s*(\d+)\b")}) AS c_pack_size, regexp_extract_all(low, '\\b[vr]\\d+\\b') AS c_revs"""
WITH_C = lambda source: f"C AS (SELECT *, {CRITICAL} FROM (SELECT *, lower(match_text) AS low, replace(lower(match_text), ' ', '') AS tight FROM {source}))"
LABEL_ROWS = (
    WITH_D
    + ", "
    + attribute_columns("D")
    + ", "
    + attribute_rows("l_partkey")
    + f""", T AS (
        SELECT 'cuts' AS kind, CAST(l_partkey % 96 AS VARCHAR) AS id, key AS attr, raw AS value FROM V WHERE key IN ({", ".join(map(q, fixed.LABEL_KEYS))})
        UNION ALL SELECT 'cuts', CAST(1000 + l_partkey % 7 AS VARCHAR), key, raw FROM V WHERE key IN ({", ".join(map(q, fixed.LABEL_KEYS))})
        UNION ALL SELECT 'parents', CAST(l_partkey % 24 AS VARCHAR), 'category', category FROM D
    ), LB AS (
        SELECT kind, id, attr, value FROM (SELECT *, sum(n) OVER (PARTITION BY kind, id, attr) AS total FROM (SELECT kind, id, attr, value, count(*) AS n FROM T GROUP BY ALL)) WHERE total >= 2 AND n / total >= 0.9
    )"""
)


def _entities(x: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def oracle_sql() -> dict[str, str]:
    out = {
        "q_clean_text": f"SELECT doc_id, {clean('coalesce(nfc_normalize(text), chr(32))')} AS cleaned FROM documents",
        "q_clean_turns": f"SELECT conv_id, turn, {clean('coalesce(nfc_normalize(text), chr(32))')} AS cleaned FROM conversations",
        "q_clean_pages": f"SELECT page_id, {clean(_entities('html'))} AS cleaned FROM pages",
        "q_keys": "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS compact, trim(regexp_replace(lower(concat_ws(' / ', p_brand, p_type, p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
        "q_price": f"WITH {L} SELECT {KEYS}, price_ils, {price('price_ils')} AS price FROM L",
        "q_category": f"{WITH_E} SELECT {KEYS}, category, bundle_only FROM E",
        "q_listing_key": f"{WITH_E} SELECT {KEYS}, vendor, listing_key FROM E",
        "q_norm_sku": f"{WITH_E} SELECT {KEYS}, sku_norm AS sku, upper(regexp_replace(title_raw, '[^A-Za-z0-9]', '', 'g')) AS title_sku FROM E",
        "q_brand": f"{WITH_E} SELECT {KEYS}, match_text, brand FROM E",
        "q_mpn": f"{WITH_E} SELECT {KEYS}, mpn FROM E",
        "q_mpn_documents": f"SELECT doc_id, {_mpn_list('t')} AS mpn FROM (SELECT doc_id, {clean('coalesce(nfc_normalize(text), chr(32))')} AS t FROM documents)",
        "q_dedupe": f"{WITH_D} SELECT listing_key, {KEYS}, price, in_stock, stale, last_seen FROM D",
        "q_match": f"{WITH_M} SELECT listing_key, product_id, matched_by FROM M",
        "q_product_rules": f"{WITH_M} SELECT product_id, arg_min(matched_by, CASE matched_by WHEN 'manual' THEN 0 WHEN 'mpn' THEN 1 WHEN 'sku' THEN 2 ELSE 3 END) AS matched_by FROM M GROUP BY 1",
        "q_product_summary": f"""{WITH_M}, G AS (
            SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY vendor, listing_key) AS place,
                row_number() OVER (PARTITION BY product_id ORDER BY brand IS NULL, length(match_text) > 150, CASE vendor WHEN 'tms' THEN 0 WHEN '1pc' THEN 1 WHEN 'ivory' THEN 2 WHEN 'plonter' THEN 3 ELSE 9 END, -length(match_text), vendor, listing_key) AS name_place FROM M)
            SELECT product_id, count(*) AS listings, count(DISTINCT nullif(vendor, '')) AS vendor_count, max(category) FILTER (WHERE place = 1) AS category,
                arg_min(brand, place) FILTER (WHERE brand IS NOT NULL) AS brand, max(coalesce(nullif(trim(match_text), ''), listing_key)) FILTER (WHERE name_place = 1) AS canonical_name,
                CASE WHEN count(DISTINCT mpn) = 1 THEN max(mpn) END AS mpn, bool_or(bundle_only) AS bundle_only FROM G GROUP BY product_id""",
        "q_best_offer": f"""{WITH_M} SELECT product_id, listing_key, vendor, price, in_stock, stale, url FROM M WHERE price IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN in_stock THEN 0 WHEN in_stock IS NULL THEN 1 ELSE 2 END, price, stale, vendor, listing_key) = 1""",
        "q_offers": f"{WITH_M} SELECT product_id, listing_key, price, row_number() OVER (PARTITION BY product_id ORDER BY vendor, price IS NULL, price, listing_key) AS place FROM M",
        "q_attributes": f"{WITH_D}, {attribute_columns('D')} SELECT listing_key, category, array_to_string(list_sort({' || '.join(f'''CASE WHEN a_{k} <> '' THEN ['{k}=' || a_{k}] ELSE [] END''' for k in KINDS)}), '|') AS attributes FROM A",
        "q_fragments": f"WITH {L} SELECT {KEYS}, {', '.join(f'{v} AS {k}' for k, v in fragment_columns('parts').items())} FROM (SELECT *, {parts_of('title')} AS parts FROM (SELECT *, replace(title_raw, ' ', ' - ') AS title FROM L))",
        "q_meta": "SELECT event_id, array_to_string(list_sort(['socket=' || event_type, 'core_count=' || json_extract_string(props, '$.k'), 'user_no=' || user_id]), '|') AS meta FROM events",
        "q_hebrew": "SELECT p_partkey, p_size AS cores, p_size AS threads, p_size + 0.5::DOUBLE AS base_clock_ghz, p_size + 0.9::DOUBLE AS boost_clock_ghz, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cooler_included FROM part",
        "q_stock_join": """WITH a AS (
                SELECT 'P' || l_partkey AS code, CASE l_returnflag WHEN 'A' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE '' END AS s, ['#75a74d', '#b40001', '#0000ff', ''][CAST(l_linenumber % 4 + 1 AS INT)] AS c
                FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_shipdate DESC, l_returnflag DESC) = 1)
            SELECT p_partkey, CASE WHEN s = 'in_stock' OR c IN ('#75a74d', '#0000ff') THEN true WHEN s = 'out_of_stock' OR c = '#b40001' THEN false END AS in_stock
            FROM part LEFT JOIN a ON p_partkey % 7 > 0 AND code = 'P' || p_partkey""",
        "q_tile_price": f"SELECT {KEYS}, l_extendedprice, l_returnflag, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS price, CASE WHEN l_returnflag = 'N' OR l_linenumber % 3 = 0 AND l_linenumber % 2 = 0 THEN 'cpu:new-pc-deal' ELSE 'cpu' END AS category FROM lineitem",
        "q_snapshot_asof": f"""WITH d AS (SELECT event_type AS vendor, CAST(ts AS DATE) AS date, count(*) AS rows FROM events GROUP BY ALL),
            n AS (SELECT * FROM d WHERE date + CASE vendor WHEN 'click' THEN 5 WHEN 'error' THEN 20 ELSE 0 END <= DATE '{SNAPSHOT_DAY}' AND date BETWEEN DATE '{SNAPSHOT_DAY}' - 14 AND DATE '{SNAPSHOT_DAY}')
            SELECT vendor, date, rows, date <> DATE '{SNAPSHOT_DAY}' AS stale FROM n QUALIFY row_number() OVER (PARTITION BY vendor ORDER BY date DESC) = 1""",
        "q_first_seen": "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) = 1",
        "q_majority": f"{WITH_M}, {attribute_columns('M')}, {attribute_rows('product_id, vendor, listing_key')}, {VOTES} SELECT product_id, key, arg_min(raw, struct_pack(a := -votes, b := seen)) AS value, count(*) AS n_values FROM N GROUP BY 1, 2",
        "q_conflicts": f"{WITH_M}, {attribute_columns('M')}, {attribute_rows('concat_ws(chr(58), category, brand) AS product_id, vendor, listing_key')}, {VOTES} SELECT product_id, key, string_agg(raw, '|' ORDER BY seen, raw) AS conflict FROM N GROUP BY 1, 2 HAVING count(*) > 1",
        "q_labels": f"{LABEL_ROWS} SELECT * FROM LB",
        "q_apply_labels": f"""{LABEL_ROWS}, X AS (SELECT listing_key, unnest([1000 + l_partkey % 7, l_partkey % 96]) AS cut FROM D)
            SELECT listing_key, attr, arg_min(value, cut) AS value FROM X JOIN LB ON kind = 'cuts' AND CAST(id AS BIGINT) = cut GROUP BY 1, 2""",
        "q_critical": f"{WITH_D}, {WITH_C('D')} SELECT listing_key, c_ddr, c_total_gb, c_speed_mhz, c_wattage, c_pack_size, array_to_string(c_revs, '|') AS c_revs FROM C",
        "q_fuzzy_pairs": f"""{WITH_M}, {WITH_C('M')}, K AS (SELECT * REPLACE (list_sort(list_distinct(c_revs)) AS c_revs), count(*) OVER (PARTITION BY product_id) > 1 AS multi FROM C),
            G AS (SELECT category, brand, multi, mpn, c_ddr, c_total_gb, c_speed_mhz, c_wattage, c_pack_size, c_revs, min(listing_key) AS class_id, count(*) AS members
                FROM K WHERE category NOT IN ('other', '') AND brand IS NOT NULL AND match_text <> '' GROUP BY ALL),
            P AS (SELECT a.class_id, sum(CASE WHEN a.class_id = b.class_id THEN b.members - 1 ELSE b.members END) AS n
                FROM G a JOIN G b ON a.category = b.category AND a.brand = b.brand
                WHERE NOT (a.multi AND b.multi) AND {PAIR} AND (len(a.c_revs) = 0 OR len(b.c_revs) = 0 OR list_has_any(a.c_revs, b.c_revs)) GROUP BY 1)
            SELECT K.category, K.brand, K.listing_key, G.class_id, CAST(coalesce(n, 0) AS BIGINT) AS links
            FROM K JOIN G ON {" AND ".join(f"K.{c} IS NOT DISTINCT FROM G.{c}" for c in ("category", "brand", "multi", "mpn", "c_ddr", "c_total_gb", "c_speed_mhz", "c_wattage", "c_pack_size", "c_revs"))}
            LEFT JOIN P USING (class_id)""",
        "q_page_nodes": f"SELECT page_id, {grab('html', '<html lang=\"([^\"]*)\"')} AS lang, {_entities(grab('html', '<title>([^<]*)</title>'))} AS title, {_entities(grab('html', '<a [^>]*href=\"([^\"]*)\"'))} AS link FROM pages",
        "q_json_recover": """SELECT event_id, CAST(n AS INT) AS nth, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
            FROM (SELECT *, unnest(CASE event_id % 4 WHEN 1 THEN [0, 1] WHEN 3 THEN [] ELSE [0] END) AS n FROM events)""",
        "best_price_by_category": f"""{WITH_M}, B AS (SELECT product_id, price FROM M WHERE price IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN in_stock THEN 0 WHEN in_stock IS NULL THEN 1 ELSE 2 END, price, stale, vendor, listing_key) = 1),
            G AS (SELECT product_id, arg_min(category, struct_pack(a := vendor, b := listing_key)) AS category FROM M GROUP BY 1)
            SELECT category, count(*) AS products, min(price) AS lowest, max(price) AS highest, sum(price) AS total FROM B JOIN G USING (product_id) GROUP BY 1""",
    }
    for c in ("motherboard", "cpu", "gpu", "psu", "memory", "case", "case_fan"):
        out[f"q_attr_{c}"] = f"{WITH_D}, {attribute_columns('(SELECT * FROM D WHERE category = ' + q(c) + ')')} SELECT listing_key, {', '.join(f'a_{k} AS {k}' for k in KINDS)} FROM A"
    return out

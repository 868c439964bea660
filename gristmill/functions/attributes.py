"""Technical attributes of a listing, as one column each, from its match text, title and structured data."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column

from . import fixed
from .text import clean, grab, keep_model_text, unescape_nfkc

KINDS = {
    "socket": "string", "chipset": "string", "memory_type": "string", "form_factor": "string", "wifi": "boolean", "wifi_standard": "string",
    "lan": "string", "memory_slots": "int", "revision": "string", "packaging": "string", "brand": "string", "model": "string",
    "gpu_chip": "string", "vram_gb": "int", "wattage_w": "int", "efficiency": "string", "modular": "string", "total_gb": "long", "kit": "string",
    "speed_mhz": "int", "cas_latency": "int", "color": "string", "size_mm": "int", "argb": "boolean", "rgb": "boolean", "pwm": "boolean",
}
FRAGMENT_KEYS = ("socket", "chipset", "memory_type", "form_factor", "wifi", "wifi_standard", "lan")


def socket(text: Column) -> Column:
    """A named socket, else a bare number that is one."""
    return F.coalesce(F.replace(F.upper(grab(text, fixed.SOCKET)), F.lit(" "), F.lit("")), F.concat(F.lit("LGA"), grab(text, fixed.SOCKET_NUMBER)))


def chipset(text: Column) -> Column:
    return F.upper(grab(text, fixed.CHIPSET))


def memory_type(text: Column) -> Column:
    return F.concat(F.lit("DDR"), grab(text, fixed.DDR))


def form_factor(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(fixed.FORM_FACTORS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def wifi(text: Column) -> Column:
    """True or unknown, never false."""
    return F.when(text.rlike(fixed.WIFI_STANDARD) | text.rlike(fixed.WIFI), True)


def wifi_standard(text: Column) -> Column:
    found = grab(text, fixed.WIFI_STANDARD)
    return F.when(found.isNotNull(), F.upper(F.concat(F.lit("WIFI"), found, F.regexp_extract(text, fixed.WIFI_STANDARD, 2))))


def lan(text: Column) -> Column:
    return F.concat(grab(text, fixed.LAN), F.lit("G"))


def revision(text: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("V"), grab(text, r"\b[Vv](\d+)\b")), F.concat(F.lit("R"), grab(text, r"\b[Rr](\d+)\b")),
        F.concat(F.lit("REV"), grab(text, r"(?i)\bREV\.?\s?(\d+(?:\.\d+)?)\b")),
        F.when(text.rlike(r"\bIII\b"), "V3").when(text.rlike(r"\bII\b"), "V2"),
    )


def _chipset_info(of: Column, place: int) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in fixed.CHIPSETS.items() if v[place] for x in (k, v[place])))
    return F.try_element_at(known, of)


def _squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def _cpu_brand(text: Column) -> Column:
    return F.when(text.rlike(fixed.AMD_CPU), "AMD").when(text.rlike(fixed.INTEL_CPU) | text.rlike(fixed.XEON_CPU), "Intel")


def _cpu_model(text: Column) -> Column:
    part = lambda p, g: F.regexp_extract(text, p, g)
    return (
        F.when(text.rlike(fixed.AMD_CPU), F.concat(F.lit("Ryzen "), part(fixed.AMD_CPU, 1), F.lit(" "), F.upper(part(fixed.AMD_CPU, 2))))
        .when(text.rlike(fixed.INTEL_CPU), F.concat(F.lit("Core "), _squeeze(F.upper(part(fixed.INTEL_CPU, 1))), F.lit(" "), F.trim(F.upper(part(fixed.INTEL_CPU, 2)))))
        .when(text.rlike(fixed.XEON_CPU), F.concat(F.lit("Xeon "), F.replace(part(fixed.XEON_CPU, 1), F.lit(" "), F.lit(""))))
    )


def _color(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for word in reversed(fixed.COLORS):
        out = F.when(text.rlike(rf"(?i)\b{word}\b"), word.title()).otherwise(out)
    return out


def parsers(text: Column) -> dict[str, dict[str, Column]]:
    """Attributes that each category's listings take from the match text."""
    number = lambda p, kind="int": grab(text, p).try_cast(kind)
    tight = F.regexp_replace(F.lower(text), r"\s+", "")
    cooling = {
        "size_mm": number(fixed.SIZE_MM), "argb": F.when(text.rlike(r"(?i)\bARGB\b"), True),
        "rgb": F.when(~text.rlike(r"(?i)\bARGB\b") & text.rlike(r"(?i)\bRGB\b"), True), "pwm": F.when(text.rlike(r"(?i)\bPWM\b"), True),
    }
    return {
        "motherboard": {
            "chipset": chipset(text), "socket": F.coalesce(socket(text), _chipset_info(chipset(text), 0)),
            "memory_type": F.coalesce(memory_type(text), _chipset_info(chipset(text), 1)), "form_factor": form_factor(text),
            "wifi": wifi(text), "wifi_standard": wifi_standard(text), "lan": lan(text), "memory_slots": number(fixed.MEMORY_SLOTS), "revision": revision(text),
        },
        "cpu": {
            "socket": socket(text), "packaging": F.when(text.rlike(r"(?i)\bTRAY\b"), "Tray").when(text.rlike(r"(?i)\bBOX\b|\bWOF\b"), "Box"),
            "brand": _cpu_brand(text), "model": _cpu_model(text),
        },
        "gpu": {"gpu_chip": _squeeze(F.trim(F.upper(grab(text, fixed.GPU_CHIP)))), "vram_gb": number(fixed.VRAM), "memory_type": F.concat(F.lit("GDDR"), grab(text, fixed.GDDR))},
        "psu": {"wattage_w": number(fixed.WATTS), "efficiency": F.upper(grab(text, fixed.EFFICIENCY)), "modular": _squeeze(F.upper(grab(text, fixed.MODULAR)))},
        "memory": {
            "memory_type": memory_type(text), "total_gb": grab(tight, r"(\d+)gb").try_cast("long"),
            "kit": F.when(text.rlike(fixed.KIT), F.concat(F.regexp_extract(text, fixed.KIT, 1), F.lit("x"), F.regexp_extract(text, fixed.KIT, 2), F.lit("GB"))),
            "speed_mhz": number(fixed.SPEED), "cas_latency": number(fixed.LATENCY),
        },
        "case": {"form_factor": form_factor(text), "color": _color(text)},
        "case_fan": cooling, "aio": cooling, "cooler_air": cooling,
    }


def fragment_texts(title: Column) -> Column:
    """Cleaned parts of a title that is a line of specifications parted by dashes, of three parts at least."""
    mark = "\x01"
    parts = F.split(unescape_nfkc(F.replace(F.coalesce(title, F.lit("")), F.lit("-"), F.lit(mark))), mark)
    return F.when(F.size(parts) >= 3, F.filter(F.transform(parts, keep_model_text), lambda p: p != ""))


def fragments(texts: Column) -> Column:
    """Attributes of such parts, the first part winning each: a struct. Parts are looked at one by one only if all together hold a pattern."""
    whole = F.array_join(texts, "|")
    wireless = (fixed.WIFI_STANDARD, fixed.WIFI)

    def first(found, *patterns: str) -> Column:
        return F.when(whole.rlike("|".join(patterns)), F.get(F.filter(F.transform(texts, found), lambda x: x.isNotNull()), F.lit(0)))

    radio = F.when(whole.rlike("|".join(wireless)), F.get(F.filter(texts, lambda p: wifi(p).isNotNull()), F.lit(0)))
    return F.struct(
        first(socket, fixed.SOCKET, fixed.SOCKET_NUMBER).alias("socket"), first(chipset, fixed.CHIPSET).alias("chipset"), first(memory_type, fixed.DDR).alias("memory_type"),
        first(form_factor, *(p for p, _ in fixed.FORM_FACTORS)).alias("form_factor"), wifi(radio).alias("wifi"), wifi_standard(radio).alias("wifi_standard"), first(lan, fixed.LAN).alias("lan"),
    )


def hebrew_facts(text: Column) -> Column:
    """Cores, threads, clocks and whether a cooler is included, from Hebrew prose; what makes no number is null."""
    u = "(?U)"
    return F.struct(
        grab(text, u + fixed.HEBREW_CORES).try_cast("int").alias("cores"), grab(text, u + fixed.HEBREW_THREADS).try_cast("int").alias("threads"),
        grab(text, u + fixed.HEBREW_CLOCK).try_cast("double").alias("base_clock_ghz"), grab(text, u + fixed.HEBREW_CLOCK, 2).try_cast("double").alias("boost_clock_ghz"),
        F.when(text.rlike(u + fixed.HEBREW_COOLER), True).when(text.rlike(u + fixed.HEBREW_NO_COOLER), False).alias("cooler_included"),
    )


def meta_map(meta: Column) -> Column:
    """Attributes of a vendor's structured data (JSON text): scalar keys first, then named or listed specification blocks.

    A list's last entry of a name doesn't override its first; null and empty values are skipped.
    """
    name = lambda k: F.regexp_replace(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    full = lambda k, v: v.isNotNull() & ~v.isin("", "[]", "{}", "null")
    text_map = "map<string,string>"
    scalars = F.map_filter(F.from_json(meta, text_map), lambda k, v: k.isin(*fixed.META_SCALARS) & full(k, v))
    layers = [F.map_entries(F.coalesce(scalars, F.create_map().cast(text_map)))]
    for block in fixed.META_BLOCKS:
        body = F.get_json_object(meta, f"$.{block}")
        named = F.map_entries(F.map_filter(F.from_json(F.when(body.startswith("{"), body), text_map), full))
        listed = F.from_json(F.when(body.startswith("["), body), "array<struct<name:string,value:string>>")
        listed = F.transform(F.filter(listed, lambda x: x["name"].isNotNull() & x["value"].isNotNull()), lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value")))
        entries = F.transform(F.coalesce(named, listed), lambda e: F.struct(name(e["key"]).alias("key"), e["value"].alias("value")))
        layers.append(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))
    every = F.concat(*layers)
    keys = F.array_distinct(F.transform(every, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(every, lambda e: e["key"] == k), F.lit(0))["value"]))


def as_map(columns: dict[str, Column]) -> Column:
    """Attributes as text by name, without the unknown ones; in the order of KINDS."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull() & (e["value"] != "")))


COOLING = ("case_fan", "aio", "cooler_air")


def first_wins(*maps: Column) -> Column:
    """Union of maps in which the first to have a key decides."""

    def beside(known: Column, more: Column) -> Column:
        return F.map_concat(known, F.map_filter(more, lambda k, v: ~F.array_contains(F.map_keys(known), k)))

    return reduce(beside, maps)


def meta_text(meta: Column) -> Column:
    """The title and description in structured data, where they are texts."""
    return F.concat_ws(" ", F.get_json_object(meta, "$.title"), F.get_json_object(meta, "$.description"))


def cuts(meta: Column) -> Column:
    """The builder's cut ids, ascending; repeats stay, what is no number goes."""
    texts = F.from_json(F.get_json_object(meta, "$.cuts"), "array<string>")
    return F.array_sort(F.transform(F.filter(texts, lambda c: c.rlike("^[0-9]+$")), lambda c: c.cast("long")))


def parent(meta: Column) -> Column:
    p = F.get_json_object(meta, "$.parent")
    return F.when(~p.isin("", "0"), p)


def with_attributes(enriched):
    """enriched listings with attr_<name> columns, the map `attributes`, and of those with vendor_meta (JSON text) cuts and parent.

    In the map the builder's ids (ivory_cuts as a JSON list, ivory_parent) and the vendor's own data come first, then the category's parser, the title's fragments (which count for
    every category) and facts from a Hebrew description. Each parser is a column of its own, so that the plan
    compares a text once and compiles in small pieces.
    """
    rows = enriched.withColumn("_texts", fragment_texts(F.col("title_raw")))
    rows = rows.withColumn("_spec", F.when(F.col("_texts").isNotNull(), fragments(F.col("_texts"))))
    meta = "vendor_meta" in enriched.columns
    rows = rows.withColumn("_text", F.concat_ws(" ", "match_text", F.nullif(clean(meta_text(F.col("vendor_meta"))), F.lit(""))) if meta else F.col("match_text"))
    found = parsers(F.col("_text"))
    groups = {name: [name] for name in found if name not in COOLING} | {"cooling": list(COOLING)}
    for name, categories in groups.items():
        rows = rows.withColumn(f"_p_{name}", F.when(F.col("category").isin(*categories), F.struct(*(v.cast(KINDS[k]).alias(k) for k, v in found[categories[0]].items()))))
    out = {}
    for key in KINDS:
        own = [F.col(f"_p_{name}.{key}") for name, categories in groups.items() if key in found[categories[0]]]
        out[key] = F.coalesce(*own, *([F.col(f"_spec.{key}")] if key in FRAGMENT_KEYS else []))
    wide = rows.select(*enriched.columns, *(v.alias(f"attr_{k}") for k, v in out.items()))
    parsed = as_map({k: F.col(f"attr_{k}") for k in out})
    if not meta:
        return wide.withColumn("attributes", parsed)
    facts = hebrew_facts(F.get_json_object("vendor_meta", "$.description"))
    wide = wide.withColumns({"_meta": meta_map(F.col("vendor_meta")), "_parsed": parsed, "_facts": facts, "cuts": cuts(F.col("vendor_meta")), "parent": parent(F.col("vendor_meta"))})
    spoken = as_map({k: F.col(f"_facts.{k}") for k in ("cores", "threads", "base_clock_ghz", "boost_clock_ghz", "cooler_included")})
    wide = wide.withColumns({"_spoken": spoken, "_known": first_wins(F.col("_meta"), F.col("_parsed"))})
    given = F.get_json_object("vendor_meta", "$.cuts").rlike(r"^\[.*\S.*\]$")  # a list that isn't empty
    own = as_map({"ivory_cuts": F.when(given, F.to_json("cuts")), "ivory_parent": F.col("parent")})
    wide = wide.withColumn("_known", first_wins(own, F.col("_known")))
    return wide.withColumn("attributes", first_wins(F.col("_known"), F.col("_spoken"))).drop("_meta", "_parsed", "_facts", "_spoken", "_known")

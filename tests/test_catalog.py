import datetime as dt
import itertools
import json
from decimal import Decimal

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.functions import attributes, identity, text
from gristmill.operators import fuzzy, labels, products, stock
from gristmill.operators.dedupe import dedupe
from gristmill.operators.match import assign
from gristmill.plans.catalog import build_catalog
from gristmill.sources import jsonl, ledger, payloads, sinks

SF = "/root/testdata/sf0.001"


def values(spark, rows, expr, kind="string"):
    return [r.v for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k int, x {kind}").orderBy("k").select(expr(F.col("x")).alias("v")).collect()]


def test_price(spark):
    given = ["1148.99998400", "1327.50000000", "-", "1-2", "1.2.3", "5.", ".5", "₪ 20,606", "", None, "-12.5", "abc"]
    assert values(spark, given, text.normalize_price) == [1149, 1328, None, None, None, 5, 1, 20606, None, None, -13, None]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,-₪ a", max_size=8), min_size=200, max_size=200))
def test_price_matches_decimal(spark, given):
    def plain(s):
        kept = "".join(c for c in s if c in "0123456789.-")
        try:
            d = Decimal(kept)
        except ArithmeticError:
            return None
        return int(abs(d) + Decimal("0.5")) * (-1 if d < 0 else 1)

    assert values(spark, given, text.normalize_price) == [plain(s) for s in given]


def test_clean(spark):
    given = [None, "  a  b ", "Core™ i3 &amp; x", "מעבד AMD", "Ö²Â®x", "ＡＢＣ１", "a_b,c;d#+/.&()-"]
    assert values(spark, given, text.clean) == ["", "a b", "CoreTM i3 & x", "AMD", "2 x", "ABC1", "a b c d#+/.&()-"]


def test_entities_without_a_semicolon(spark):
    """As html.unescape has it, in texts and in parsed titles."""
    assert values(spark, ["a &amp</title>", "x&ampy &copy z"], text.clean) == ["a & /title", "x&y z"]
    page = '<html lang="en"><title>a &amp;&amp</title><a href="/x">'
    assert values(spark, [page], lambda c: payloads.select_nodes(c, {"title": "title"}, "html")) == [[{"title": "a &&"}]]


def test_sku_and_quote(spark):
    assert values(spark, ["a%20b-1", "%D7%90x", "50%", None, "a+b"], text.normalize_sku) == ["AB1", "X", "50", "", "AB"]
    assert values(spark, ["a b/c~d*e", "א"], text.quote) == ["a%20b/c~d%2Ae", "%D7%90"]
    assert values(spark, ["‎ab1 ", "x&lrm;y", "  ", None], text.availability_key) == ["AB1", "XY", None, None]


def listing(**kw):
    base = dict(vendor_id="tms", vendor_sku=None, url=None, title_raw=None, price_ils=None, in_stock=None, category_guess=None, last_seen=dt.date(2024, 1, 2), stale=False, scraped_at="t")
    return base | kw


LISTING = "vendor_id string, vendor_sku string, url string, title_raw string, price_ils string, in_stock boolean, category_guess string, last_seen date, stale boolean, scraped_at string"


def enriched(spark, *rows):
    return attributes.with_attributes(identity.enrich(spark.createDataFrame([listing(**r) for r in rows], LISTING)))


def test_enrich_identity(spark):
    got = enriched(
        spark,
        dict(vendor_sku="FD-C-POV2A-02", title_raw="Fractal Design Pop", category_guess="cpu:bundle-only"),
        dict(vendor_id="onepc", vendor_sku="x", url="https://v/en/product-77-y", category_guess="cpu:new-pc-deal"),
        dict(vendor_id="ivory", vendor_sku="b", url="https://v/c.php?a=1&id=5", category_guess="case:new-pc-deal"),
        dict(url="https://v/z", category_guess="hdd", title_raw="kingston fury"),
        dict(vendor_sku="1", category_guess="computer cases", title_raw="Thermal Paste MX"),
        dict(vendor_sku="2", category_guess="fans", title_raw="120 mm fan"),
        dict(vendor_sku="3", category_guess="fans", title_raw="plain"),
    ).collect()
    by = {r.listing_key: r for r in got}
    assert set(by) >= {"tms:FD-C-POV2A-02", "1pc:77", "ivory:5", "tms:1", "tms:2", "tms:3"} and len(by) == 7
    assert (by["tms:FD-C-POV2A-02"].mpn, by["tms:FD-C-POV2A-02"].brand, by["tms:FD-C-POV2A-02"].category, by["tms:FD-C-POV2A-02"].bundle_only) == ("FDCPOV2A02", "Fractal Design", "cpu", True)
    assert [by[k].category for k in ("1pc:77", "ivory:5", "tms:1", "tms:2", "tms:3")] == ["other", "case", "thermal_paste", "case_fan", "cooling_other"]
    assert by["1pc:77"].match_text == "x None" and by["1pc:77"].vendor == "1pc"
    assert next(r for r in got if r.title_raw == "kingston fury").brand == "Kingston"


def test_attributes(spark):
    cases = {
        ("cpu", "Intel Core i5-12400F Box"): {"model": "Core I5 1240", "packaging": "Box", "brand": "Intel"},
        ("cpu", "AMD Ryzen 5 7600X Tray AM5"): {"model": "Ryzen 5 7600X", "packaging": "Tray", "socket": "AM5", "brand": "AMD"},
        ("ram", "DDR5 32GB CL30 6000MHz (2x16GB)"): {"total_gb": "532", "memory_type": "DDR5", "cas_latency": "30", "speed_mhz": "6000", "kit": "2x16GB"},
        ("gpu", "RTX 4070 SUPER 12GB GDDR6"): {"gpu_chip": "RTX 4070", "vram_gb": "12", "memory_type": "GDDR6"},
        ("psu", "850W 80 plus gold full modular"): {"wattage_w": "850", "efficiency": "GOLD", "modular": "FULL MODULAR"},
        ("motherboard", "B850 mATX WIFI 6E 2.5G LAN V2"): {"chipset": "B850", "socket": "AM5", "memory_type": "DDR5", "form_factor": "mATX", "wifi": "true", "wifi_standard": "WIFI6E", "lan": "2.5G", "revision": "V2"},
        ("motherboard", "B850MAX board"): {},
        ("case", "Midnight black ATX"): {"form_factor": "ATX", "color": "Black"},
        ("case fans", "120mm ARGB PWM"): {"size_mm": "120", "argb": "true", "pwm": "true"},
        ("hdd", "LGA1700 socket - B760 chipset - DDR5 - WIFI - mATX"): {"socket": "LGA1700", "chipset": "B760", "memory_type": "DDR5", "wifi": "true", "form_factor": "mATX"},
        ("hdd", "AM5 - x"): {},
    }
    rows = [dict(vendor_sku=f"n{k}", category_guess=c, title_raw=t) for k, (c, t) in enumerate(cases)]
    got = {r.vendor_sku: dict(r.attributes) for r in enriched(spark, *rows).collect()}
    assert [got[f"n{k}"] for k in range(len(cases))] == list(cases.values())


def test_meta_and_hebrew(spark):
    meta = json.dumps({"socket": "AM5", "platform": "", "other": 1, "specs": {"Core Count": 8, "": None}, "features": [{"name": "Core Count", "value": 9}, {"name": "Hue!", "value": "red"}, {"name": "x"}]})
    got = values(spark, [meta, None, "not json", "[]"], attributes.meta_map)
    assert got == [{"socket": "AM5", "core_count": "8", "hue": "red"}, {}, {}, {}]
    facts = values(spark, ["8 ליבות 16 תהליכונים 3.5 GHz - 5.1 GHz כולל מאוורר", "1.2.3 GHz - 4 GHz ללא מאוורר", None], attributes.hebrew_facts)
    assert [tuple(f) for f in facts] == [(8, 16, 3.5, 5.1, True), (None, None, None, 4.0, False), (None,) * 5]


def test_dedupe_ranks(spark):
    rows = [dict(vendor_sku="a", price_ils=p, in_stock=s, stale=t, last_seen=dt.date(2024, 1, d), scraped_at=str(k)) for k, (p, s, t, d) in enumerate([(None, True, False, 9), ("5", None, False, 9), ("5", True, True, 9), ("5", True, False, 8), ("5", True, False, 9), ("7", True, False, 9)])]
    for order in (rows, rows[::-1]):
        (best,) = dedupe(identity.enrich(spark.createDataFrame([listing(**r) for r in order], LISTING)), ["scraped_at"]).collect()
        assert best.scraped_at == "4"
    zero = dedupe(identity.enrich(spark.createDataFrame([listing(vendor_sku="a", price_ils=p) for p in ("0", "5")], LISTING)), ["price_ils"]).collect()
    assert zero[0].price == 0


def test_cascade_and_products(spark):
    rows = enriched(
        spark,
        dict(vendor_id="tms", vendor_sku="GV-N1-8G", title_raw="MSI RTX 4070", category_guess="gpu", price_ils="100"),
        dict(vendor_id="plonter", vendor_sku="q1", title_raw="MSI card GV-N1-8G 8GB", category_guess="gpu", price_ils="90", in_stock=True),
        dict(vendor_id="ivory", vendor_sku="ABCDE1", title_raw="antec flux", category_guess="case", price_ils="7"),
        dict(vendor_id="tms", vendor_sku="abcde-1", title_raw="Antec FLUX case black", category_guess="case"),
        dict(vendor_id="tms", vendor_sku="12345", title_raw="thing", category_guess="case"),
        dict(vendor_id="tms", vendor_sku="M1", title_raw="manual", category_guess="cpu"),
    )
    led = spark.createDataFrame([("tms:M1", "cpu:m:1")], "listing_key string, manual_id string")
    got = assign(rows, led)
    by = {r.listing_key: (r.product_id, r.matched_by) for r in got.collect()}
    assert by == {
        "tms:GV-N1-8G": ("mpn:gpu:gvn18g", "mpn"), "plonter:q1": ("mpn:gpu:gvn18g", "mpn"), "ivory:ABCDE1": ("sku:case:abcde1", "sku"), "tms:abcde-1": ("sku:case:abcde1", "sku"),
        "tms:12345": ("case:tms:tms-12345", "singleton"), "tms:M1": ("cpu:m:1", "manual"),
    }
    s = {r.product_id: r for r in products.summarize(got).collect()}
    assert (s["mpn:gpu:gvn18g"].vendor_count, s["mpn:gpu:gvn18g"].mpn, s["sku:case:abcde1"].canonical_name) == (2, "GVN18G", "abcde-1 Antec FLUX case black")
    assert {r.product_id: r.price for r in products.best_offer(got).collect()} == {"mpn:gpu:gvn18g": 90, "sku:case:abcde1": 7}
    assert {(r.product_id, r.key): r.value for r in products.majority(got).collect()}["mpn:gpu:gvn18g", "vram_gb"] == "8"


def test_majority_takes_the_first_seen_of_equals(spark):
    rows = [("p", v, f"{v}:{k}", {"c": c}) for v, k, c in [("b", 1, "Red"), ("a", 1, "Blue"), ("a", 2, "red "), ("c", 1, "blue"), ("d", 1, "green")]]
    df = spark.createDataFrame(rows, "product_id string, vendor string, listing_key string, attributes map<string,string>")
    assert products.majority(df).first().value == "Blue"
    assert products.conflicts(df).first().conflict == "Blue|red |green"


def test_labels(spark):
    def tally(agree, other):
        return spark.createDataFrame([("cuts", "1", "socket", "AM5")] * agree + [("cuts", "1", "socket", "AM4")] * other, "kind string, id string, attr string, value string")

    assert [r.value for r in labels.learn(tally(9, 1)).collect()] == ["AM5"]
    assert labels.learn(tally(8, 2)).count() == 0 and labels.learn(tally(1, 0)).count() == 0
    given = spark.createDataFrame([("cuts", "2", "a", "two"), ("cuts", "10", "a", "ten"), ("cuts", "10", "b", "ten"), ("parents", "2", "category", "x")], "kind string, id string, attr string, value string")
    rows = spark.createDataFrame([("k", [10, 2, 10])], "listing_key string, cuts array<long>")
    assert {(r.attr, r.value) for r in labels.apply(rows, given).collect()} == {("a", "two"), ("b", "ten")}


def test_stock(spark):
    tiles = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "code string")
    rows = [("A&lrm;", "out_of_stock", "#75a74d", 1), ("b", "in_stock", None, 1), ("B ", "on_the_way", "", 2), ("c", None, "black", 1), ("", "in_stock", "", 1)]
    got = stock.with_stock(tiles, spark.createDataFrame(rows, "code string, status string, color string, pos int"), ["pos"])
    assert {r.code: r.in_stock for r in got.collect()} == {"a": True, "b": False, "c": True, "d": None, None: None}


# ------------------------------------------------------------------ fuzzy
def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_token_set_ratio(a, b):
    assert fuzzy._lcs(a, b) == plain_lcs(a, b)
    r = fuzzy.token_set_ratio(a, b)
    assert r == fuzzy.token_set_ratio(b, a) and 0 <= r <= 100
    if set(a.split()) and set(a.split()) <= set(b.split()):
        assert r == 100


def test_token_set_ratio_by_hand():
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.token_set_ratio("", "a") == 0
    # common 'a b', rest 'cd' and 'ce': 100 * (1 - 2 / 12) for the whole, 100 * (1 - 3 / 9) for the parts
    assert fuzzy.token_set_ratio("a b cd", "a b ce") == pytest.approx(100 * (1 - 2 / 12))


def test_score_bound_is_never_below(spark):
    words = ["asus rtx 4070", "asus rtx 4070 ti", "msi rtx", "rtx 4070 asus oc", "b", "asus  rtx", "kitten sitting", "sitting kitten x"]
    pairs = [(a, b) for a, b in itertools.product(words, words)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("bound", fuzzy.score_bound("a", "b"))
    assert all(r.bound >= fuzzy.token_set_ratio(r.a, r.b) - 1e-9 for r in df.collect())


def test_fuzzy_score_query_matches_all_pairs(spark):
    from gristmill.plans.catalog import matched, q_fuzzy_score

    listings = matched(spark, SF)
    rows = fuzzy.with_critical(listings).collect()
    sizes = {}
    for r in rows:
        sizes[r.product_id] = sizes.get(r.product_id, 0) + 1
    want = set()
    for a, b in itertools.combinations(sorted((r for r in rows if r.brand and r.category not in ("other", "")), key=lambda r: (r.vendor, r.listing_key)), 2):
        if (a.category, a.brand) != (b.category, b.brand) or a.product_id == b.product_id or sizes[a.product_id] > 1 and sizes[b.product_id] > 1 or a.mpn and b.mpn and a.mpn != b.mpn:
            continue
        if any(a[c] and b[c] and a[c] != b[c] for c in ("c_ddr", "c_total_gb", "c_speed_mhz", "c_wattage", "c_pack_size")) or a.c_revs and b.c_revs and not set(a.c_revs) & set(b.c_revs):
            continue
        if (score := fuzzy.token_set_ratio(a.match_text, b.match_text)) >= 88:
            want.add((a.listing_key, b.listing_key, int(score)))
    assert {(r.listing_key_a, r.listing_key_b, r.score) for r in fuzzy.score_pairs(fuzzy.candidate_pairs(listings)).collect()} == want and want
    got = q_fuzzy_score(spark, SF).collect()
    assert {r.listing_key for r in got} == {r.listing_key for r in rows if r.brand and r.category not in ("other", "")}
    assert {(r.listing_key, r.links, r.component_id) for r in got} == linked([r.listing_key for r in got], [(a, b) for a, b, _ in want])


def linked(keys, pairs):
    """(key, links, smallest key reached) by a plain loop."""
    near = {k: set() for k in keys}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    first = {}
    for k in sorted(keys):
        todo = [k]
        while todo:
            if (x := todo.pop()) not in first:
                first[x] = k
                todo += near[x]
    return {(k, len(near[k]), first[k]) for k in keys}


@pytest.mark.parametrize("part", [2, 1024])
def test_counted_links_equal_listed_pairs(spark, part):
    """Copies, products of several, unknown and clashing values, shared and clashing revisions, equal and empty words, over many parts and one."""
    texts = ["gear rtx 4070 v1", "gear rtx 4070 v1 v2", "gear rtx 4070 v2", "gear rtx 4070 v3 8gb", "gear rtx 4070 16gb", "kitten sitting on mats", "kitten sitting on matt", "abcdefgh", "abcdefgi", "abcdefgh abcdefgh", "gear 850w pack of 2", "gear 750w 2 pack", " "]
    rows = [(f"p{k % 11 if k % 4 == 0 else k + 100}", "tms", f"tms:{k:03}", ("gpu", "cpu", "other")[k % 7 // 3], "MSI" if k % 13 else None, "t", texts[k * k % len(texts) if k % 2 else k % len(texts)], (None, "A1", "B2")[k % 5 % 3]) for k in range(120)]
    listings = spark.createDataFrame(rows, "product_id string, vendor string, listing_key string, category string, brand string, title_raw string, match_text string, mpn string")
    pairs = fuzzy.candidate_pairs(listings)
    keys = [r[2] for r in rows if r[3] != "other" and r[4]]
    near = [(r.listing_key_a, r.listing_key_b) for r in fuzzy.score_pairs(pairs).collect()]
    every = [(r.listing_key_a, r.listing_key_b) for r in pairs.collect()]
    assert 0 < len(near) < len(every)
    assert {(r.listing_key, r.links, r.component_id) for r in fuzzy.link_counts(listings, fuzzy.THRESHOLD, part).collect()} == linked(keys, near)
    assert {(r.listing_key, r.links) for r in fuzzy.link_counts(listings, part=part).collect()} == {x[:2] for x in linked(keys, every)}


def test_links_are_counted_without_listing_pairs(spark):
    """2,000,000,000 pairs of two texts; joined, they would not end."""
    rows = spark.range(0, 64_000, 1, 4).selectExpr("cast(id as string) as product_id", "'tms' as vendor", "concat('tms:', id) as listing_key", "'gpu' as category", "'MSI' as brand", "if(id % 2 = 0, 'msi rtx 4070', 'msi rtx 4070 ti') as match_text", "cast(null as string) as mpn")
    for threshold in (None, fuzzy.THRESHOLD):
        got = fuzzy.link_counts(rows, threshold).agg(F.min("links"), F.max("links"), F.count("*"), F.countDistinct("class_id"), F.max("class_id")).collect()
        assert [tuple(r) for r in got] == [(63_999, 63_999, 64_000, 1, "tms:0") if threshold is None else (63_999, 63_999, 64_000, 2, "tms:1")]


def test_blocked_pairs(spark):
    rows = assign(enriched(spark, *(dict(vendor_sku=s, title_raw="MSI RTX 4070", category_guess="gpu") for s in ("a1", "b2"))))
    assert fuzzy.candidate_pairs(rows).count() == 1
    bars = spark.createDataFrame([("tms:b2", "tms:a1")], "key_1 string, key_2 string")
    assert fuzzy.candidate_pairs(rows, bars).count() == 0


# ------------------------------------------------------------------ sources and sinks
def test_json_recovery(spark):
    lines = ['﻿{"a":1}', "", '{"a":1}{"a":2}', 'noise {"a":4}', '{"a":1} {bad', '{"a":', '[1,2]', "7", '[1] {"a":3}', None]
    got = values(spark, lines, jsonl.recover_objects)
    assert [len(x) for x in got] == [1, 0, 2, 1, 1, 0, 0, 0, 1, 0]


def test_snapshots(spark, tmp_path):
    today = dt.date(2024, 2, 20)

    def put(day, name, *lines):
        p = tmp_path / str(day)
        p.mkdir(exist_ok=True)
        (p / f"{name}.jsonl").write_text("\n".join(lines), encoding="utf-8")

    put(today - dt.timedelta(14), "tms", '{"vendor_sku":"a","price_ils":7}')
    put(today - dt.timedelta(15), "ivory", '{"vendor_sku":"b"}')
    put(today - dt.timedelta(1), "1pc", '{"vendor_sku":"old"}')
    put(today - dt.timedelta(1), "onepc", '{"vendor_sku":"c"}{"vendor_sku":"d"}')
    put(today, "plonter")
    put(today - dt.timedelta(1), "plonter", '{"vendor_sku":"hidden"}')
    rows, skipped = jsonl.read_snapshots(spark, str(tmp_path), today)
    assert skipped == ["ivory"]
    assert sorted((r.vendor_id, r.vendor_sku, r.price_ils, str(r.last_seen), r.stale) for r in rows.collect()) == [("1pc", "c", None, "2024-02-19", True), ("1pc", "d", None, "2024-02-19", True), ("tms", "a", "7", "2024-02-06", True)]


TILE = """<div class="product-card"><div class="product-card__header"><span class="product-card__model"><a> {sku} </a></span>
<div class="product-card__name"><a href="{href}">T &amp; co</a></div><div class="stickers-product-wrapper">{sticker}</div>
<div class="product-card__price">{price}</div></div><i class="info-storage-button" data-claris-code="{sku}"></i>{more}</div>"""


def test_tiles(spark):
    from gristmill.functions.fixed import BUNDLE_PHRASE

    normal = '<span class="product-card__price-normal">₪ 20,606</span>'
    html = "".join([
        TILE.format(sku="A", href="/a", sticker="", price=normal, more=""), TILE.format(sku="A", href="/a", sticker="", price="", more=""),
        TILE.format(sku="B", href="/b", sticker="New PC 5%", price="<s>₪ 100</s>", more=""), TILE.format(sku="C", href="https://o/c", sticker="", price="<s>₪ 1,100</s> <b>₪ 900</b>", more=f"<p>{BUNDLE_PHRASE}</p>"),
    ])
    pages = spark.createDataFrame([(1, "https://t.example/x", "cpu", html), (2, "https://t.example/y", "cpu", None)], "page int, url string, category_guess string, html string")
    got = {r.vendor_sku: (r.title_raw, r.url, r.price_ils, r.category_guess, r.code) for r in payloads.tile_listings(pages).collect()}
    assert got == {
        "A": ("T & co", "https://t.example/a", 20606, "cpu", "A"), "B": ("T & co", "https://t.example/b", 100, "cpu:new-pc-deal", "B"),
        "C": ("T & co", "https://o/c", 1100, "cpu:bundle-only:new-pc-deal", "C"),
    }


def test_fragments_feed_and_builder(spark):
    html = '<div class="pc-product-item" data-productid="9"><a class="product-link" href="/p-9"></a><span class="product-title" data-price="1148.99998400"> X </span></div><div class="pc-product-item"></div>'
    got = payloads.fragment_listings(spark.createDataFrame([("https://o.example/v", "gpu", html)], "url string, category_guess string, html string")).collect()
    assert [(r.vendor_id, r.vendor_sku, r.title_raw, r.url, r.price_ils) for r in got] == [("1pc", "9", "X", "https://o.example/p-9", 1149)]

    rows = ["head", "s 1\tמעבד\td\tc\tx\ts\t55\tt\ti\t1\t CPUs ", "\tno sku", "s2\tt\td\tc\tx\ts\t5\tt\ti\t1\tCables", "short\trow"]
    raw = "".join(f"<pre>{r}</pre>\r\n" for r in rows).encode("cp1255")
    got = payloads.feed_listings(spark.createDataFrame([(bytearray(raw),), (None,)], "content binary")).collect()
    assert [(r.vendor_sku, r.title_raw, r.price_ils, r.category_guess, r.url) for r in got] == [("s 1", "מעבד", "55", " CPUs ", "https://www.plonter.co.il/detail.tmpl?sku=s%201")]

    one = json.dumps({"Build": {"categories": [{"products": {"itm-1": {"id": 1, "title": "a", "barcode": "x", "price": 5, "cuts": [3, "4"]}, "itm-0": {"title": "no id"}}}, {"products": None}]}})
    two = json.dumps({"Build": {"categories": [{"products": {"itm-1": {"id": 1, "title": "again"}, "itm-2": {"id": 2, "title": "b"}}}]}})
    got = payloads.build_listings(spark.createDataFrame([(1, "cpu", one), (2, "gpu", two), (3, "gpu", "<html>"), (4, "gpu", None)], "request int, category_guess string, json string")).collect()
    assert sorted((r.url[-1], r.title_raw, r.price_ils, r.category_guess) for r in got) == [("1", "a", "5", "cpu"), ("2", "b", None, "gpu")]


def test_ledger(spark, tmp_path):
    path = tmp_path / "l.json"
    path.write_text(json.dumps({"products": [{"product_id": "p", "listing_keys": ["a", "b"]}, {"product_id": "q", "listing_keys": ["b"], "attributes": {"n": 1}}], "blocked_pairs": [["a", "b"], ["x"]]}, indent=1))
    keys, known, blocked = ledger.read_ledger(spark, str(path))
    assert {r.listing_key: r.manual_id for r in keys.collect()} == {"a": "p", "b": "q"}
    assert known.count() == 2 and [tuple(r) for r in blocked.collect()] == [("a", "b")]
    assert all(df.count() == 0 for df in ledger.read_ledger(spark, str(tmp_path / "none.json")))


def test_publish_guards(spark, tmp_path):
    root = str(tmp_path / "out")
    sinks.publish({"listings": spark.range(2), "products": spark.range(1)}, root)
    with pytest.raises(sinks.EmptyResult):
        sinks.publish({"listings": spark.range(0), "products": spark.range(1)}, root)
    assert sinks.read_published(spark, root, "listings").count() == 2
    for n in (3, 4, 5):
        sinks.publish({"listings": spark.range(n), "products": spark.range(1)}, root)
    assert sinks.read_published(spark, root, "listings").count() == 5 and len(list((tmp_path / "out").glob("v-*"))) == 2


def test_raw_snapshots_round_trip(spark, tmp_path):
    root, day = str(tmp_path / "raw"), dt.date(2024, 1, 2)
    rows = [("2024-01-02", v, "s", t) for v, t in (("tms", "a"), ("tms", "b"), ("1pc", "c"))]
    schema = "date string, vendor string, vendor_sku string, title_raw string"
    sinks.write_raw(spark.createDataFrame(rows, schema), root)
    sinks.write_raw(spark.createDataFrame([("2024-01-02", "tms", "s", "new")], schema), root)
    sinks.write_raw(spark.createDataFrame([], schema), root)
    got, skipped = jsonl.read_snapshots(spark, root, day)
    assert {(r.vendor_id, r.title_raw, r.stale) for r in got.collect()} == {("tms", "new", False), ("1pc", "c", False)}
    assert skipped == ["plonter", "ivory"]


def test_label_file(spark, tmp_path):
    at, given = str(tmp_path / "labels.json"), [("cuts", "3", "socket", "AM5"), ("cuts", "3", "wattage_w", "65"), ("parents", "12", "category", "cpu")]
    sinks.write_labels(spark.createDataFrame(given, "kind string, id string, attr string, value string"), at)
    assert json.loads((tmp_path / "labels.json").read_text()) == {"cuts": {"3": {"socket": "AM5", "wattage_w": "65"}}, "parents": {"12": {"category": "cpu"}}}
    assert sorted(map(tuple, sinks.read_labels(spark, at).collect())) == given
    (tmp_path / "broken.json").write_text("{nonsense")
    assert sinks.read_labels(spark, str(tmp_path / "broken.json")).count() == 0 and sinks.read_labels(spark, str(tmp_path / "none.json")).count() == 0


def test_payloads_to_published_tables(spark, tmp_path):
    """All four vendors' payloads, through the build, to tables, documents and the review queue in their order."""
    title, day = "MSI RTX 4070 Ventus 12GB", dt.date(2024, 1, 2)
    tiles = spark.createDataFrame([(1, "https://t.example/x", "gpu", TILE.format(sku="A", href="/a", sticker="", price='<span class="product-card__price-normal">₪ 2,000</span>', more="").replace("T &amp; co", title))], "page int, url string, category_guess string, html string")
    answers = payloads.availability_rows(spark.createDataFrame([(1, '{"productsData":[{"Code":"a","AvailabilityStatus":"in_stock"}]}'), (2, "<html>"), (3, None)], "request int, json string"))
    html = f'<div class="pc-product-item" data-productid="9"><a class="product-link" href="/product-9"></a><span class="product-title" data-price="1900.4"> {title} OC </span></div>'
    items = spark.createDataFrame([("192", "https://o.example/v", html)], "seed string, url string, html string")
    feed = spark.createDataFrame([(bytearray(f"<pre>h</pre><pre>s1\t{title} X\td\tc\tx\ts\t1800\tt\ti\t1\tDisplay Adapters</pre>".encode("cp1255")),)], "content binary")
    build = spark.createDataFrame([(1, "gpu", json.dumps({"Build": {"categories": [{"products": {"a": {"id": 5, "title": title, "price": 1700, "parent": 12, "cuts": [7, 3]}}}]}}))], "request int, category_guess string, json string")
    sources = [payloads.tile_listings(tiles, availability=answers), payloads.fragment_listings(payloads.guessed(items, "1pc")), payloads.feed_listings(feed), payloads.build_listings(build)]
    raw = payloads.as_snapshot(sources[0], day)
    for s in sources[1:]:
        raw = raw.unionByName(payloads.as_snapshot(s, day))
    built = build_catalog(raw, work=str(tmp_path / "work"))
    sinks.publish(built, str(tmp_path / "out"))
    listings = {r.listing_key: r for r in sinks.read_published(spark, str(tmp_path / "out"), "listings").collect()}
    assert {k: (r.price, r.in_stock, r.category) for k, r in listings.items()} == {"tms:A": (2000, True, "gpu"), "1pc:9": (1900, True, "gpu"), "plonter:s1": (1800, True, "gpu"), "ivory:5": (1700, True, "gpu")}
    assert listings["ivory:5"].attributes["ivory_cuts"] == "[3,7]" and listings["ivory:5"].attributes["ivory_parent"] == "12"
    sinks.export_document(built, ["none"], str(tmp_path / "catalog.json"))
    document = json.loads((tmp_path / "catalog.json").read_text())
    assert list(document) == ["generated_at", "listings", "products", "review_queue_count", "skipped_vendors"] and document["skipped_vendors"] == ["none"]
    assert [x["listing_key"] for x in document["listings"]] == ["1pc:9", "ivory:5", "plonter:s1", "tms:A"] and [x["product_id"] for x in document["products"]] == sorted(listings[k].product_id for k in listings)
    sinks.export_review(built["review"], str(tmp_path / "review.json"))
    review = json.loads((tmp_path / "review.json").read_text())
    assert len(review) == document["review_queue_count"] > 1 and [x["score"] for x in review] == sorted((x["score"] for x in review), reverse=True)
    assert all(title in x["title_a"] and title in x["title_b"] for x in review)
    sinks.export_review(built["review"].where("score > 1000"), str(tmp_path / "review.json"))
    assert json.loads((tmp_path / "review.json").read_text()) == []


def test_build_catalog(spark):
    raw = spark.createDataFrame([listing(vendor_id=v, vendor_sku=s, title_raw=t, category_guess="gpu", price_ils="5") for v, s, t in [("tms", "GV-N1-8G", "MSI RTX 4070"), ("onepc", "2", "MSI RTX 4070 GV-N1-8G"), ("ivory", "zz9", "MSI RTX 4070 ti")]], LISTING)
    got = build_catalog(raw)
    rows = got["listings"].collect()
    assert len(rows) == 3 and got["products"].count() == 2 and got["offers"].count() == 3
    assert sum(r.listings for r in got["products"].collect()) == 3
    product = {r.listing_key: r.product_id for r in rows}
    assert all(product[r.listing_key_a] != product[r.listing_key_b] for r in got["review"].collect())


def test_stream_keeps_the_best(spark, tmp_path):
    from gristmill.streaming.listings import keep_best, listing_stream

    source = tmp_path / "in"
    source.mkdir()
    for k, price in enumerate((9, 5, 7)):
        (source / f"{k}.json").write_text(json.dumps({"vendor_id": "tms", "vendor_sku": "a", "price_ils": price, "scraped_at": str(k)}))
        q = keep_best(listing_stream(spark, str(source)), str(tmp_path / "t"), str(tmp_path / "c"))
        q.awaitTermination()
    assert [r.price for r in spark.read.parquet(str(tmp_path / "t" / "v=2")).collect()] == [5]


def test_daily_counts_stream(spark, tmp_path):
    from gristmill.streaming.listings import daily_counts

    spark.createDataFrame([(dt.datetime(2024, 1, d, 3), v) for d, v in ((1, "a"), (1, "a"), (2, "b"), (9, "a"))], "ts timestamp, vendor string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, vendor string").parquet(str(tmp_path / "e"))
    q = daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.day.day, r.vendor, r.n) for r in spark.table("daily").collect()) == [(1, "a", 2), (2, "b", 1), (9, "a", 1)]


def test_vendor_data_and_two_passes(spark):
    meta = [{"socket": "AM4", "description": "8 ליבות Ryzen 5 5600X Tray", "cuts": [7, "3", "x", 7], "parent": 12}, {"cuts": [3], "parent": "0"}, {"cuts": ["3"]}]
    rows = [listing(vendor_id="ivory", vendor_sku=f"s{k}", category_guess="cpu", title_raw="cpu") | {"vendor_meta": json.dumps(m)} for k, m in enumerate(meta)]
    raw = spark.createDataFrame(rows, LISTING + ", vendor_meta string")
    got = {r.vendor_sku: r for r in build_catalog(raw, score=False)["listings"].collect()}
    builder = {k: dict(r.attributes) for k, r in got.items()}
    assert (builder["s0"].pop("ivory_cuts"), builder["s0"].pop("ivory_parent"), builder["s1"]) == ("[3,7,7]", "12", {"ivory_cuts": "[3]"})
    assert builder["s0"] == {"socket": "AM4", "packaging": "Tray", "brand": "AMD", "model": "Ryzen 5 5600X", "cores": "8"}
    assert (got["s0"].cuts, got["s0"].parent, got["s1"].parent) == ([3, 7, 7], "12", None)
    learnt = labels.learn(labels.tallies(build_catalog(raw, score=False)["listings"], ("socket", "packaging")))
    assert {(r.kind, r.id, r.attr, r.value) for r in learnt.collect()} == {("cuts", "7", "socket", "AM4"), ("cuts", "7", "packaging", "Tray")}
    given = spark.createDataFrame([("cuts", "3", "socket", "AM5"), ("parents", "12", "category", "cpu")], "kind string, id string, attr string, value string")
    again = {r.vendor_sku: dict(r.attributes) for r in build_catalog(raw, learnt=given, score=False)["listings"].collect()}
    assert again["s1"] == {"socket": "AM5", "ivory_cuts": "[3]"} and again["s0"]["socket"] == "AM4" and again["s0"]["ivory_category"] == "cpu"


def test_ledger_overrides(spark):
    from gristmill.plans.catalog import with_ledger

    raw = spark.createDataFrame([listing(vendor_sku="a", title_raw="MSI RTX 4070 12GB", category_guess="gpu"), listing(vendor_sku="b", title_raw="x", category_guess="gpu")], LISTING)
    led = spark.createDataFrame([("tms:a", "p")], "listing_key string, manual_id string")
    known = spark.createDataFrame([("p", "Name", None, "B", "M", {"vram_gb": "16", "n": "1"}), ("gone", "x", None, None, None, {"n": "1"})], "product_id string, canonical_name string, category string, brand string, model string, attributes map<string,string>")
    built = build_catalog(raw, led, score=False)
    summary, merged = with_ledger(built["products"], built["attributes"], known)
    assert {r.product_id: (r.canonical_name, r.category, r.brand, r.model) for r in summary.collect()}["p"] == ("Name", "gpu", "B", "M")
    assert {r.key: r.value for r in merged.where("product_id = 'p'").collect()} == {"vram_gb": "16", "n": "1", "gpu_chip": "RTX 4070"}
    assert merged.where("product_id = 'gone'").count() == 0
    row = sinks.run_summary(built, ["ivory"]).first()
    assert (row.listings, row.products, row.review_queue_count, row.skipped_vendors) == (2, 2, 0, ["ivory"])

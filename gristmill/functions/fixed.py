"""Values that results depend on: aliases, patterns and word lists of the catalogue's domain."""

# Vendor category names, compacted, and the categories they mean.
CATEGORY_OF = {
    "motherboard": "motherboard", "motherboards": "motherboard",
    "case": "case", "cases": "case", "computercase": "case", "computercases": "case",
    "memory": "memory", "ram": "memory",
    "cpu": "cpu", "cpus": "cpu",
    "gpu": "gpu", "displayadapter": "gpu", "displayadapters": "gpu", "graphicscard": "gpu",
    "psu": "psu", "powersupply": "psu", "powersupplies": "psu",
    "casefan": "case_fan", "casefans": "case_fan",
    "liquidcooling": "aio", "aio": "aio",
    "fansandcoolingsolutions": "cooling", "fans": "cooling", "fan": "cooling", "cooling": "cooling",
    "thermalpaste": "thermal_paste",
    "storage": "storage", "harddrives": "storage", "ssd": "storage",
}
ACCESSORIES = ("thermal_paste", "fan_controller", "rgb_lighting", "cooler_accessory")

# Brand aliases in order of precedence among equally long ones.
BRAND_OF = {
    "asus": "ASUS", "gigabyte": "Gigabyte", "msi": "MSI", "asrock": "ASRock", "sapphire": "Sapphire",
    "maxsun": "MAXSUN", "afox": "AFOX", "zotac": "ZOTAC", "intel": "Intel", "amd": "AMD",
    "fractal design": "Fractal Design", "fractal": "Fractal Design", "lian li": "Lian Li", "lian-li": "Lian Li",
    "corsair": "Corsair", "be quiet": "be quiet!", "arctic": "Arctic", "noctua": "Noctua",
    "cooler master": "Cooler Master", "coolermaster": "Cooler Master", "deepcool": "Deepcool", "zalman": "Zalman",
    "gamdias": "GAMDIAS", "antec": "Antec", "istarusa": "iStarUSA", "supermicro": "Supermicro",
    "silverstone": "SilverStone", "havn": "HAVN", "cougar": "Cougar", "1stplayer": "1stPlayer", "nzxt": "NZXT",
    "thermaltake": "Thermaltake", "ivory": "Ivory",
    "kingston": "Kingston", "fury": "Kingston Fury", "patriot": "Patriot", "viper": "Patriot Viper", "g.skill": "G.Skill",
    "seasonic": "Seasonic", "fsp": "FSP",
}

# Part number patterns, in order of precedence among equally long finds.
PART_NUMBERS = (
    r"90MB[A-Z0-9-]+", r"90YV[A-Z0-9-]+",
    r"CO-90\d{5}-WW", r"CC-90\d{5}-WW", r"CL-90\d{5}-WW", r"CT-90\d{5}-WW",
    r"GV-[A-Z0-9-]+", r"KF[0-9A-Z-]+", r"CMK[0-9A-Z-]+", r"FD-C-[A-Z0-9-]+",
    r"MAZ-[A-Z0-9-]+", r"MAP-[A-Z0-9-]+", r"MCM-[A-Z0-9-]+", r"MB\d{3}-[A-Z0-9-]+",
    r"BW\d{2,3}", r"BK\d{2,3}", r"BGW\d{2,3}",
    r"100-\d{8,}[A-Z]*", r"0-761345-\d{5}-\d", r"\b\d{12,14}\b",
)

# Chipsets with their socket and memory type (None: it depends on the board).
CHIPSETS = {
    "A320": ("AM4", "DDR4"), "B450": ("AM4", "DDR4"), "X470": ("AM4", "DDR4"),
    "A520": ("AM4", "DDR4"), "B550": ("AM4", "DDR4"), "X570": ("AM4", "DDR4"),
    "A620": ("AM5", "DDR5"), "B650": ("AM5", "DDR5"), "X670": ("AM5", "DDR5"),
    "X670E": ("AM5", "DDR5"), "X870": ("AM5", "DDR5"), "X870E": ("AM5", "DDR5"),
    "B840": ("AM5", "DDR5"), "B850": ("AM5", "DDR5"),
    "H610": ("LGA1700", None), "B660": ("LGA1700", None), "H670": ("LGA1700", None),
    "Z690": ("LGA1700", None), "B760": ("LGA1700", None), "H770": ("LGA1700", None), "Z790": ("LGA1700", None),
    "H810": ("LGA1851", "DDR5"), "B860": ("LGA1851", "DDR5"), "Z890": ("LGA1851", "DDR5"),
    "X299": ("LGA2066", "DDR4"), "Z390": ("LGA1151", "DDR4"),
}
CHIPSET = r"(?i)\b(X670E|X870E|X870|X670|X570|X470|X299|B850|B840|B860|B760|B660|B650|B550|B450|A620|A520|A320|Z890|Z790|Z690|Z390|H810|H770|H670|H610|H310)([A-Z]?)\b"

# Patterns of technical attributes.
SOCKET = r"(?i)\b(LGA\s?\d{3,4}|sWRX8|SP3|TR4|AM[45])\b"
SOCKET_NUMBER = r"\b(1700|1851|1200|1151|1150|1155|1366|2066)\b"
DDR = r"(?i)\bDDR\s?([345])\b"
WIFI_STANDARD = r"(?i)\bWIFI\s?([67])\s?(E)?\b"
WIFI = r"(?i)\bWIFI\b|\bWI-?FI\b|\bWIRELESS\b"
FORM_FACTORS = (
    (r"(?i)\bMINI\s?[- ]?ITX\b|\bITX\b", "Mini-ITX"),
    (r"(?i)\bMICRO\s?[- ]?ATX\b|\bM\s?[- ]?ATX\b|\bMATX\b", "mATX"),
    (r"(?i)\bE\s?[- ]?ATX\b|\bEEB\b", "EATX"),
    (r"(?i)\bATX\b", "ATX"),
)
LAN = r"(?i)\b(\d+(?:\.\d+)?)\s?G\s?LAN\b"
MEMORY_SLOTS = r"(?i)\b(\d)\s?X\s?DDR[345]\b"
AMD_CPU = r"(?i)\bRYZEN\s?(\d)\s?(\d{4}[A-Z0-9]*)"
INTEL_CPU = r"(?i)\bCORE\s?(ULTRA\s?\d|I\d)[\s-]?(\d{3,4}[A-Z]{0,4}(?:\s?PLUS)?)"
XEON_CPU = r"(?i)\bXEON\s?([A-Z]{1,3}\s?\d{4}[A-Z]?)"
GPU_CHIP = r"(?i)\b(GEFORCE\s?RTX\s?\d{4}(?:\s?TI)?|RTX\s?PRO\s?\d{4}[A-Z]?|RTX\s?\d{4}(?:\s?TI)?|RX\s?\d{4}(?:\s?XT|\s?GRE)?|QUADRO\s?[A-Z0-9]+|FIREPRO\s?[A-Z0-9]+|ARC\s?PRO\s?[A-Z]\d+|ARC\s?[A-Z]\d{2,3})\b"
VRAM = r"\b(\d{1,2})\s?GB\b"
GDDR = r"(?i)\bGDDR([67])\b"
WATTS = r"\b(\d{3,4})\s?W\b"
EFFICIENCY = r"(?i)80\s?PLUS\s?(TITANIUM|PLATINUM|GOLD|SILVER|BRONZE|WHITE)"
MODULAR = r"(?i)\b(FULL\s?MODULAR|SEMI\s?MODULAR|NON\s?MODULAR|MODULAR)\b"
KIT = r"(?i)\((\d)\s?X\s?(\d{1,3})\s?(?:GB)?\)"
SPEED = r"(?i)\b(\d{4})\s?MHZ\b"
LATENCY = r"(?i)\bCL\s?(\d{2})\b"
SIZE_MM = r"(?i)\b(80|92|120|140|170|200|240|280|360|420)\s?MM\b"
COLORS = ("black", "white", "silver", "gray", "grey", "charcoal", "blue", "midnight", "red", "pink", "purple", "brown")

# Specifications in Hebrew prose.
HEBREW_CORES = r"(\d+)\s*ליבות"
HEBREW_THREADS = r"(\d+)\s*תהליכונים"
HEBREW_CLOCK = r"([\d.]+)\s*GHz\s*-\s*([\d.]+)\s*GHz"
HEBREW_COOLER = r"כולל\s*מאוורר"
HEBREW_NO_COOLER = r"ללא\s*מאוורר|בלי\s*מאוורר"

# Keys of vendors' structured data.
META_SCALARS = ("socket", "chipset", "form_factor", "memory_type", "wifi", "wattage_w", "efficiency", "vram_gb", "platform", "co_dependant", "build_computer_global_categories_id")
META_BLOCKS = ("specs", "spec", "features", "compatibility", "data", "details")
LABEL_KEYS = ("socket", "chipset", "memory_type", "form_factor", "packaging", "wifi_standard", "efficiency", "vram_gb", "wattage_w", "size_mm")

# Vendors and payload markers.
VENDORS = ("tms", "onepc", "plonter", "ivory")
VENDOR_FILES = {"onepc": ("onepc", "1pc")}
VENDOR_RANK = {"tms": 0, "1pc": 1, "ivory": 2, "plonter": 3}
BUNDLE_PHRASE = "זמין לרכישה כחלק ממערכת מחשב שלמה בלבד"
DEAL_PHRASES = ("New PC", "הנחת")
BLACKS = ("#000000", "#000", "black", "rgb(0, 0, 0)", "rgb(0,0,0)")
FEED_COLUMNS = ("sku", "title", "description", "category", "division", "shelf", "price_total", "tree", "image_file", "amount", "engdivision")
FEED_DIVISIONS = ("hard drives", "motherboards", "cpus", "fans and cooling solutions", "liquid cooling", "computer cases", "memory", "display adapters", "power supply", "power supplies")

# The categories that vendors' payloads are fetched by: names (repeats stand for several pages), ids, and names with platform and parent.
TILE_CATEGORIES = ("cpu", "gpu", "gpu", "gpu", "gpu", "motherboard", "psu", "psu", "ram", "ram", "ssd", "hdd", "cpu cooler", "case fans", "case", "case")
FRAGMENT_CATEGORIES = {158: "cpu", 429: "cpu_cooling", 167: "motherboard", 45: "memory", 118: "case", 88: "psu", 428: "case_fans", 192: "gpu", 358: "ssd", 356: "harddrive"}
BUILDER_CATEGORIES = (
    ("cpu", "intel", 2674), ("cpu", "amd", 2675), ("motherboard", "intel", 2653), ("motherboard", "amd", 2676), ("cpu_cooler_air", "intel", 6083), ("cpu_cooler_aio", "intel", 11656),
    ("ram", "intel", 2649), ("ssd", "intel", 2672), ("hdd", "intel", 2720), ("gpu", "intel", 2652), ("psu", "intel", 5347), ("case", "intel", 2628), ("case_fans", "intel", 6084),
)

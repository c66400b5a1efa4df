"""Scalar functions on columns: cleaning, keys, areas, points, dates, ids, query heuristics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width and typographic marks, what stands for them, and words that mean "no value".
MARKS_FROM = "‘’“”–—，！？：；．"
MARKS_TO = "''\"\"--,!?:;."
PLACEHOLDERS = ("nan", "null", "none", "-", "n/a", "na", "ไม่ระบุ")
NOT_GIVEN = "ไม่ระบุ"

# Section keywords of queries.
SECTION_KEYWORDS = {
    "location": ("ที่ตั้ง", "location", "province", "จังหวัด", "อำเภอ", "district", "ตำบล", "subdistrict"),
    "geolocation": ("พิกัด", "coordinates", "ลองจิจูด", "longitude", "ละติจูด", "latitude", "maps"),
    "deed_info": ("โฉนด", "deed", "เลขที่", "number", "ประเภท", "type", "เล่ม", "book", "หน้า", "page"),
    "area_measurements": ("ขนาด", "size", "area", "เนื้อที่", "ไร่", "rai", "งาน", "ngan", "ตารางวา", "wa"),
    "classification": ("หมวดหมู่", "category", "ประเภท", "type", "classification"),
    "dates": ("วันที่", "date", "เมื่อไหร่", "when", "ได้มา", "received"),
    "financial": ("ราคา", "price", "value", "มูลค่า", "การเงิน", "financial"),
}
#: Kinds of query and the sections that each one is about.
TARGET_SECTIONS = {
    ("ที่ตั้ง", "location", "จังหวัด", "อำเภอ"): ("location", "geolocation"),
    ("ขนาด", "size", "area", "ไร่"): ("area_measurements",),
    ("โฉนด", "deed"): ("deed_info",),
    ("พิกัด", "coordinates"): ("geolocation",),
    ("ประเภท", "type", "category"): ("classification", "land_details"),
    ("วันที่", "date"): ("dates",),
}

# Words whose presence counts towards a query's complexity, with their weights.
COMPLEXITY = (
    (2, ("and", "or", "also", "additionally")),
    (1, ("what", "how", "why", "when", "where", "which", "who")),
    (3, ("compare", "contrast", "difference", "versus", "vs")),
    (2, ("before", "after", "during", "timeline", "history")),
    (2, ("how many", "count", "number", "percentage", "rate")),
)
# Engine by keyword, the first that holds; the last is the default.
ENGINES = (
    (("filter", "specific", "type", "category"), "metadata_filtering"),
    (("document", "summary", "overview"), "document_summary"),
    (("detailed", "specific", "exact"), "recursive"),
    (("search", "find", "keyword"), "hybrid_search"),
    ((), "basic"),
)
# Provinces and deed terms that the heuristic planner knows.
PLANNER_PROVINCES = ("กรุงเทพ", "สมุทรปราการ", "นนทบุรี", "ปทุมธานี")
DEED_TERMS = ("โฉนด", "นส.3", "นส.4", "ส.ค.1")
# Square metres in a rai, a ngan and a square wa.
SQM_RAI, SQM_NGAN, SQM_WA = 1600, 400, 4
# Price of a thousand prompt and completion tokens.
PROMPT_PRICE, COMPLETION_PRICE = 0.00015, 0.0006


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def strip(c: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def clean_value(c: Column) -> Column:
    """Trimmed, marks normalised, white space collapsed; null for what means "no value"."""
    v = F.regexp_replace(F.translate(strip(c), MARKS_FROM, MARKS_TO), r"[\s\x{00A0}]+", " ")
    return F.when((v != "") & ~F.lower(v).isin(*PLACEHOLDERS), v)


def normalize_key(c: Column) -> Column:
    """Lower case, other characters as single underscores."""
    v = F.regexp_replace(F.lower(c), "[^a-zA-Z0-9ก-๙]+", "_")
    return F.regexp_replace(F.regexp_replace(v, "_+", "_"), "^_+|_+$", "")


def number_text(c: Column) -> Column:
    """A number without a needless fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def area_display(rai: Column, ngan: Column, wa: Column) -> Column:
    """The parts that are not zero, with their units."""
    parts = [F.when(c.isNotNull() & (c != 0), F.concat(number_text(c), F.lit(f" {unit}"))) for c, unit in ((rai, "ไร่"), (ngan, "งาน"), (wa, "ตร.ว."))]
    text = F.concat_ws(" ", *parts)
    return F.when(text == "", NOT_GIVEN).otherwise(text)


def area_sqm(rai: Column, ngan: Column, wa: Column) -> Column:
    zero = F.lit(0.0)
    return (F.coalesce(rai, zero) * SQM_RAI + F.coalesce(ngan, zero) * SQM_NGAN + F.coalesce(wa, zero) * SQM_WA).cast("double")


def in_bounds(lon: Column, lat: Column) -> Column:
    """Z48."""
    return lon.between(0, 180) & lat.between(0, 90)


def parse_point(c: Column) -> Column:
    """struct<longitude, latitude>, or null. POINT(lon lat), else a pair as lat lon, else as lon lat."""
    number = r"([-+]?\d*\.?\d+)"
    point = rf"(?i)POINT\s*\(\s*{number}\s*(?:,|\s)\s*{number}\s*\)"
    pair = rf"^\s*{number}\s*(?:,|\s)\s*{number}\s*$"
    part = lambda pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("double")
    pair_of = lambda lon, lat: F.when(in_bounds(lon, lat), F.struct(lon.alias("longitude"), lat.alias("latitude")))
    a, b = part(pair, 1), part(pair, 2)
    return F.when(c.rlike(point), pair_of(part(point, 1), part(point, 2))).otherwise(F.coalesce(pair_of(b, a), pair_of(a, b)))


def format_coordinates(lon: Column, lat: Column) -> Column:
    """X8."""
    return F.format_string("%.6f, %.6f", lat, lon)


def maps_url(lon: Column, lat: Column) -> Column:
    return F.format_string("https://www.google.com/maps?q=%.6f,%.6f", lat, lon)


def area_from_text(c: Column) -> Column:
    """The first number of rai in a text."""
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)\s*ไร่", 1), F.lit("")).try_cast("double")


def query_sections(c: Column) -> Column:
    """key_info, then each section of which a keyword occurs."""
    low = F.lower(c)
    return F.array_compact(F.array(F.lit("key_info"), *[F.when(has_any(low, w), F.lit(s)) for s, w in SECTION_KEYWORDS.items()]))


def target_sections(c: Column) -> Column:
    """X11: the sections that a query's kinds are about, as a sorted set."""
    low = F.lower(c)
    found = [F.when(has_any(low, w), F.lit(s)) for w, sections in TARGET_SECTIONS.items() for s in sections]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit("key_info"), *found))))


def complexity(c: Column) -> Column:
    """Weighted number of the listed words that occur, plus a tenth of the number of words."""
    low = F.lower(c)
    hits = F.lit(0)
    for weight, words in COMPLEXITY:
        for w in words:
            hits = hits + F.when(low.contains(w), weight).otherwise(0)
    words = F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    return F.round(hits + words / F.lit(10.0), 4)


def complexity_level(score: Column) -> Column:
    return F.when(score <= 2, "simple").when(score <= 6, "moderate").otherwise("complex")


def engine_for(c: Column, engines: tuple[str, ...] | None = None) -> Column:
    """The first available engine with a matching keyword, else basic, else the first."""
    low, out = F.lower(c), None
    for words, name in ENGINES:
        if engines is not None and name not in engines:
            continue
        hit = has_any(low, words) if words else F.lit(True)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    fallback = F.lit(engines[0] if engines else "basic")
    return fallback if out is None else out.otherwise(fallback)


def cache_key(query: Column, strategy: Column, k: Column, index: Column) -> Column:
    """X14."""
    return F.md5(F.concat_ws("|", F.lower(strip(query)), strategy, k.cast("string"), index))


def json_answer(c: Column) -> Column:
    """An answer without the fences that a model puts round JSON."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?", ""), r"```\s*$", ""))


def sub_queries(c: Column) -> Column:
    """The query, one on its province, and one on deed types unless it names one; three at most."""
    province = F.coalesce(*[F.when(c.contains(p), F.lit(f"ที่ดินใน{p}")) for p in PLANNER_PROVINCES])
    deed = F.when(~has_any(c, DEED_TERMS), F.lit("ประเภทโฉนดที่ดิน"))
    return F.slice(F.array_compact(F.array(c, province, deed)), 1, 3)


def token_cost(prompt: Column, completion: Column) -> Column:
    """A12."""
    return prompt / 1000 * PROMPT_PRICE + completion / 1000 * COMPLETION_PRICE


def buddhist_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose year may be of the Buddhist era; null if there is no such day."""
    y = F.when(year > 2500, year - 543).otherwise(year)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def content_id(text: Column, *parts: Column) -> Column:
    """The first 16 digits of the md5 of a text and what goes with it."""
    return F.substring(F.md5(F.concat_ws("\x1f", text, *parts)), 1, 16)

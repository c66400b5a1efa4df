"""Rows to typed metadata and documents, metadata out of texts, categories, titles and ids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslode.functions.values import area_display, area_sqm, clean_value, format_coordinates, has_any, maps_url, parse_point

TRUE_WORDS = ("true", "1", "yes", "y")
# Label of each deed field that texts hold as "Label: value", and the characters a value may have.
LINE, NUMBER, DATE, DIGITS = r"([^\n]+)", r"([0-9.]+)", r"([0-9-]+)", r"([0-9]+)"
DEED_LINES = (
    "Deed Serial No", "Deed Type", "Deed Book No", "Deed Page No", "Deed Surface No", "Deed Holding Type", "Deed Group Type",
    "Province", "District", "Country", "Region", "Location Hierarchy", "Land Name", "Land Passport", "Land Main Category", "Land Sub Category", "Is Condo",
    "Doc Id", "Deed Id", "Land Id", "Land Code", "Deed No", "Deed Ravang", "Land Geom Point", "Search Text", "Source", "Created At", "Doc Type", "Config Name",
)
DEED_NUMBERS = (
    "Deed Rai", "Deed Ngan", "Deed Wa", "Deed Total Square Wa", "Deed Square Meter", "Land Rai", "Land Ngan", "Land Wa", "Land Total Square Wa",
    "Land Sum Rai", "Land Sum Ngan", "Land Sum Wa", "Land Sum Total Square Wa",
)
DEED_DATES = ("Owner Date", "Transfer Date", "Receive Date")
# Fields of candidate profiles.
PROFILE_TEXT = {
    "age_group": "Age", "province": "Province", "region": "Region", "major": "Major", "degree": "Degree", "institute": "Institute",
    "education_level": "Education Level", "position": "Position", "industry": "Industry", "experience": "Experience", "company": "Company",
    "job_family": "Job Family", "currency": "Currency",
}
PROFILE_NUMBERS = {"salary": "Salary", "bonus": "Bonus"}

# Content labels and the strings that tell them.
DEED_CONTENT = {
    "land_deed": ("โฉนด", "deed", "land deed"),
    "land_property": ("ที่ดิน", "land", "property"),
    "ownership": ("กรรมสิทธิ์", "ownership"),
    "location": ("จังหวัด", "province", "อำเภอ", "district"),
    "area_measurement": ("ไร่", "งาน", "ตารางวา", "rai", "ngan", "wa"),
    "agricultural": ("agricultural", "ทำนา", "ทำสวน", "ทำไร่"),
}
PROFILE_CONTENT = {
    "education": ("education", "degree", "major", "institute"),
    "career": ("position", "company", "industry", "experience"),
    "compensation": ("salary", "bonus", "compensation"),
    "demographics": ("age", "province", "region"),
    "assessment": ("assessment", "test", "score"),
}
# Categories by the strings in a field, the first that occurs.
DEED_TYPES = (("โฉนด", "chanote"), ("น.ส.3", "nor_sor_3"), ("น.ส.4", "nor_sor_4"), ("ส.ค.1", "sor_kor_1"))
REGIONS = (("กลาง", "central"), ("เหนือ", "north"), ("ตะวันออก", "east"), ("ใต้", "south"))
LAND_USES = (("agricultural", "agricultural"), ("residential", "residential"), ("commercial", "commercial"), ("industrial", "industrial"))
OWNERS = (("บริษัท", "corporate"), ("company", "corporate"), ("บุคคล", "individual"), ("individual", "individual"))
AREAS = ((400, "small"), (1600, "medium"), (4000, "large"))
SALARIES = ((20_000, "under_20k"), (30_000, "20k_30k"), (50_000, "30k_50k"), (80_000, "50k_80k"))
EXPERIENCE = (("fresh", "entry"), ("0-1", "entry"), ("1-3", "junior"), ("2-3", "junior"), ("3-5", "mid"), ("5-10", "mid"), ("10+", "senior"), ("senior", "senior"))
EDUCATION = (
    ("ปริญญาตรี", "bachelor"), ("bachelor", "bachelor"), ("ปริญญาโท", "master"), ("master", "master"), ("mba", "master"),
    ("ปริญญาเอก", "doctorate"), ("phd", "doctorate"), ("doctorate", "doctorate"),
)
CITIES = (("กรุงเทพ", "bangkok"), ("bangkok", "bangkok"), ("สมุทร", "greater_bangkok"))
# Titles of the sections of a rendered document, in their order, by field type.
SECTION_TITLES = {
    "deed_info": "ข้อมูลโฉนด (Deed Information)",
    "location": "ที่ตั้ง (Location)",
    "geolocation": "พิกัดภูมิศาสตร์ (Geolocation)",
    "land_details": "รายละเอียดที่ดิน (Land Details)",
    "area_measurements": "ขนาดพื้นที่ (Area Measurements)",
    "classification": "การจำแนกประเภท (Classification)",
    "dates": "วันที่สำคัญ (Important Dates)",
    "financial": "ข้อมูลการเงิน (Financial Information)",
    "additional": "ข้อมูลเพิ่มเติม (Additional Information)",
}


@dataclass(frozen=True)
class Mapping:
    """Which column, under which names, becomes which metadata key."""

    column: str
    key: str
    field_type: str = "other"
    data_type: str = "string"
    aliases: tuple[str, ...] = ()
    required: bool = False


@dataclass
class Config:
    name: str
    mappings: list[Mapping]
    description: str = ""
    embedding_fields: list[str] = field(default_factory=list)


def typed(c: Column, data_type: str) -> Column:
    """Cleaned; a date as yyyy-MM-dd where it can be read, a boolean from its word."""
    v = clean_value(c.cast("string"))
    if data_type == "date":
        return F.coalesce(F.date_format(F.try_to_timestamp(v), "yyyy-MM-dd"), v)
    if data_type == "boolean":
        return F.lower(v).isin(*TRUE_WORDS)
    if data_type in ("numeric", "integer"):
        return v.try_cast("double" if data_type == "numeric" else "long")
    return v


def map_columns(df: DataFrame, config: Config) -> DataFrame:
    """One column per mapping, from the first of its names that the table has and that is not null."""
    out = []
    for m in config.mappings:
        names = [n for n in (m.column, *m.aliases) if n in df.columns]
        out.append((F.coalesce(*[typed(F.col(f"`{n}`"), m.data_type) for n in names]) if names else F.lit(None).cast("string")).alias(m.key))
    return df.select(*out)


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def computed(df: DataFrame) -> DataFrame:
    """P5: location_hierarchy, coordinates, area_formatted, area_total_sqm and search_text."""
    places = [F.nullif(_has(df, n).cast("string"), F.lit("")) for n in ("province", "district", "subdistrict")]
    number = lambda n: _has(df, n).try_cast("double")
    rai, ngan, wa = number("area_rai"), number("area_ngan"), number("area_wa")
    any_area = F.greatest(F.coalesce(rai, F.lit(0)), F.coalesce(ngan, F.lit(0)), F.coalesce(wa, F.lit(0))) > 0
    point = parse_point(_has(df, "land_geom_point").cast("string"))
    df = df.withColumn("location_hierarchy", F.nullif(F.concat_ws(" > ", *places), F.lit("")))
    df = df.withColumn("__p", point)
    df = df.withColumn("longitude", F.col("__p.longitude")).withColumn("latitude", F.col("__p.latitude")).drop("__p")
    df = df.withColumn("coordinates_formatted", format_coordinates(F.col("longitude"), F.col("latitude")))
    df = df.withColumn("coordinates_formatted", F.when(F.col("longitude").isNotNull(), F.col("coordinates_formatted")))
    df = df.withColumn("maps_url", F.when(F.col("longitude").isNotNull(), maps_url(F.col("longitude"), F.col("latitude"))))
    df = df.withColumn("area_formatted", F.when(any_area, area_display(rai, ngan, wa)))
    df = df.withColumn("area_total_sqm", F.when(any_area, area_sqm(rai, ngan, wa)))
    parts = [
        F.col("location_hierarchy"),
        F.concat(F.lit("พิกัด: "), F.col("coordinates_formatted")),
        F.col("area_formatted"),
        F.concat(F.lit("โฉนด"), F.nullif(_has(df, "deed_type").cast("string"), F.lit(""))),
        F.nullif(_has(df, "land_use_type").cast("string"), F.lit("")),
    ]
    return df.withColumn("search_text", F.nullif(F.concat_ws(" | ", *parts), F.lit("")))


def label_lines(pairs: Sequence[tuple[str, Column]]) -> Column:
    """``label: value`` of each value that is not null, one a line."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), c.cast("string")) for label, c in pairs])


def render(df: DataFrame, config: Config) -> Column:
    """Title, summary, and a section for each field type with a value."""
    blocks = [F.lit("# บันทึกข้อมูลโฉนดที่ดิน (Land Deed Record)\n")]
    blocks.append(F.concat(F.lit("**สรุป:** "), _has(df, "search_text"), F.lit("\n")))
    for kind, title in SECTION_TITLES.items():
        own = [m for m in config.mappings if m.field_type == kind or (kind == "additional" and m.field_type not in SECTION_TITLES)]
        body = label_lines([(m.key, F.col(m.key)) for m in own if m.key in df.columns]) if own else F.lit("")
        blocks.append(F.when(body != "", F.concat(F.lit(f"## {title}\n"), body, F.lit("\n"))))
    return F.concat_ws("\n", *blocks)


def row_text(df: DataFrame) -> Column:
    """Each value that is not null as ``column: value``."""
    return label_lines([(c, F.col(f"`{c}`")) for c in df.columns])


def grouped_text(groups: dict[str, Sequence[str]]) -> Column:
    """``Group: k: v, k: v``, a paragraph for each group with a value."""
    out = []
    for name, keys in groups.items():
        body = F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in keys])
        out.append(F.when(body != "", F.concat(F.lit(f"{name}: "), body)))
    return F.concat_ws("\n\n", *out)


def document_id(df: DataFrame, prefix: str = "doc_") -> Column:
    """From the deed's or the land's id, else ``prefix`` and a hash of what is known; null if nothing is."""
    known = [F.left(F.nullif(_has(df, n).cast("string"), F.lit("")), F.lit(10)) for n in ("province", "district", "deed_type", "deed_serial_no")]
    joined = F.nullif(F.concat_ws("_", *known), F.lit(""))
    own = lambda n: F.nullif(_has(df, n).cast("string"), F.lit(""))
    hashed = F.concat(F.lit(prefix), F.substring(F.md5(joined), 1, 12))
    return F.coalesce(F.concat(F.lit("deed_"), own("deed_id")), F.concat(F.lit("land_"), own("land_id")), hashed)


def document_title(df: DataFrame, number: Column) -> Column:
    """P14."""
    own = lambda n: F.nullif(_has(df, n).cast("string"), F.lit(""))
    more = F.coalesce(F.concat(F.lit(" > "), own("district")), F.lit(""))
    no = F.coalesce(F.concat(F.lit(" (#"), own("deed_serial_no"), F.lit(")")), F.lit(""))
    base = F.nullif(F.element_at(F.split(F.coalesce(own("file_path"), F.lit("")), "/"), -1), F.lit(""))
    full = F.concat(own("deed_type"), F.lit(" - "), own("province"), more, no)
    return F.coalesce(full, own("file_name"), own("filename"), base, F.concat(F.lit("Land Deed "), number.cast("string")))


def _field(text: Column, label: str, value: str, separator: str = r"[:\s]*", compat: bool = False) -> Column:
    """The first match; markdown stars round a label are skipped unless ``compat``."""
    stars = "" if compat else r"(?:\*\*:\s*)?"
    return F.nullif(F.regexp_extract(text, f"(?iu){label}{stars}{separator}{value}", 1), F.lit(""))


def extract_deed(text: Column, compat: bool = False) -> list[Column]:
    """The labelled fields of a text, one column each."""
    key = lambda label: label.lower().replace(" ", "_")
    out = [_field(text, x, LINE, compat=compat) for x in DEED_LINES]
    out = [(F.lower(c).isin(*TRUE_WORDS) if x == "Is Condo" else c).alias(key(x)) for x, c in zip(DEED_LINES, out, strict=True)]
    out += [_field(text, x, NUMBER, compat=compat).try_cast("double").alias(key(x)) for x in DEED_NUMBERS]
    out += [_field(text, x, DATE, compat=compat).alias(key(x)) for x in DEED_DATES]
    return [*out, _field(text, "Row Index", DIGITS, compat=compat).try_cast("double").alias("row_index")]


def extract_profile(text: Column) -> list[Column]:
    """P11."""
    out = [_field(text, label, r"([^,\n]+)", r":\s*", True).alias(k) for k, label in PROFILE_TEXT.items()]
    return out + [_field(text, label, NUMBER, r":\s*", True).try_cast("double").alias(k) for k, label in PROFILE_NUMBERS.items()]


def content_types(text: Column, labels: dict[str, tuple[str, ...]] = DEED_CONTENT) -> Column:
    """The labels of which a string occurs, in their order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(has_any(low, words), F.lit(label)) for label, words in labels.items()]))


def first_hit(c: Column, rules: Sequence[tuple[str, str]], default: str | None = "other") -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), None
    for word, label in rules:
        out = F.when(low.contains(word), label) if out is None else out.when(low.contains(word), label)
    return out.otherwise(F.lit(default))


def bucket(c: Column, limits: Sequence[tuple[float, str]], over: str) -> Column:
    out = None
    for most, label in limits:
        out = F.when(c < most, label) if out is None else out.when(c < most, label)
    return F.when(c.isNotNull(), out.otherwise(over))


def area_category(square_wa: Column) -> Column:
    return F.when(square_wa > 0, bucket(square_wa, AREAS, "very_large"))


def deed_categories(area: Column, deed_type: Column, region: Column, land: Column, holding: Column) -> list[Column]:
    """P10."""
    return [
        area_category(area).alias("area_category"), first_hit(deed_type, DEED_TYPES).alias("deed_type_category"), first_hit(region, REGIONS).alias("region_category"),
        first_hit(land, LAND_USES).alias("land_use_category"), first_hit(holding, OWNERS).alias("ownership_category"),
    ]


def profile_categories(salary: Column, experience: Column, education: Column, province: Column) -> list[Column]:
    """A field that is null gets no category."""
    return [
        bucket(salary, SALARIES, "over_80k").alias("salary_range"),
        first_hit(experience, EXPERIENCE, None).alias("experience_category"),
        first_hit(education, EDUCATION, None).alias("education_category"),
        F.when(province.isNotNull(), first_hit(province, CITIES, "other_province")).alias("location_category"),
    ]


def truncate(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def index_nodes(docs: DataFrame, chunks: DataFrame, batch: int = 1, size: int = 1000) -> DataFrame:
    """Documents (doc_id, title, summary) with a chunk, as index nodes."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    text = F.concat(F.lit("Document: "), F.col("title"), F.lit("\n\nSummary: "), truncate(F.col("summary"), size))
    node = F.concat(F.lit(f"batch_{batch}_doc_"), F.col("doc_id").cast("string"))
    return docs.join(counts, "doc_id").select("doc_id", node.alias("index_id"), text.alias("text"), "chunk_count")


def embedding_rows(nodes: DataFrame, embed, kind: str, batch: int = 1) -> DataFrame:
    """Nodes (node_id, doc_id, text, maybe window_text) with their vector and what describes it."""
    out = nodes.withColumn("embedding", embed(F.col("text"))).withColumn("embedding_dim", F.size("embedding"))
    out = out.withColumn("text_length", F.length("text")).withColumn("type", F.lit(kind)).withColumn("batch_number", F.lit(batch))
    return out.withColumn("window_length", F.length("window_text")) if "window_text" in nodes.columns else out


def numbered_chunks(chunks: DataFrame, order: str = "chunk_index") -> DataFrame:
    """Places within the document, from zero."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1)


def nodes(embeddings: DataFrame) -> DataFrame:
    """Text and id of any kind of record."""
    text = F.when(F.col("type") == "summary", F.col("summary_text")).otherwise(F.col("text"))
    return embeddings.select(F.coalesce("node_id", "doc_id").alias("node_id"), "type", text.alias("text"))


def preview(results: DataFrame, size: int = 200) -> DataFrame:
    """P23."""
    return results.withColumn("preview", truncate(F.col("text"), size))


def tagged(results: DataFrame, strategy: str, source: str = "documents") -> DataFrame:
    """P24."""
    return results.withColumn("retrieval_strategy", F.lit(strategy)).withColumn("data_source", F.lit(source))



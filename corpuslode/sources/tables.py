"""Tables of records as sources: CSV with encoding probe, profiles, inferred mappings, config files."""

from __future__ import annotations

import json
import re
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslode.functions.values import buddhist_date
from corpuslode.operators.metadata import Config, Mapping
from corpuslode.sources.records import read_records

# Encodings in the order in which they are tried.
ENCODINGS = ("cp874", "utf-8", "utf-8-sig", "latin-1")
SAMPLE_ROWS = 200
# Patterns in column names that tell a field's type.
FIELD_PATTERNS = {
    "identifier": ("deed_id$", "land_id$", "_no$", "_code$"),
    "deed_info": ("^deed_type", "deed_holding", "deed_serial", "deed_book", "deed_page", "deed_surface", "deed_note"),
    "location": ("province", "district", "subdistrict", "region", "country"),
    "geolocation": ("geom.*point", "land.*geom", "coordinates", "lat.*lon", "point.*geo"),
    "land_details": ("land_name", "land_use_type", "land_use_detail", "land_category", "land_passport", "land_document", "land_company"),
    "area_measurements": ("rai", "ngan", "wa", "square.*meter"),
    "dates": ("owner_date", "transfer_date", "receive_date", "contract.*date"),
    "classification": ("group_type", "main_category", "sub_category", "is_condo"),
    "financial": ("revenue", "value", "price", "cost"),
}
# Metadata keys that a field type suggests.
METADATA_KEYS = {
    "identifier": ("deed_id", "land_id", "deed_no", "land_code"),
    "deed_info": ("deed_type", "deed_holding_type", "deed_serial_no", "deed_book_no", "deed_page_no", "deed_surface_no", "deed_note"),
    "location": ("province", "district", "subdistrict", "region", "country"),
    "geolocation": ("land_geom_point", "coordinates", "latitude", "longitude"),
    "land_details": ("land_name", "land_use_type", "land_use_detail", "land_category", "land_passport", "land_document_no", "land_company_id"),
    "area_measurements": ("area_rai", "area_ngan", "area_wa", "area_square_wa", "area_square_meter"),
    "dates": ("owner_date", "transfer_date", "receive_date", "contract_start_date", "contract_end_date"),
    "classification": ("deed_group_type", "land_main_category", "land_sub_category", "is_condo"),
    "financial": ("land_total_revenue", "land_value", "price", "cost"),
}
REQUIRED_ABOVE = 0.5


def probe_encoding(spark: SparkSession, path: str, sample: int = 65_536) -> str:
    """The first encoding in which the head of a file decodes; the file is read through Spark."""
    head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, sample).alias("c")).first()["c"])
    for name in ENCODINGS:
        try:
            # a character may be cut at the sample's end
            head.decode(name) if len(head) < sample else head[: sample - 4].decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line ends inside quotes, so that a record goes on in the next one; the lines are looked at by all tasks."""
    return not spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, schema: StructType | str | None = None, multi_line: bool | None = None) -> DataFrame:
    """All columns as text unless a schema is given; rows that do not fit it have their line in ``_corrupt_record``.

    Files are split among tasks, also where records go over lines (``multi_line``; by default a look at the lines tells):
    then ``records`` finds where they begin. Only encodings whose line ends are not single bytes are read by one task a file.
    """
    broken = has_broken_lines(spark, path) if multi_line is None else multi_line
    encoding = encoding or probe_encoding(spark, path)
    options = {"header": True, "encoding": encoding, "multiLine": broken, "mode": "PERMISSIVE", "escape": '"'}
    reader = spark.read.options(**options)
    by_record = broken and not encoding.lower().replace("-", "").startswith(("utf16", "utf32"))
    if schema is None:
        if not by_record:
            return reader.csv(path)
        # the names alone: this reads the first record
        text = ", ".join(f"`{c}` string" for c in reader.csv(path).columns)
    else:
        text = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        text += ", _corrupt_record string"
        options["columnNameOfCorruptRecord"] = "_corrupt_record"
        if not by_record:
            return reader.options(**options).schema(text).csv(path)
    parsed = F.from_csv("text", text, {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k not in ("header", "encoding")})
    return read_records(spark, path, encoding).select(parsed.alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def profile(df: DataFrame, examples: int = 5) -> DataFrame:
    """Of each column the nulls, the distinct values and a few examples; only these are ever put in order."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])).alias("p")
    counts = df.select(pairs).select("p.*").groupBy("column", "v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct"))
    first = F.row_number().over(Window.partitionBy("column").orderBy("v"))
    some = counts.where("v IS NOT NULL").withColumn("i", first).where(F.col("i") <= examples).groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("examples"))
    return totals.join(some, "column", "left").withColumn("examples", F.coalesce("examples", F.expr("CAST(array() AS array<string>)")))


def score_name(name: str) -> tuple[str, float]:
    """The field type whose pattern covers most of a column's name; ``other`` at 0.1 if none matches."""
    low, best = name.lower(), ("other", 0.0)
    for kind, patterns in FIELD_PATTERNS.items():
        for p in patterns:
            if (m := re.search(p, low)) and len(m.group()) / len(low) > best[1]:
                best = (kind, len(m.group()) / len(low))
    return best if best[1] else ("other", 0.1)


def score_names(names: DataFrame, column: str = "column") -> DataFrame:
    """X3 as a plan: names meet the pattern table, the best confidence wins, the first pattern on ties."""
    low = F.lower(F.col(column))
    hits = [
        F.struct((F.length(F.regexp_extract(low, p, 0)) / F.length(low)).alias("confidence"), F.lit(-i).alias("place"), F.lit(kind).alias("field_type"))
        for i, (kind, p) in enumerate((k, p) for k, ps in FIELD_PATTERNS.items() for p in ps)
    ]
    best = F.array_max(F.array(*hits))
    d = names.select(column, best.alias("b"))
    none = F.col("b.confidence") == 0
    return d.select(column, F.when(none, "other").otherwise(F.col("b.field_type")).alias("field_type"), F.round(F.when(none, 0.1).otherwise(F.col("b.confidence")), 6).alias("confidence"))


def suggest_key(name: str, keys: tuple[str, ...]) -> str:
    """A key that the name holds or is held by, then one all of whose parts it has, else the name itself as a key."""
    low = name.lower()
    held = [k for k in keys if k in low or low in k]
    parts = [k for k in keys if all(p in low for p in k.split("_"))]
    return (held or parts or [re.sub("_+", "_", re.sub("[^a-zA-Z0-9ก-๙]+", "_", low)).strip("_")])[0]


def data_type(df: DataFrame, column: str) -> str:
    """Of up to ten values; seven tenths as dates make a date, of either era."""
    v = F.trim(F.col(f"`{column}`").cast("string"))
    sample = df.select(v.alias("v")).where("v IS NOT NULL AND v != ''").limit(10)
    kind = dict(df.dtypes)[column]
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return "integer"
    if kind in ("double", "float") or kind.startswith("decimal"):
        return "numeric"
    if kind in ("date", "timestamp"):
        return "date"
    if kind == "boolean":
        return "boolean"
    is_date = parse_date(F.col("v")).isNotNull()
    n, dates, whole, numbers = sample.agg(F.count("*"), F.count_if(is_date), F.count_if(F.col("v").try_cast("long").isNotNull()), F.count_if(F.col("v").try_cast("double").isNotNull())).first()
    if not n:
        return "string"
    return "date" if dates >= 0.7 * n else "integer" if whole == n else "numeric" if numbers == n else "string"


def suggested_keys(scored: DataFrame) -> DataFrame:
    """X4 as a plan: ``scored`` (column, field_type, ...) with key, as ``suggest_key`` gives it from the keys of the field type."""
    low = F.lower("column")
    keys = F.create_map(*[x for kind, names in METADATA_KEYS.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])
    known = F.coalesce(F.try_element_at(keys, F.col("field_type")), F.array().cast("array<string>"))
    d = scored.withColumn("__low", low).withColumn("__keys", known)
    held = F.filter("__keys", lambda k: F.col("__low").contains(k) | k.contains(F.col("__low")))
    parts = F.filter("__keys", lambda k: F.forall(F.split(k, "_"), lambda p: F.col("__low").contains(p)))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("__low", "[^a-zA-Z0-9ก-๙]+", "_"), "_+", "_"), "^_|_$", "")
    return d.withColumn("key", F.coalesce(F.get(held, F.lit(0)), F.get(parts, F.lit(0)), plain)).drop("__low", "__keys")


def analyzed(df: DataFrame) -> DataFrame:
    """X3, X4, X5, Z47 for all columns by one aggregation: column, field_type, confidence, key, data_type and n, its values.

    Text columns take their type from all their values that are not blank: a date if seven tenths are dates, a number if all are. Other columns have that of the schema.
    """
    kinds = dict(df.dtypes)

    def votes(c: str) -> Column:
        v = F.trim(F.col(f"`{c}`").cast("string"))
        v = F.when(v != "", v)
        n = F.count(v)
        kind = kinds[c]
        if kind in ("tinyint", "smallint", "int", "bigint"):
            typed = F.lit("integer")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            typed = F.lit("numeric")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            typed = F.lit("date")
        elif kind == "boolean":
            typed = F.lit("boolean")
        elif kind == "string":
            dates, whole, numbers = F.count(parse_date(v)), F.count(v.try_cast("long")), F.count(v.try_cast("double"))
            typed = F.when(n == 0, "string").when(dates >= 0.7 * n, "date").when(whole == n, "integer").when(numbers == n, "numeric").otherwise("string")
        else:
            typed = F.lit("string")
        return F.struct(F.lit(c).alias("column"), typed.alias("data_type"), n.alias("n"))

    found = df.agg(F.array(*map(votes, df.columns)).alias("v")).select(F.inline("v"))
    return suggested_keys(score_names(found.select("column"))).join(found, "column")


def parse_date(c: Column) -> Column:
    """d/m/y, d-m-y, y-m-d, y/m/d or yyyymmdd; a year over 2500 is of the Buddhist era."""
    forms = ((r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", (3, 2, 1)), (r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", (1, 2, 3)), (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)))
    part = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit("")).try_cast("int")
    return F.coalesce(*[buddhist_date(*[part(p, i) for i in places]) for p, places in forms])


def infer_config(df: DataFrame, name: str) -> Config:
    """A mapping per column, by name and values; best confidence first."""
    sample = df.limit(SAMPLE_ROWS)
    scored = sorted(((*score_name(c), c) for c in df.columns), key=lambda x: -x[1])
    mappings = [Mapping(c, suggest_key(c, METADATA_KEYS.get(kind, ())), kind, data_type(sample, c), (), conf > REQUIRED_ABOVE) for kind, conf, c in scored]
    return Config(name, mappings, embedding_fields=[m.key for m in mappings if m.field_type in ("deed_info", "location")])


def config_to_json(config: Config) -> str:
    """JSON, which is YAML too."""
    return json.dumps(asdict(config), ensure_ascii=False, indent=1)


def config_from_json(text: str) -> Config:
    raw = json.loads(text)
    return Config(raw["name"], [Mapping(**m | {"aliases": tuple(m["aliases"])}) for m in raw["mappings"]], raw["description"], raw["embedding_fields"])


def failed_rows(df: DataFrame, limit: int = 100) -> DataFrame:
    """The first rows of the error report."""
    return df.where(F.col("_corrupt_record").isNotNull()).limit(limit)


def missing_required(df: DataFrame, config: Config) -> DataFrame:
    """Rows that lack a required key."""
    lacks = [F.col(m.key).isNull() for m in config.mappings if m.required and m.key in df.columns]
    return df.where(reduce(lambda a, b: a | b, lacks, F.lit(False)))

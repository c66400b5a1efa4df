"""Queries on filters, metadata, texts and chunks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslode.functions import values as V
from corpuslode.functions.vectors import embedder
from corpuslode.operators import chunking as C
from corpuslode.operators import filters as L
from corpuslode.operators import metadata as M
from corpuslode.operators import ranking as R
from corpuslode.plans import control as K
from corpuslode.registry import query, table
from corpuslode.sources import tables as S

# ------------------------------------------------------------------- filters


def filtered(name: str, filters: list[L.Filter], sql: str, how: str = "and", compat: bool = False, source: str = "documents", key: str = "doc_id") -> None:
    @query(name, f"SELECT {key} FROM {source} WHERE {sql}")
    def run(spark, sf_dir):
        return L.where(table(spark, sf_dir, source), filters, how, compat).select(key)


filtered("f1_equal_text", [L.Filter("lang", " EN ")], "lower(trim(lang)) = 'en'")
filtered("f1_equal_number", [L.Filter("p_size", 7)], "p_size = 7", source="part", key="p_partkey")
filtered("f2_in", [L.Filter("lang", ["en", "fr"], "IN")], "lang IN ('en', 'fr')")
filtered("f3_greater", [L.Filter("p_size", 25, "GT")], "p_size > 25", source="part", key="p_partkey")
filtered("f3_greater_compat", [L.Filter("p_size", 25, "GT")], "p_size >= 25", compat=True, source="part", key="p_partkey")
filtered("f3_at_most", [L.Filter("n_chars", 2000, "LTE")], "n_chars <= 2000")
filtered("f4_and", [L.Filter("lang", "de"), L.Filter("n_chars", 500, "GTE"), L.Filter("n_chars", 5000, "LT")], "lang = 'de' AND n_chars >= 500 AND n_chars < 5000")
filtered("f4_or", [L.Filter("lang", "de"), L.Filter("source", "src3")], "lang = 'de' OR source = 'src3'", how="or")
filtered("f2_in_exact", [L.Filter("lang", ["en", "fr"], "IN", exact=True), L.Filter("n_chars", 1999.5, "GT")], "lang IN ('en', 'fr') AND n_chars > 1999.5")
filtered("f5_unknown_field", [L.Filter("no_such_field", 1)], "false")


@query("f1_equal_spelled", "SELECT doc_id FROM documents WHERE lower(trim(lang)) = 'en' AND n_chars <= 3000")
def equal_spelled(spark, sf_dir):
    """The stored spellings are looked up first, so that what is scanned then is filtered in the scan."""
    d = table(spark, sf_dir, "documents")
    return L.where(d, L.spelled(d, [L.Filter("lang", " EN "), L.Filter("n_chars", 3000, "LTE")])).select("doc_id")


@query("f12_configured", "SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND source IN ('src1', 'src2') ORDER BY doc_id LIMIT 25")
def configured(spark, sf_dir):
    """A limit is the feature here: the first rows of a filter configuration."""
    d = table(spark, sf_dir, "documents").withColumnsRenamed({"lang": "province", "source": "deed_type_category"})
    return L.configured(d, ["en", "es"], ["src1", "src2"], limit=25, order="doc_id").select("doc_id")


@query("f11_by_area", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10")
def by_area(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("search_text", F.concat(F.lit("ที่ดิน "), F.col("p_size").cast("string"), F.lit(" ไร่")))
    return L.by_area(p, low=5, high=10).select("p_partkey")


@query(
    "f13_from_dict", "SELECT doc_id FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src4')"
)
def from_dict(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return L.where(d, L.from_dict({"lang": "fr", "source": ["src1", "src4"], "nothing": 1}, d.columns)).select("doc_id")


@query("f17_equal_all", "SELECT doc_id FROM documents WHERE lang = 'es' AND source = 'src1'")
def equal_all(spark, sf_dir):
    return L.equal_all(table(spark, sf_dir, "documents"), {"lang": "es", "source": "src1"}).select("doc_id")


@query(
    "f22_chunk_band",
    """
    WITH x AS (SELECT doc_id, size, abs(length(text) - size) AS off FROM documents, (VALUES (512), (1024), (2048)) s(size) WHERE abs(length(text) - size) < 0.3 * size)
    SELECT doc_id, size, row_number() OVER (PARTITION BY size ORDER BY off, doc_id)::INT AS rank FROM x QUALIFY rank <= 3
    """,
)
def chunk_band(spark, sf_dir):
    d = L.in_bands(table(spark, sf_dir, "documents"), F.length("text")).withColumn("off", -F.abs(F.col("length") - F.col("size")))
    return R.top(d, 3, "off", "doc_id", ["size"]).select("doc_id", "size", "rank")


# ------------------------------------------------------------------- scalars


@query(
    "x1_clean_value",
    r"""
    WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '  N/A ' WHEN 1 THEN '“' || p_name || '”' WHEN 2 THEN ' a ， b  ' || p_brand WHEN 3 THEN 'ไม่ระบุ' ELSE ' - ' END AS v FROM part),
    c AS (SELECT p_partkey, regexp_replace(translate(regexp_replace(v, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'), '‘’“”–—，！？：；．', '''''""--,!?:;.'), '[\s\x{00A0}]+', ' ', 'g') AS v FROM r)
    SELECT p_partkey, CASE WHEN v = '' OR lower(v) IN ('nan', 'null', 'none', '-', 'n/a', 'na', 'ไม่ระบุ') THEN NULL ELSE v END AS clean FROM c
    """,
)
def clean_value(spark, sf_dir):
    n = F.col("p_size") % 5
    v = F.when(n == 0, "  N/A ").when(n == 1, F.concat(F.lit("“"), "p_name", F.lit("”"))).when(n == 2, F.concat(F.lit(" a ， b  "), "p_brand")).when(n == 3, "ไม่ระบุ").otherwise(" - ")
    return table(spark, sf_dir, "part").select("p_partkey", V.clean_value(v).alias("clean"))


@query("x2_normalize_key", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || ' / ' || p_brand || ' ที่ดิน!'), '[^a-zA-Z0-9ก-๙]+', '_', 'g'), '_+', '_', 'g'), '_') AS key FROM part")
def normalize_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.normalize_key(F.concat("p_type", F.lit(" / "), "p_brand", F.lit(" ที่ดิน!"))).alias("key"))


PATTERN_ROWS = ", ".join(f"({i}, '{k}', '{p}')" for i, (k, p) in enumerate((k, p) for k, ps in S.FIELD_PATTERNS.items() for p in ps))


@query(
    "x3_field_scores",
    f"""
    WITH n AS (SELECT DISTINCT event_type || CASE event_id % 4 WHEN 0 THEN '_no' WHEN 1 THEN '_price' WHEN 2 THEN '_owner_date' ELSE '' END AS col FROM events),
    p(i, field_type, pattern) AS (VALUES {PATTERN_ROWS}),
    h AS (SELECT col, i, field_type, length(regexp_extract(col, pattern)) / length(col) AS c FROM n, p),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY col ORDER BY c DESC, i) = 1)
    SELECT col AS "column", CASE WHEN c = 0 THEN 'other' ELSE field_type END AS field_type, round(CASE WHEN c = 0 THEN 0.1 ELSE c END, 6)::DOUBLE AS confidence FROM b
    """,
)
def field_scores(spark, sf_dir):
    n = F.col("event_id") % 4
    end = F.when(n == 0, "_no").when(n == 1, "_price").when(n == 2, "_owner_date").otherwise("")
    return S.score_names(table(spark, sf_dir, "events").select(F.concat("event_type", end).alias("column")).distinct())


@query(
    "x5_buddhist_dates",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
)
def buddhist_dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    written = F.concat_ws("/", F.dayofmonth(d).cast("string"), F.month(d).cast("string"), (F.year(d) + 543).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_date(written).alias("day"))


AREA = "p_size // 12 AS rai, p_size % 12 // 4 AS ngan, p_size % 4 AS wa"


def areas(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("*", F.floor(s / 12).cast("double").alias("rai"), F.floor(s % 12 / 4).cast("double").alias("ngan"), (s % 4).cast("double").alias("wa"))


@query(
    "x6_area_display",
    f"""
    WITH a AS (SELECT p_partkey, {AREA} FROM part)
    SELECT p_partkey, coalesce(nullif(concat_ws(' ', CASE WHEN rai <> 0 THEN rai || ' ไร่' END, CASE WHEN ngan <> 0 THEN ngan || ' งาน' END, CASE WHEN wa <> 0 THEN wa || ' ตร.ว.' END), ''), 'ไม่ระบุ') AS area FROM a
    """,
)
def area_display(spark, sf_dir):
    return areas(spark, sf_dir).select("p_partkey", V.area_display(F.col("rai"), F.col("ngan"), F.col("wa")).alias("area"))


@query("p5_area_total", f"WITH a AS (SELECT p_partkey, {AREA} FROM part) SELECT p_partkey, (rai * 1600 + ngan * 400 + wa * 4)::DOUBLE AS sqm FROM a")
def area_total(spark, sf_dir):
    return areas(spark, sf_dir).select("p_partkey", V.area_sqm(F.col("rai"), F.col("ngan"), F.col("wa")).alias("sqm"))


@query(
    "x7_points",
    """
    WITH s AS (SELECT s_suppkey, 95 + s_suppkey % 12 + 0.25 AS lon, 5 + s_suppkey % 90 + 0.5 AS lat FROM supplier)
    SELECT s_suppkey, CASE WHEN lat <= 90 THEN lon END::DOUBLE AS longitude, CASE WHEN lat <= 90 THEN lat END::DOUBLE AS latitude,
           CASE WHEN lat <= 90 THEN printf('%.6f, %.6f', lat::DOUBLE, lon::DOUBLE) END AS shown FROM s
    """,
)
def points(spark, sf_dir):
    k = F.col("s_suppkey")
    lon, lat = (95 + k % 12 + 0.25).cast("string"), (5 + k % 90 + 0.5).cast("string")
    text = F.when(k % 2 == 0, F.concat(F.lit("POINT("), lon, F.lit(" "), lat, F.lit(")"))).otherwise(F.concat(lat, F.lit(" "), lon))
    d = table(spark, sf_dir, "supplier").select("s_suppkey", V.parse_point(text).alias("p"))
    shown = F.when(F.col("p").isNotNull(), V.format_coordinates(F.col("p.longitude"), F.col("p.latitude")))
    return d.select("s_suppkey", "p.longitude", "p.latitude", shown.alias("shown"))


@query("x9_area_from_text", "SELECT p_partkey, p_size + 0.5::DOUBLE AS rai FROM part")
def area_from_text(spark, sf_dir):
    text = F.concat(F.lit("ขนาด "), F.col("p_size").cast("string"), F.lit(".5  ไร่ 9 ไร่"))
    return table(spark, sf_dir, "part").select("p_partkey", V.area_from_text(text).alias("rai"))


def any_sql(words, column: str = "q") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def compact_sql(parts: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in parts) + "], lambda x: x IS NOT NULL)"


def both(sql: str) -> str:
    """Queries: the benchmark's texts and each turn of a conversation."""
    return f"WITH t AS (SELECT 'b' || item_id AS id, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations), l AS (SELECT id, text, lower(text) AS q FROM t) {sql}"


def asked(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("id"), "text")
    return b.unionByName(c)


@query("x10_query_sections", both("SELECT id, array_to_string(" + compact_sql([("true", "key_info")] + [(any_sql(w), s) for s, w in V.SECTION_KEYWORDS.items()]) + ", ',') AS sections FROM l"))
def query_sections(spark, sf_dir):
    return asked(spark, sf_dir).select("id", F.array_join(V.query_sections(F.col("text")), ",").alias("sections"))


@query("x11_target_sections", both("SELECT id, array_to_string(list_sort(list_distinct(" + compact_sql([("true", "key_info")] + [(any_sql(w), s) for w, ss in V.TARGET_SECTIONS.items() for s in ss]) + ")), ',') AS sections FROM l"))
def target_sections(spark, sf_dir):
    return asked(spark, sf_dir).select("id", F.array_join(V.target_sections(F.col("text")), ",").alias("sections"))


HITS = " + ".join(f"{n} * contains(q, '{w}')::INT" for n, words in V.COMPLEXITY for w in words)


@query(
    "x12_complexity",
    both(f"""
    , s AS (SELECT id, round({HITS} + len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) / 10.0, 4)::DOUBLE AS score FROM l)
    SELECT id, score, CASE WHEN score <= 2 THEN 'simple' WHEN score <= 6 THEN 'moderate' ELSE 'complex' END AS level FROM s"""),
)
def complexity(spark, sf_dir):
    d = asked(spark, sf_dir).select("id", V.complexity(F.col("text")).alias("score"))
    return d.withColumn("level", V.complexity_level(F.col("score")))


@query("x13_engine", both("SELECT id, CASE " + " ".join(f"WHEN {any_sql(w)} THEN '{e}'" for w, e in V.ENGINES if w) + " ELSE 'basic' END AS engine FROM l"))
def engine(spark, sf_dir):
    return asked(spark, sf_dir).select("id", V.engine_for(F.col("text")).alias("engine"))


@query("x14_cache_key", both(r"SELECT id, md5(lower(regexp_replace(text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) || '|vector|5|main') AS key FROM l"))
def cache_keys(spark, sf_dir):
    return asked(spark, sf_dir).select("id", V.cache_key(F.col("text"), F.lit("vector"), F.lit(5), F.lit("main")).alias("key"))


@query("x15_json_answer", "SELECT conv_id, turn, role AS province FROM conversations")
def json_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("role").alias("province"), "text")), F.lit("\n```"))
    return c.select("conv_id", "turn", F.from_json(V.json_answer(answer), "province string, text string")["province"].alias("province"))


@query(
    "x16_sub_queries",
    both("SELECT id, unnest(list_filter([text, CASE WHEN contains(text, 'กรุงเทพ') THEN 'ที่ดินในกรุงเทพ' END, CASE WHEN NOT " + any_sql(V.DEED_TERMS, "text") + " THEN 'ประเภทโฉนดที่ดิน' END], lambda x: x IS NOT NULL)[:3]) AS sub_query FROM l"),
)
def sub_queries(spark, sf_dir):
    return asked(spark, sf_dir).select("id", F.explode(V.sub_queries(F.col("text"))).alias("sub_query"))


def rules_sql(rules) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(w, 'text' if as_is else 'q')} THEN '{s[0]}'" for w, as_is, s in rules) + " ELSE 'vector' END"


@query("k3_strategy", both(f"SELECT id, {rules_sql(K.LAND_RULES)} AS strategy FROM l"))
def strategy(spark, sf_dir):
    return asked(spark, sf_dir).select("id", K.strategy_column(F.col("text")).alias("strategy"))


@query("k7_strategy_generic", both(f"SELECT id, {rules_sql(K.GENERIC_RULES)} AS strategy FROM l"))
def strategy_generic(spark, sf_dir):
    return asked(spark, sf_dir).select("id", K.strategy_column(F.col("text"), rules=K.GENERIC_RULES).alias("strategy"))


# ------------------------------------------------------ metadata and documents

CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def customers(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])


CUSTOMER_CONFIG = M.Config("customers", [
    M.Mapping("region_name", "province", "location", aliases=("r_name",)), M.Mapping("n_name", "district", "location"), M.Mapping("c_mktsegment", "deed_type", "deed_info"),
    M.Mapping("c_acctbal", "area_rai", "area_measurements", "numeric"), M.Mapping("c_custkey", "deed_serial_no", "identifier"),
])


@query("p1_mapping", f"SELECT r_name AS province, n_name AS district, c_mktsegment AS deed_type, c_acctbal AS area_rai, c_custkey::VARCHAR AS deed_serial_no FROM {CUSTOMERS}")
def mapping(spark, sf_dir):
    return M.map_columns(customers(spark, sf_dir), CUSTOMER_CONFIG)


@query(
    "p5_computed",
    f"""
    SELECT c_custkey::VARCHAR AS deed_serial_no, r_name || ' > ' || n_name AS location_hierarchy, r_name || ' > ' || n_name || ' | โฉนด' || c_mktsegment AS search_text FROM {CUSTOMERS}
    """,
)
def computed(spark, sf_dir):
    d = M.map_columns(customers(spark, sf_dir), CUSTOMER_CONFIG).drop("area_rai")
    return M.computed(d).select("deed_serial_no", "location_hierarchy", "search_text")


@query(
    "p6_document_text",
    f"""
    SELECT c_custkey::VARCHAR AS deed_serial_no, md5('# บันทึกข้อมูลโฉนดที่ดิน (Land Deed Record)' || chr(10) || chr(10) || '**สรุป:** ' || r_name || ' > ' || n_name || ' | โฉนด' || c_mktsegment || chr(10) || chr(10)
      || '## ข้อมูลโฉนด (Deed Information)' || chr(10) || 'deed_type: ' || c_mktsegment || chr(10) || chr(10) || '## ที่ตั้ง (Location)' || chr(10) || 'province: ' || r_name || chr(10) || 'district: ' || n_name || chr(10) || chr(10)
      || '## ข้อมูลเพิ่มเติม (Additional Information)' || chr(10) || 'deed_serial_no: ' || c_custkey || chr(10)) AS text_md5 FROM {CUSTOMERS}
    """,
)
def document_text(spark, sf_dir):
    d = M.computed(M.map_columns(customers(spark, sf_dir), CUSTOMER_CONFIG).drop("area_rai"))
    return d.select("deed_serial_no", F.md5(M.render(d, CUSTOMER_CONFIG)).alias("text_md5"))


@query(
    "p14_title",
    f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Land Deed ' || c_custkey ELSE c_mktsegment || ' - ' || r_name || ' > ' || n_name || ' (#' || c_custkey || ')' END AS title FROM {CUSTOMERS}",
)
def title(spark, sf_dir):
    d = customers(spark, sf_dir).withColumns({"province": F.when(F.col("c_custkey") % 3 != 0, F.col("r_name")), "district": F.col("n_name"), "deed_type": F.col("c_mktsegment"), "deed_serial_no": F.col("c_custkey").cast("string")})
    return d.select("c_custkey", M.document_title(d, F.col("c_custkey")).alias("title"))


@query(
    "p15_document_id",
    f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'deed_' || c_custkey WHEN 1 THEN 'land_' || c_nationkey
        ELSE 'doc_' || substr(md5(substr(r_name, 1, 10) || '_' || substr(n_name, 1, 10) || '_' || substr(c_mktsegment, 1, 10)), 1, 12) END AS id FROM {CUSTOMERS}""",
)
def document_id(spark, sf_dir):
    k = F.col("c_custkey")
    d = customers(spark, sf_dir).withColumns({"deed_id": F.when(k % 3 == 0, k), "land_id": F.when(k % 3 == 1, F.col("c_nationkey")), "province": F.col("r_name"), "district": F.col("n_name"), "deed_type": F.col("c_mktsegment")})
    return d.select("c_custkey", M.document_id(d).alias("id"))


@query("p16_content_id", "SELECT doc_id, substr(md5(concat_ws(chr(31), text, lang, source)), 1, 16) AS id FROM documents")
def content_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.content_id(F.col("text"), F.col("lang"), F.col("source")).alias("id"))


@query("s5_row_text", "SELECT p_partkey, md5('p_partkey: ' || p_partkey || chr(10) || 'p_name: ' || p_name || chr(10) || 'p_brand: ' || p_brand || chr(10) || 'p_size: ' || p_size) AS text_md5 FROM part")
def row_text(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return p.select("p_partkey", F.md5(M.row_text(p)).alias("text_md5"))


@query("z45_grouped_text", "SELECT p_partkey, 'Name: p_name: ' || p_name || ', p_brand: ' || p_brand || chr(10) || chr(10) || 'Size: p_size: ' || p_size AS text FROM part")
def grouped_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.grouped_text({"Name": ["p_name", "p_brand"], "Size": ["p_size"]}).alias("text"))


@query(
    "p8_deed_fields",
    """SELECT p_partkey, p_type AS deed_type, p_brand AS province, p_size::DOUBLE AS land_rai, (p_size * 10 + 0.5)::DOUBLE AS deed_total_square_wa, '2024-01-02' AS owner_date, p_size % 2 = 0 AS is_condo, NULL AS district FROM part""",
)
def deed_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    text = F.concat(
        F.lit("# x\nDeed Type: "), "p_type", F.lit("\n- **Province**: "), "p_brand", F.lit("\nLand Rai: "), size.cast("string"), F.lit("\nDeed Total Square Wa: "), (size * 10).cast("string"),
        F.lit(".5\nowner date: 2024-01-02\nIs Condo: "), F.when(size % 2 == 0, "Yes").otherwise("No"), F.lit("\n"),
    )
    d = p.select("p_partkey", text.alias("text"))
    return d.select("p_partkey", *M.extract_deed(F.col("text"))).select("p_partkey", "deed_type", "province", "land_rai", "deed_total_square_wa", "owner_date", "is_condo", "district")


@query("p11_profile_fields", "SELECT c_custkey, c_mktsegment AS province, c_name AS company, 'A' AS major, c_custkey + 0.5::DOUBLE AS salary FROM customer")
def profile_fields(spark, sf_dir):
    text = F.concat(F.lit("Province: "), "c_mktsegment", F.lit(", Company: "), "c_name", F.lit("\nMajor: A, Salary: "), F.col("c_custkey").cast("string"), F.lit(".5 THB"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("t")).select("c_custkey", *M.extract_profile(F.col("t"))).select("c_custkey", "province", "company", "major", "salary")


def labels_sql(labels) -> str:
    return "array_to_string(" + compact_sql([(any_sql(w), s) for s, w in labels.items()]) + ", ',')"


@query("p9_content_types", f"SELECT doc_id, {labels_sql(M.DEED_CONTENT)} AS types FROM (SELECT doc_id, lower(text) AS q FROM documents)")
def content_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.content_types(F.col("text")), ",").alias("types"))


@query("p12_profile_types", f"SELECT doc_id, {labels_sql(M.PROFILE_CONTENT)} AS types FROM (SELECT doc_id, lower(text) AS q FROM documents)")
def profile_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.content_types(F.col("text"), M.PROFILE_CONTENT), ",").alias("types"))


@query(
    "p10_deed_categories",
    """
    SELECT p_partkey, CASE WHEN a < 400 THEN 'small' WHEN a < 1600 THEN 'medium' WHEN a < 4000 THEN 'large' ELSE 'very_large' END AS area_category,
           CASE p_size % 3 WHEN 0 THEN 'chanote' WHEN 1 THEN 'nor_sor_3' ELSE 'other' END AS deed_type_category, CASE p_size % 2 WHEN 0 THEN 'north' ELSE 'other' END AS region_category,
           'residential' AS land_use_category, 'corporate' AS ownership_category
    FROM (SELECT *, p_size * 100 AS a FROM part)
    """,
)
def deed_categories(spark, sf_dir):
    s = F.col("p_size")
    deed = F.when(s % 3 == 0, "โฉนดที่ดิน").when(s % 3 == 1, "น.ส.3 ก")
    region = F.when(s % 2 == 0, "ภาคเหนือ").otherwise("?")
    return table(spark, sf_dir, "part").select("p_partkey", *M.deed_categories(s * 100, deed, region, F.lit("Residential area"), F.lit("a Company")))


@query(
    "p13_profile_categories",
    """
    SELECT c_custkey, CASE WHEN c_acctbal * 10 < 20000 THEN 'under_20k' WHEN c_acctbal * 10 < 30000 THEN '20k_30k' WHEN c_acctbal * 10 < 50000 THEN '30k_50k' WHEN c_acctbal * 10 < 80000 THEN '50k_80k' ELSE 'over_80k' END AS salary_range,
           CASE c_custkey % 3 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' END AS experience_category, CASE c_custkey % 2 WHEN 0 THEN 'master' END AS education_category,
           CASE c_custkey % 2 WHEN 0 THEN 'bangkok' ELSE 'other_province' END AS location_category FROM customer
    """,
)
def profile_categories(spark, sf_dir):
    k = F.col("c_custkey")
    experience = F.when(k % 3 == 0, "1-3 years").when(k % 3 == 1, "Senior").otherwise("none")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", *M.profile_categories(F.col("c_acctbal") * 10, experience, F.when(k % 2 == 0, "MBA").otherwise("x"), F.when(k % 2 == 0, "Bangkok").otherwise("Rayong")))


@query(
    "p17_index_nodes",
    """
    WITH d AS (SELECT doc_id, text FROM documents), c AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id)
    SELECT doc_id, 'batch_1_doc_' || doc_id AS index_id, n AS chunk_count, md5('Document: doc ' || doc_id || chr(10) || chr(10) || 'Summary: ' || CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END) AS text_md5 FROM d JOIN c USING (doc_id)
    """,
)
def index_nodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("summary"))
    return M.index_nodes(d, table(spark, sf_dir, "labels")).select("doc_id", "index_id", "chunk_count", F.md5("text").alias("text_md5"))


@query("p19_chunk_places", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_index FROM conversations")
def chunk_places(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    return M.numbered_chunks(c, "turn").select("conv_id", "turn", "chunk_index")


@query("p22_nodes", "SELECT CASE WHEN vec_id % 3 = 0 THEN 'd' || vec_id ELSE 'n' || vec_id END AS node_id, CASE WHEN vec_id % 2 = 0 THEN 'summary' ELSE 'chunk' END AS type, CASE WHEN vec_id % 2 = 0 THEN 's' ELSE 't' END || label AS text FROM embeddings")
def polymorphic_nodes(spark, sf_dir):
    i, label = F.col("vec_id"), F.col("label").cast("string")
    e = table(spark, sf_dir, "embeddings").select(
        F.when(i % 3 != 0, F.concat(F.lit("n"), i.cast("string"))).alias("node_id"), F.concat(F.lit("d"), i.cast("string")).alias("doc_id"), F.when(i % 2 == 0, "summary").otherwise("chunk").alias("type"),
        F.concat(F.lit("t"), label).alias("text"), F.concat(F.lit("s"), label).alias("summary_text"),
    )
    return M.nodes(e)


# ------------------------------------------------------------------- chunking

HEADERS = {"deed_info": M.SECTION_TITLES["deed_info"], "location": M.SECTION_TITLES["location"]}


def with_headers(spark, sf_dir):
    """Documents as sections: the text under one header, a short one under another."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit(f"# x\n## {HEADERS['deed_info']}\n"), "text", F.lit(f"\n## {HEADERS['location']}\n"), "source", F.lit("\n"))
    return d.select("doc_id", text.alias("text"), "source", F.col("lang").alias("deed_type"))


STRIP = r"'^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'"


@query(
    "c3_section_content",
    rf"""
    WITH t AS (SELECT doc_id, '# x' || chr(10) || '## {HEADERS["deed_info"]}' || chr(10) || text || chr(10) || '## {HEADERS["location"]}' || chr(10) || source || chr(10) AS text FROM documents)
    SELECT doc_id, md5(regexp_replace(split_part(split_part(text, '## {HEADERS["deed_info"]}', 2), '##', 1), {STRIP})) AS body_md5, regexp_replace(split_part(split_part(text, '## {HEADERS["location"]}', 2), '##', 1), {STRIP}) AS place FROM t
    WHERE position('## ' IN text) > 0
    """,
)
def section_content(spark, sf_dir):
    d = with_headers(spark, sf_dir)
    text = F.col("text")
    # a text's own ## comes first in either engine
    return d.select("doc_id", F.md5(C.section_content(text, HEADERS["deed_info"])).alias("body_md5"), C.section_content(text, HEADERS["location"]).alias("place"))


SENTENCES = rf"list_filter(list_transform(regexp_extract_all(text, '[^.!?。\n]*[.!?。\n]+|[^.!?。\n]+'), lambda s: regexp_replace(s, {STRIP})), lambda s: s <> '')"


@query(
    "c1_section_chunks",
    rf"""
    WITH RECURSIVE t AS (SELECT doc_id, lang, source, '# x' || chr(10) || '## {HEADERS["deed_info"]}' || chr(10) || text || chr(10) || '## {HEADERS["location"]}' || chr(10) || source || chr(10) AS text FROM documents),
    b AS (
      SELECT doc_id, 0 AS place, 'deed_info' AS section, '{HEADERS["deed_info"]}' AS title, regexp_replace(split_part(split_part(text, '## {HEADERS["deed_info"]}', 2), '##', 1), {STRIP}) AS text FROM t
      UNION ALL SELECT doc_id, 1, 'location', '{HEADERS["location"]}', regexp_replace(split_part(split_part(text, '## {HEADERS["location"]}', 2), '##', 1), {STRIP}) FROM t),
    l AS (
      SELECT doc_id, place, section, '## ' || title || chr(10) AS header, text, CASE WHEN length(text) > 1024 THEN 'section_part' ELSE 'section' END AS kind FROM b WHERE length(text) >= 50
      UNION ALL SELECT doc_id, 0, 'full_document', '', text, 'fallback' FROM t WHERE doc_id NOT IN (SELECT doc_id FROM b WHERE length(text) >= 50)),
    w AS (SELECT doc_id, place, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[^ \t\n\v\f\r]+'))) AS w FROM (SELECT doc_id, place, {SENTENCES} AS s FROM l WHERE kind <> 'section')),
    p AS (SELECT doc_id, place, s, w, list_transform(range(0, len(w) + 1), lambda i: coalesce(list_sum(w[1:i]), 0)) AS p FROM w WHERE len(w) > 0),
    -- chunks as runs of sentences: each goes on up to 512 words, and begins with place most 50 words of the one before where that fits
    r AS (
      SELECT doc_id, place, 0 AS no, 0::BIGINT AS a, coalesce(list_filter(range(1, len(w)), lambda x: p[x + 2] - p[1] > 512)[1], len(w)) AS b FROM p
      UNION ALL
      SELECT doc_id, place, no + 1, a2, coalesce(list_filter(range(b + 1, len(w)), lambda x: p[x + 2] - p[a2 + 1] > 512)[1], len(w))
      FROM (SELECT *, CASE WHEN p[b + 1] - p[j + 1] + w[b + 1] <= 512 THEN j ELSE b END AS a2 FROM (
        SELECT r.doc_id, r.place, r.no, r.b, p.p, p.w, list_filter(range(r.a, r.b + 1), lambda j: p.p[r.b + 1] - p.p[j + 1] <= 50)[1] AS j FROM r JOIN p USING (doc_id, place) WHERE r.b < len(p.w)))),
    c AS (
      SELECT doc_id, place, no, kind, section, length(l.text) AS size, header || array_to_string(s[a + 1:b], ' ') AS text FROM r JOIN p USING (doc_id, place) JOIN l USING (doc_id, place)
      UNION ALL SELECT doc_id, place, 0, kind, section, length(text), header || text FROM l WHERE kind = 'section')
    SELECT doc_id, 0 AS chunk_index, 'key_info' AS chunk_type, 'key_info' AS section, 0 AS sub_chunk_index, 1 AS total_sub_chunks, length(k)::INT AS section_size, k AS text
    FROM (SELECT doc_id, CASE WHEN lang <> '' THEN 'ประเภท: ' || lang ELSE '{C.KEY_INFO_MISSING}' END AS k FROM t)
    UNION ALL SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place, no))::INT, kind, section, no::INT, (count(*) OVER (PARTITION BY doc_id, place))::INT, size::INT, text FROM c
    """,
)
def section_chunks(spark, sf_dir):
    return C.section_chunks(with_headers(spark, sf_dir), HEADERS)


@query(
    "c9_cut_sections",
    rf"""
    WITH t AS (SELECT doc_id, '# x' || chr(10) || '## {HEADERS["deed_info"]}' || chr(10) || text || chr(10) || '## {HEADERS["location"]}' || chr(10) || source || chr(10) AS text FROM documents),
    b AS (SELECT doc_id, regexp_replace(split_part(split_part(text, '## {HEADERS["deed_info"]}', 2), '##', 1), {STRIP}) AS body FROM t)
    SELECT doc_id, 'deed_info' AS section, CASE WHEN length(body) > 512 THEN substr(body, 1, 512) || '...' ELSE body END AS text FROM b WHERE length(body) >= 50
    """,
)
def cut_sections(spark, sf_dir):
    return C.cut_sections(with_headers(spark, sf_dir), HEADERS)


@query(
    "c5_sentence_windows",
    f"""
    WITH s AS (SELECT doc_id, {SENTENCES} AS s FROM documents), p AS (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM s)
    SELECT doc_id, i::INT AS sentence_index, s[i + 1] AS text, md5(array_to_string(s[greatest(i - 2, 1):i + 4], ' ')) AS window_md5 FROM p
    """,
)
def sentence_windows(spark, sf_dir):
    return C.sentence_windows(table(spark, sf_dir, "documents")).select("doc_id", "sentence_index", "text", F.md5("window_text").alias("window_md5"))


def packed_sql(source: str, size: int, overlap: int) -> str:
    """CTEs w, p and r: the sentences ``s`` of each text of ``source`` (doc_id, text), and chunk ``no`` of them from ``a`` to before ``b``."""
    return rf"""
    w AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[^ \t\n\v\f\r]+'))) AS w FROM (SELECT doc_id, {SENTENCES} AS s FROM {source})),
    p AS (SELECT doc_id, s, w, list_transform(range(0, len(w) + 1), lambda i: coalesce(list_sum(w[1:i]), 0)) AS p FROM w WHERE len(w) > 0),
    r AS (
      SELECT doc_id, 0 AS no, 0::BIGINT AS a, coalesce(list_filter(range(1, len(w)), lambda x: p[x + 2] - p[1] > {size})[1], len(w)) AS b FROM p
      UNION ALL
      SELECT doc_id, no + 1, a2, coalesce(list_filter(range(b + 1, len(w)), lambda x: p[x + 2] - p[a2 + 1] > {size})[1], len(w))
      FROM (SELECT *, CASE WHEN p[b + 1] - p[j + 1] + w[b + 1] <= {size} THEN j ELSE b END AS a2 FROM (
        SELECT r.doc_id, r.no, r.b, p.p, p.w, list_filter(range(r.a, r.b + 1), lambda j: p.p[r.b + 1] - p.p[j + 1] <= {overlap})[1] AS j FROM r JOIN p USING (doc_id) WHERE r.b < len(p.w))))"""


@query(
    "c5_base_windows",
    f"""
    WITH RECURSIVE {packed_sql("documents", 1024, 20)},
    c AS (SELECT doc_id, no, s[a + 1:b] AS s FROM r JOIN p USING (doc_id)), i AS (SELECT doc_id, no, s, unnest(range(0, len(s))) AS i FROM c)
    SELECT doc_id, no::INT AS base_index, i::INT AS sentence_index, md5(s[i + 1]) AS text_md5, md5(array_to_string(s[greatest(i - 2, 1):i + 4], ' ')) AS window_md5 FROM i
    """,
)
def base_windows(spark, sf_dir):
    return C.base_windows(table(spark, sf_dir, "documents")).select("doc_id", "base_index", "sentence_index", F.md5("text").alias("text_md5"), F.md5("window_text").alias("window_md5"))


@query(
    "c8_section_rows",
    rf"""
    WITH RECURSIVE t AS (SELECT source AS doc_id, '## {HEADERS["deed_info"]}' || chr(10) || arg_max(text, struct_pack(n := length(text), t := text)) AS text FROM documents GROUP BY source),
    h AS (SELECT doc_id, text AS whole, regexp_replace(split_part(split_part(text, '## {HEADERS["deed_info"]}', 2), '##', 1), {STRIP}) AS text FROM t),
    l AS (
      SELECT doc_id, 'deed_info' AS section, '## {HEADERS["deed_info"]}' || chr(10) AS header, text, CASE WHEN length(text) > 1024 THEN 'section_part' ELSE 'section' END AS kind FROM h WHERE length(text) >= 50
      UNION ALL SELECT doc_id, 'full_document', '', whole, 'fallback' FROM h WHERE length(text) < 50),
    long AS (SELECT * FROM l WHERE kind <> 'section'), {packed_sql("long", 512, 50)},
    c AS (
      SELECT doc_id, no + 1 AS chunk_index, kind AS chunk_type, section, header || array_to_string(s[a + 1:b], ' ') AS text FROM r JOIN p USING (doc_id) JOIN long USING (doc_id)
      UNION ALL SELECT doc_id, 1, kind, section, header || text FROM l WHERE kind = 'section'
      UNION ALL SELECT doc_id, 0, 'key_info', 'key_info', '{C.KEY_INFO_MISSING}' FROM t)
    SELECT doc_id || '_section_' || chunk_index AS node_id, doc_id, chunk_type, section, length(text)::INT AS text_length, 64 AS embedding_dim, md5(text) AS text_md5 FROM c
    """,
)
def section_rows(spark, sf_dir):
    """The longest text of each source under a header, parsed again, each section chunk an embedding row."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.concat(F.lit(f"## {HEADERS['deed_info']}\n"), "text").alias("text"))
    rows = M.embedding_rows(C.section_rows(d, titles=HEADERS), embedder(), "section")
    return rows.select("node_id", "doc_id", "chunk_type", "section", "text_length", "embedding_dim", F.md5("text").alias("text_md5"))


@query("c5_turn_windows", "SELECT conv_id, turn, md5(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ' ')) AS window_md5 FROM conversations")
def turn_windows(spark, sf_dir):
    return C.row_windows(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.md5("window_text").alias("window_md5"))


@query("c8_longest_chunk", "SELECT conv_id AS doc_id, arg_max(text, struct_pack(n := length(text), t := text)) AS text FROM conversations GROUP BY conv_id")
def longest_chunk(spark, sf_dir):
    return C.longest_chunk(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id"))


@query(
    "d1_keep_first", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
)
def keep_first(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id")


@query("d2_keep_first_prefix", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) = 1")
def keep_first_prefix(spark, sf_dir):
    """The first 200 characters are the operator's own key."""
    return R.keep_first(table(spark, sf_dir, "documents"), [F.left("text", F.lit(200))], ["doc_id"]).select("doc_id")


@query("j3_with_chunks", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def with_chunks(spark, sf_dir):
    return R.candidates_only(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query(
    "j8_first_chunks",
    "SELECT conv_id, turn FROM conversations JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) ON conv_id = doc_id QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3",
)
def first_chunks(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id")).distinct()
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (-F.col("turn")).alias("order"))
    return R.top(turns.join(good, "conv_id"), 3, "order", "turn", ["conv_id"]).select("conv_id", "turn")

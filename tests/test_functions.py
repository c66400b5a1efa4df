import pytest
from pyspark.sql import functions as F

from corpuslode.functions import keywords as W
from corpuslode.functions import values as V
from corpuslode.functions.vectors import cosine, embedder, hash_vector, mock_vector


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "wanted"), [("ไม่ระบุ", None), (" N/A ", None), (" - ", None), ("“ทดสอบ”", '"ทดสอบ"'), ("ทดสอบ，ต่อไป", "ทดสอบ,ต่อไป"), ("a \t b", "a b"), ("", None), (None, None)]
)
def test_clean_value(spark, given, wanted):
    assert one(spark, V.clean_value(F.lit(given).cast("string"))) == wanted


def test_area(spark):
    assert one(spark, V.area_display(F.lit(1.0), F.lit(2.0), F.lit(3.0))) == "1 ไร่ 2 งาน 3 ตร.ว."
    assert one(spark, V.area_display(F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"))) == "ไม่ระบุ"
    assert one(spark, V.area_sqm(F.lit(2.0), F.lit(None).cast("double"), F.lit(0.0))) == 3200.0


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("POINT(100.5 13.7)", (100.5, 13.7)), ("POINT(100.4514,14.5486)", (100.4514, 14.5486)), ("14.5486 100.4514", (100.4514, 14.5486)), ("100.4514,14.5486", (100.4514, 14.5486)),
        ("POINT(-1 5)", None), ("", None), (None, None), ("point ( 1 , 2 )", (1.0, 2.0)),
    ],
)
def test_point(spark, given, wanted):
    found = one(spark, V.parse_point(F.lit(given).cast("string")))
    assert (found and tuple(found)) == wanted


def test_formats(spark):
    assert one(spark, V.format_coordinates(F.lit(100.5), F.lit(13.7))) == "13.700000, 100.500000"
    assert "google.com/maps" in one(spark, V.maps_url(F.lit(100.5), F.lit(13.7)))
    assert one(spark, V.area_from_text(F.lit("10 ไร่"))) == 10.0
    assert one(spark, V.area_from_text(F.lit("none"))) is None
    assert one(spark, V.normalize_key(F.lit(" Deed (No.) ที่ "))) == "deed_no_ที่"


def test_query_heuristics(spark):
    assert one(spark, V.query_sections(F.lit("ขนาด of the land"))) == ["key_info", "area_measurements"]
    assert "location" in one(spark, V.target_sections(F.lit("Location?")))
    assert one(spark, V.complexity(F.lit("what is this"))) == pytest.approx(1.3)
    assert one(spark, V.complexity_level(F.lit(7.0))) == "complex"
    assert one(spark, V.engine_for(F.lit("find a document"))) == "document_summary"
    assert one(spark, V.engine_for(F.lit("find it"), ("recursive", "hybrid_search"))) == "hybrid_search"
    assert one(spark, V.sub_queries(F.lit("ที่ดินในกรุงเทพ"))) == ["ที่ดินในกรุงเทพ", "ที่ดินในกรุงเทพ", "ประเภทโฉนดที่ดิน"]
    assert one(spark, V.sub_queries(F.lit("โฉนด"))) == ["โฉนด"]
    assert one(spark, V.json_answer(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'


def test_keywords(spark):
    assert one(spark, W.tokens(F.lit("The quick-brown fox, it IS été"))) == ["quick", "brown", "fox", "été"]
    assert one(spark, W.query_keywords(F.lit("โฉนด at the km"))) == ["the", "โฉนด"]
    assert one(spark, W.frequency_score(F.lit("aXaXa"), F.array(F.lit("a"), F.lit("zz")))) == pytest.approx(0.15)
    assert one(spark, W.overlap(F.lit("a b"), F.lit("b c"))) == 0.5
    assert one(spark, W.overlap(F.lit(" "), F.lit("b c"))) == 0.0


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, cosine(a, b)) == pytest.approx(2**-0.5)
    assert one(spark, cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, cosine(a, F.array(F.lit(1.0)))) is None
    assert len(one(spark, mock_vector())) == 1536
    rows = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(embedder()("t").alias("v")).collect()
    assert sum(x * x for x in rows[0]["v"]) == pytest.approx(1, abs=1e-6)
    assert not any(rows[1]["v"]) and not any(rows[2]["v"])
    assert rows[0]["v"] == pytest.approx(hash_vector("b A a"))


def test_buddhist_date(spark):
    assert str(one(spark, V.buddhist_date(F.lit(2567), F.lit(9), F.lit(25)))) == "2024-09-25"
    assert one(spark, V.buddhist_date(F.lit(2024), F.lit(2), F.lit(30))) is None

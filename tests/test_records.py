"""Records over lines against Spark's own reader, with one task a file, and splits of every size."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslode.sources import records as R
from corpuslode.sources import tables as T

ODD_FIELDS = ["", "plain", "two\nlines", 'quoted "word"', 'a ""doubled"" one', '"', '""', "\n", "\n\n\n", "a,b", ",", "x\r\ny", "ที่ดิน\nโฉนด", "é" * 40, "end\n", "\n" * 30 + "x", ' "', "q" * 300]


def written(path, rows, end="\n", encoding="utf-8", last=True):
    quoted = lambda v: v if v and not set(v) & set('",\n\r ') else '"' + v.replace('"', '""') + '"'
    text = end.join(["id,text,note", *(",".join(map(quoted, (str(i), *r))) for i, r in enumerate(rows))]) + (end if last else "")
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def put(size):
        for n, v in zip(names, (size, 1), strict=True):
            spark.conf.set(n, v)

    yield put
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [64, 301, 2000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_against_the_whole_file_reader(spark, tmp_path, small_splits, size, end):
    rnd = random.Random(size)
    rows = [(rnd.choice(ODD_FIELDS), rnd.choice(ODD_FIELDS)) for _ in range(120)]
    path = written(tmp_path / "t.csv", rows, end, last=size != 301)
    whole = spark.read.options(header=True, multiLine=True, escape='"', encoding="utf-8").csv(path)
    wanted = sorted(whole.collect(), key=lambda r: r["id"])
    assert len(wanted) == len(rows)
    small_splits(size)
    found = T.read_csv(spark, path, "utf-8")
    assert found.columns == ["id", "text", "note"]
    # line ends stay as they are; Spark's reader makes those in quotes plain where records end in two characters
    kept = lambda rows: [tuple(v if v is None or end == "\n" else v.replace("\r\n", "\n") for v in r) for r in rows]
    assert kept(sorted(found.collect(), key=lambda r: r["id"])) == kept(wanted)
    typed = T.read_csv(spark, path, "utf-8", "id long, text string, note string")
    assert kept(sorted(((str(r["id"]), r["text"], r["note"]) for r in typed.collect()), key=lambda r: r[0])) == kept(wanted)
    assert typed.where("_corrupt_record IS NOT NULL").count() == 0


def test_other_encodings_many_files_and_errors(spark, tmp_path, small_splits):
    small_splits(200)
    for i in range(3):
        written(tmp_path / f"{i}.csv", [("ที่ดิน\nที่", "x"), ("a", f"file {i}\n")] * 10, encoding="cp874")
    found = T.read_csv(spark, str(tmp_path), "cp874", "id int, text string, note string")
    assert found.count() == 60 and found.where("text = 'ที่ดิน\nที่'").count() == 30
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.csv").write_text('id,text\n1,"a\nb"\nx,"c\nd"\n\n2,"never closed\n')
    bad = T.read_csv(spark, str(tmp_path / "bad"), "utf-8", "id int, text string")
    assert bad.where("_corrupt_record IS NULL").select("text").first()["text"] == "a\nb"
    assert bad.where("_corrupt_record LIKE 'x,%'").count() == 1


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,text\n")
    assert T.read_csv(spark, str(tmp_path / "e.csv"), "utf-8", multi_line=True).collect() == []


def test_one_file_is_read_by_many_tasks(spark, sf_dir, tmp_path, small_splits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    T.write_csv(docs.coalesce(1), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    small_splits(50_000)
    found = T.read_csv(spark, str(tmp_path / "one"), "utf-8", "doc_id long, text string")
    rows = R.lines(spark, str(tmp_path / "one"))
    states = R.begun(R.survey(rows))
    assert rows.rdd.getNumPartitions() > 5 and len(states) > 5 and any(s.inside for s in states.values())
    pieces = R._pieces(rows, states, "utf-8").withColumn("task", F.spark_partition_id())
    assert pieces.select("task").distinct().count() > 5
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())

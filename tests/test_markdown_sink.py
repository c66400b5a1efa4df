"""Markdown files under their own names, and batches of them."""

import pytest
from pyspark.sql import functions as F

from corpuslode.sources import markdown_sink as M
from corpuslode.sources.files import in_batches

ROWS = [("d1", "# A\nline", "Bangkok"), ("d2", "", "Bangkok"), ("d2b", None, None), ("x/../y", "slash", "a b"), (None, "no id", "Bangkok"), (None, "no id", "Bangkok"), ("twice", "one", "c"), ("twice", "two", "c"), ("ก", "ที่ดิน\r\n", "กรุงเทพ")]


def test_names_and_contents(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id string, text string, province string")
    for _ in range(2):  # a job that runs again writes the same files
        M.write(docs.repartition(3), str(tmp_path / "md"))
    found = {str(p.relative_to(tmp_path / "md")): p.read_bytes().decode() for p in (tmp_path / "md").rglob("*.md")}
    named = {k: v for k, v in found.items() if "twice" not in k and "no id" not in v}
    assert named == {"Bangkok/d1.md": "# A\nline", "Bangkok/d2.md": "", "unknown/d2b.md": "", "a_b/x_y.md": "slash", "กรุงเทพ/ก.md": "ที่ดิน\r\n"}
    assert sorted(v for k, v in found.items() if "c/twice-" in k) == ["one", "two"] and list(found.values()).count("no id") == 1
    assert (tmp_path / "md" / "_SUCCESS").exists() and not list((tmp_path / "md").rglob(".*-*"))


def test_a_job_that_fails_leaves_no_files(spark, tmp_path):
    writer = M.FilesWriter(str(tmp_path / "md"))
    import pyarrow as pa

    told = writer.write(iter([pa.RecordBatch.from_arrays([pa.array(["a", "a"]), pa.array(["x.md", "y.md"]), pa.array(["1", None])], ["folder", "name", "text"])]))
    assert told.folders == {"a": 2} and len(list((tmp_path / "md").rglob("*.md"))) == 2
    writer.abort([told, None])
    assert not list((tmp_path / "md").rglob("*.md"))


@pytest.mark.parametrize("n", [0, 1, 20, 517])
def test_numbers_are_those_of_one_window(spark, n):
    files = spark.range(n).select(F.concat(F.lit("p/"), F.md5(F.col("id").cast("string"))).alias("file_path"), "id")
    found = sorted(map(tuple, M.numbered(files).select("id", "batch_number").collect()))
    assert found == sorted(map(tuple, in_batches(files).select("id", "batch_number").collect())) and len(found) == n


def test_tasks_list_and_read_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "READ_BYTES", 40)
    monkeypatch.setattr(M, "LISTED", 2)
    rows = [(i, f"text {i}\r\n" * (i % 5), f"?{i % 3}") for i in range(30)]
    path = str(tmp_path / "md")
    M.write(spark.createDataFrame(rows, "doc_id long, text string, province string"), path)
    (tmp_path / "md" / "_0" / ".draft.md-1").write_text("half")
    found = M.read(spark, path, size=4)
    assert {(r["folder"], r["file_doc_id"], r["text"], r["file_size"]) for r in found.collect()} == {(f"_{g[1:]}", str(i), t, len(t)) for i, t, g in rows}
    # no scan plans the files one by one, and paths are numbered as by one window
    assert not [f for f in found.inputFiles() if f.endswith(".md")]
    by_path = sorted(found.select("file_path", "batch_number").collect())
    assert [r["batch_number"] for r in by_path] == [i // 4 + 1 for i in range(30)]


@pytest.mark.parametrize("name", ["s19_markdown_files", "s6_markdown_batches"])
def test_queries_plan_no_scan_of_files(spark, sf_dir, name):
    import corpuslode.plans.catalog  # noqa: F401
    from corpuslode.registry import QUERIES

    assert len(QUERIES[name](spark, sf_dir).inputFiles()) < 200  # one for each document before


def test_no_files(spark, tmp_path):
    M.write(spark.createDataFrame([], "doc_id long, text string, province string"), str(tmp_path / "md"))
    assert M.read(spark, str(tmp_path / "md"), size=20).collect() == []

"""Row keys that do not copy the table."""

from pyspark.sql import functions as F

from corpuslode.llm.common import keyed


def test_rows_of_parquet_files_have_keys_of_their_own_without_a_copy(spark, tmp_path):
    rows = [(i % 3, f"t{i % 5}", None if i % 4 else "x") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row_file string")
    docs.repartition(7).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    found = keyed(table, "__row", "unused")
    assert found.columns == [*docs.columns, "__row"]
    assert found.select("__row").distinct().count() == 1000
    # other splits, the same keys
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        again = keyed(table, "__row", "unused")
        assert found.exceptAll(again).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert keyed(spark.read.schema(table.schema).parquet(str(tmp_path / "d")).limit(0), "__row", "empty").isEmpty()


def test_other_tables_are_written_once(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.rand(3).alias("x"))
    found = keyed(docs, "__row", "copied", keep=True)
    assert found.select("__row").distinct().count() == 100 and found.exceptAll(found).isEmpty()
    one = str(tmp_path / "one")
    docs.coalesce(1).write.parquet(one)
    twice = spark.read.parquet(one, one)
    assert keyed(twice, "__row", "twice").select("__row").distinct().count() == twice.count()
    assert keyed(spark.createDataFrame([], "doc_id long"), "__row", "none").isEmpty()

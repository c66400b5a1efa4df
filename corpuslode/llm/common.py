"""Shared by the corpus operators: table access, shared scratch space, the word pattern."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word wherever words are counted: runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words.
BLANKS = " \t\n\x0b\x0c\r"
#: Files of a table up to which their numbers are broadcast.
FEW_FILES = 100_000

#: The scratch folders of the ``tidy`` blocks around, innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("_open", default=())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset a local session gets a temporary folder; on a cluster,
    whose executors could not see one, it is an error. ``keep``: it outlives the
    innermost ``tidy`` block.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpuslode-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if blocks := _open.get()[: -1 if keep else None]:
        blocks[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, wherever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside are deleted at the end, but for kept ones, which an enclosing block deletes with its own.

    What leaves the block must read kept tables only.
    """
    made: list[str] = []
    before = _open.set((*_open.get(), made))
    try:
        yield
    finally:
        _open.reset(before)
        for path in made:
            remove(spark, path)


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to shared scratch and read it again: the lineage ends there, and a lost executor costs no recomputation."""
    return stored(df, scratch(df.sparkSession, name, keep))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df``, written at ``path``."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, key: str, name: str, keep: bool = False) -> DataFrame:
    """``docs`` with a long ``key`` that tells its rows apart and is the same at each read.

    Of a table read from Parquet that is the number of the row's file, by path,
    and the row's place there, so nothing is copied. Anything else could come
    out otherwise when it is read again, and is written to shared scratch.
    """
    at, file, no = None, *(free_name(c, docs) + key for c in ("file", "no"))
    if docs._jdf.queryExecution().analyzed().children().isEmpty() and "_metadata" not in {c.lower() for c in docs.columns}:
        try:
            at = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(key))
        except AnalysisException:
            at = None  # no table of Parquet files
    # the driver lists the files of a table in any case; one that is named twice is read twice
    found = at.groupBy(file).agg(F.count("*"), F.max(key) + 1).collect() if at is not None else []
    if at is None or any(n != end for _, n, end in found):
        return cut(docs.withColumn(key, F.monotonically_increasing_id()), name, keep)
    number = docs.sparkSession.createDataFrame(list(enumerate(sorted(r[0] for r in found))), f"`{no}` long, `{file}` string")
    number = F.broadcast(number) if len(found) <= FEW_FILES else number
    return at.join(number, file).select(*[F.col(f"`{c}`") for c in docs.columns], F.shiftleft(no, 33).bitwiseOR(F.col(key)).alias(key))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold ``rows`` rows, where the session still has Spark's own 10,000: of long texts those take hundreds of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of texts in parts of a few rows, so that what a worker makes of a part stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def free_name(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def share(df: DataFrame, most: int, *keys: Column, seed: int = 17) -> DataFrame:
    """About ``most`` rows of ``df``, chosen by a hash of ``keys``: the same ones whenever it is run.

    The hash is compared in all its 64 bits, so any share of any number of rows
    can be asked for. Rows with equal keys come together or not at all: where
    the rows are then collected, a limit behind this bounds them.
    """
    n = df.count()
    if n <= most:
        return df
    return df.where(F.xxhash64(F.lit(seed), *keys) < F.lit(below(most, n)))


def below(most: int, n: int) -> int:
    """The signed 64-bit value under which ``most`` of ``n`` hashes lie on average."""
    return min((1 << 64) * most // n, (1 << 64) - 1) - (1 << 63)

"""Vector similarity on arrays, and text embedding functions that need no network."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 64
_WORDS = re.compile(r"\w+")
#: The constant vector of the mock service.
MOCK_SIZE, MOCK_VALUE = 1536, 0.1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """R2: null where a vector has no length or the lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def hash_vector(text: str | None, size: int = DIMENSIONS) -> list[float]:
    """Each word adds plus or minus one at the place that its md5 tells; the sum has length one, or is zero without words."""
    v = np.zeros(size)
    for w, times in Counter(_WORDS.findall((text or "").lower())).items():
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
        v[h % size] += times if h >> 63 else -times
    n = float(np.sqrt(v @ v))
    return (v / n if n else v).astype("float32").tolist()


def bounded_batches(spark: SparkSession | None, rows: int = 1000, size: int = 4 << 20) -> None:
    """Let Arrow batches hold ``rows`` rows and about ``size`` bytes, where the session still has Spark's own limits: else a worker's memory grows with texts and partitions."""
    if spark is None:
        return
    for name, own, most in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", f"{size}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == own:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def embedder(model: Callable[[str | None], list[float]] | None = None):
    """A column function that embeds texts, by ``model`` or by hashed words."""
    model = model or hash_vector
    bounded_batches(SparkSession.getActiveSession())

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model(t), na_action=None)

    return embed


def mock_vector() -> Column:
    """U3."""
    return F.array_repeat(F.lit(MOCK_VALUE).cast("float"), MOCK_SIZE)

"""Shared helpers: word pattern, shared-folder spills, Arrow batch sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import shared_dir

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> Iterator[None]:
    """Bound what an Arrow batch of texts may hold, in rows and in bytes, for what is run inside; the session's settings come back afterwards."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(mb << 20)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACE_RUN))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: About how many bytes a value takes in a broadcast table.
_WIDTH = {T.StringType: 40, T.BinaryType: 80, T.ArrayType: 400, T.StructType: 60}


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, mb: int = 32) -> DataFrame:
    """Join with a broadcast of ``small`` if its counted rows take at most about ``mb`` MB, else by a shuffle. ``small`` should be stored: it is read twice."""
    width = 16 + sum(_WIDTH.get(type(f.dataType), 8) for f in small.schema)
    return big.join(F.broadcast(small) if small.count() * width <= mb << 20 else small, on, how)


def give_back() -> None:
    """Return unused memory of this process to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function over Arrow batches that gives its memory back at the end: Python workers stay for later stages, and would keep it."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import gc

            gc.collect()
            give_back()

    return wrapped

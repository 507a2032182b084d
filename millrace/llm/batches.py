"""Helpers of the operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Characters of text that one step of a task holds in its work arrays.
STEP_CHARS = 2_000_000
ROWS_PER_BATCH = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: The one large table that a worker keeps between its tasks, and whether the current task has used it.
_kept: dict[Hashable, object] = {}
_used: set[Hashable] = set()


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once per worker; another key takes its place."""
    _used.add(key)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give back what a task has freed, and a kept table that it did not use: its worker lives on, for other operators."""
    if _kept.keys() - _used:
        _kept.clear()
        gc.collect()
    _used.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim:
        trim(0)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session cut to ``ROWS_PER_BATCH`` rows, unless the user chose a size.

    Rows here are whole texts, so the default of 10,000 would hold tens of
    megabytes several times over, in the executor and in its Python worker.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS) == "10000":
        conf.set(ARROW_ROWS, str(ROWS_PER_BATCH))
    return df


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch; it returns the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], f.type, from_pandas=False) for f in target], schema=target
                )
        release()

    return bounded(df).mapInArrow(run, StructType.fromDDL(schema))


def pieces(texts: list, limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts hold about ``limit`` characters together; a longer text stands alone."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)

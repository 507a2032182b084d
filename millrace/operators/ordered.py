"""Order-dependent work that stays spread out when one key holds most rows.

A plain window puts all rows of a key into one task. That is right for light keys;
heavy ones, found by counting, are cut into range chunks, so that a big key spans several
chunks; each chunk is worked on by itself and a small carry per (key, chunk)
joins the pieces together.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

CHUNK_ROWS = 2_000_000
CHUNK = "_chunk"
BROADCAST_CHUNKS = 50_000


def chunk_rows(
    df: DataFrame, keys: list[str], order: list[str], max_rows: int = CHUNK_ROWS, size: int | None = None
) -> tuple[DataFrame, int]:
    """Number range chunks over (keys, order); returns the frame and chunk count.

    ``order`` must be unique within a key. Chunk ids grow with the order, and a
    chunk holds about ``max_rows`` rows. The chunked frame is checkpointed, so
    every later use sees the same ids even after a task is run again. ``size`` is
    the row count where the caller can tell it more cheaply.
    """
    chunks = math.ceil((df.count() if size is None else size) / max_rows)
    if chunks <= 1:
        return df.withColumn(CHUNK, F.lit(0)), 1
    ranged = df.repartitionByRange(chunks, *keys, *order)
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id())), chunks


def join_carry(chunked: DataFrame, carry: DataFrame, keys: list[str], chunks: int) -> DataFrame:
    """Attach a carry that exists only where a key began in an earlier chunk.

    Range chunks are contiguous, so a chunk continues at most one key: the carry
    has fewer rows than there are chunks, which is the bound for broadcasting.
    """
    by = [*keys, CHUNK]
    carry = carry.withColumnsRenamed({c: f"_c_{c}" for c in by})
    if chunks <= BROADCAST_CHUNKS:
        carry = F.broadcast(carry)
    return chunked.join(carry, _same(by, [f"_c_{c}" for c in by]), "left").drop(*[f"_c_{c}" for c in by])


def _same(left: list[str], right: list[str]) -> Column:
    """Equal keys; a null key is a key here, as it is to a window."""
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def split_heavy(
    df: DataFrame, keys: list[str], max_rows: int = CHUNK_ROWS, size: int | None = None
) -> tuple[DataFrame | None, DataFrame | None, int]:
    """``df`` as rows of light keys, rows of heavy keys, and the number of the latter; None where there are none.

    A key is heavy if its counted rows are more than ``max_rows``, so there are fewer
    heavy keys than ``rows / max_rows``. Light keys then need no more than a plain
    window. Without keys all rows are one group.
    """
    total = df.count() if size is None and not keys else size
    if total is not None and total <= max_rows:
        return df, None, 0
    if not keys:
        return None, df, total
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows)
    if counted.isEmpty():
        return df, None, 0
    counted = cut_lineage(counted.withColumnsRenamed({k: f"_h_{k}" for k in keys}))
    number, rows = counted.agg(F.count("*"), F.sum("_n")).first()
    named = counted.drop("_n")
    named = F.broadcast(named) if number <= BROADCAST_CHUNKS else named
    same = _same(keys, named.columns)
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi"), rows


def _by_weight(light: DataFrame | None, heavy: DataFrame | None, plain, chunked) -> DataFrame:
    if heavy is None:
        return plain(light)
    return chunked(heavy) if light is None else plain(light).unionByName(chunked(heavy))


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    max_rows: int = CHUNK_ROWS,
    size: int | None = None,
) -> DataFrame:
    """Sum of ``value`` from a key's first row up to and including each row."""
    valued = df.withColumn("_v", value)
    light, heavy, rows = split_heavy(valued, keys, max_rows, size)
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(out, F.sum("_v").over(so_far)).drop("_v")

    def chunked(part: DataFrame) -> DataFrame:
        return _chunked_sum(part, keys, order, out, max_rows, rows)

    return _by_weight(light, heavy, plain, chunked)


def _chunked_sum(df: DataFrame, keys: list[str], order: list[str], out: str, max_rows: int, size: int) -> DataFrame:
    chunked, chunks = chunk_rows(df, keys, order, max_rows, size)
    within = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.sum("_v").alias("_total"))
        .withColumn("_carry", F.sum("_total").over(earlier))
        .where(F.col("_carry").isNotNull())
        .select(*keys, CHUNK, "_carry")
    )
    summed = join_carry(
        chunked.withColumn(out, F.sum("_v").over(within)), carry, keys, chunks
    )
    whole = F.when(F.col("_carry").isNull(), F.col(out)).otherwise(
        F.coalesce(F.col(out), F.lit(0)) + F.col("_carry")
    )
    kind = summed.schema[out].dataType
    return summed.withColumn(out, whole.cast(kind)).drop("_v", CHUNK, "_carry")


def previous_value(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    column: str,
    out: str,
    max_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The value of ``column`` on the key's row before this one; null on the first."""
    light, heavy, rows = split_heavy(df, keys, max_rows)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(out, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))

    def chunked(part: DataFrame) -> DataFrame:
        return _chunked_previous(part, keys, order, column, out, max_rows, rows)

    return _by_weight(light, heavy, plain, chunked)


def _chunked_previous(
    df: DataFrame, keys: list[str], order: list[str], column: str, out: str, max_rows: int, size: int
) -> DataFrame:
    chunked, chunks = chunk_rows(df, keys, order, max_rows, size)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    carry = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.max_by(column, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK)))
        .where(F.col("_carry").isNotNull())
        .select(*keys, CHUNK, "_carry")
    )
    lagged = chunked.withColumn("_first", F.row_number().over(w) == 1).withColumn(
        out, F.lag(column).over(w)
    )
    joined = join_carry(lagged, carry, keys, chunks)
    return joined.withColumn(
        out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(out))
    ).drop(CHUNK, "_first", "_carry")


def number_rows(
    df: DataFrame, order: list[str], out: str, start: int = 0, max_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Dense numbers ``start + 1, start + 2, ...`` in the given order."""
    counted = running_sum(df, [], order, F.lit(1).cast("long"), out, max_rows)
    return counted.withColumn(out, F.col(out) + F.lit(start).cast("long"))


def top_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    spread: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of every key in the given order.

    Spark already cuts each map task to ``n`` rows per key before the shuffle.
    With few keys and a large ``n`` set ``spread``: rows are first ranked in that
    many hash groups per key, and only the survivors meet in the last rank.
    """
    out = rank or "_rank"
    if spread > 1:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
        salted = df.withColumn("_salt", salt)
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n).drop("_salt", out)
    w = Window.partitionBy(*keys).orderBy(*order)
    best = df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
    return best if rank else best.drop(out)


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one greatest in ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in (*order, *rest)]).select(*df.columns)


def salted_lookup(
    df: DataFrame, lookup: DataFrame, keys: list[str], spread_by: Column, how: str = "inner", salts: int = 32
) -> DataFrame:
    """Join rows with a lookup of one row per key, a busy key over many tasks.

    Meant for joins whose result is grouped by the same keys: there Spark keeps
    the join's partitioning and does not split a skewed part by itself.
    """
    wide = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return salted.join(wide, [*keys, "_salt"], how).drop("_salt")

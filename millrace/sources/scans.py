"""Incremental scans with a cursor, recent rows, full state loads, catalog lists."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cursor:
    """Position in a table ordered by time, with ties told apart by an id."""

    ts: datetime
    tie: int | None = None


def after_cursor(ts_col: str, tie_col: str | None, cursor: Cursor) -> Column:
    """Plain comparisons, so the file scan or database can evaluate them."""
    ts = F.col(ts_col)
    at = F.lit(cursor.ts).cast("timestamp_ntz")
    if tie_col is None or cursor.tie is None:
        return ts > at
    return (ts > at) | ((ts == at) & (F.col(tie_col) > cursor.tie))


def incremental_scan(
    df: DataFrame,
    ts_col: str,
    tie_col: str | None,
    cursor: Cursor,
    limit: int | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Rows after the cursor, oldest first.

    With ``tie_col`` no row is lost when more than ``limit`` rows share a time;
    ``tie_col=None`` compares the time alone, as a strict poll does.
    """
    rows = df.where(after_cursor(ts_col, tie_col, cursor))
    if columns:
        rows = rows.select(*columns)
    if limit is None:
        return rows
    return rows.orderBy(ts_col, *([tie_col] if tie_col else [])).limit(limit)


def next_cursor(rows: DataFrame, ts_col: str, tie_col: str | None, cursor: Cursor) -> Cursor:
    """The position after ``rows``; unchanged when there are none."""
    if tie_col is None:
        newest = rows.agg(F.max(ts_col)).first()[0]
        return Cursor(newest) if newest is not None else cursor
    newest = rows.agg(F.max(F.struct(ts_col, tie_col))).first()[0]
    return Cursor(newest[0], newest[1]) if newest is not None else cursor


def first_time(df: DataFrame, ts_col: str) -> DataFrame:
    return df.agg(F.min(ts_col).alias("first_ts"))


def init_cursors(
    ledger: DataFrame,
    now: datetime | Column,
    ts_col: str = "txn_ts",
    lookback_seconds: int = 10,
    tables: tuple[str, ...] = ("accounts", "customers", "member_updates"),
) -> DataFrame:
    """Starting cursor per table as rows (table_name, cursor_ts).

    The ledger starts a little before ``now``, or a second before its first row
    when that is earlier; the other tables start at ``now``.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    now = now.cast("timestamp_ntz")
    back = (now - F.make_dt_interval(secs=F.lit(lookback_seconds))).cast("timestamp_ntz")
    first = (F.min(ts_col) - F.make_dt_interval(secs=F.lit(1))).cast("timestamp_ntz")
    start = ledger.agg(first.alias("_first")).select(
        F.least(back, F.col("_first")).alias("_ledger"), now.alias("_now")
    )
    entries = [F.struct(F.lit("transactions").alias("table_name"), F.col("_ledger").alias("cursor_ts"))]
    entries += [F.struct(F.lit(t).alias("table_name"), F.col("_now").alias("cursor_ts")) for t in tables]
    return start.select(F.inline(F.array(*entries)))


def recent_rows(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The newest ``n`` rows; a partial top-n runs in every task first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def load_account_state(accounts: DataFrame) -> DataFrame:
    return accounts.select("account_id", "customer_id", "account_type", "balance")


def list_tables(spark: SparkSession, schema: str) -> DataFrame:
    """Names and kinds of the tables in a schema."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(schema)]
    return spark.createDataFrame(rows, "table_name string, table_type string, is_temporary boolean")


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    split_column: str | None = None,
    low=None,
    high=None,
    splits: int = 8,
) -> DataFrame:
    """A database table; cursor filters on it are evaluated by the database.

    With a split column the read is divided over ``splits`` tasks.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if split_column:
        reader = reader.options(
            partitionColumn=split_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(splits)
        )
    return reader.load()

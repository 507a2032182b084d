"""Serving queries over the current-state tables and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import full_name, latency_ms
from millrace.operators.ordered import top_per_key

_FEW_ROWS = 10_000
FEED_COLUMNS = (
    "txn_id", "account_id", "txn_type", "amount", "merchant", "txn_ts", "source_write_ts", "ingest_ts",
)


def _sla() -> Column:
    return latency_ms("source_write_ts", "ingest_ts").alias("sla_ms")


def account_activity(accounts: DataFrame, customers: DataFrame, landing: DataFrame) -> DataFrame:
    """Every landed transaction with its account's state and owner."""
    owners = accounts.select(
        "account_id", "customer_id", "account_type", F.col("balance").alias("current_balance"), "status",
        latency_ms("source_updated_at", "updated_at").alias("write_ms"),
    ).join(
        customers.select("customer_id", full_name("first_name", "last_name").alias("customer_name"), "email"),
        "customer_id",
    )
    return landing.join(owners, "account_id").select(
        "account_id", "account_type", "current_balance", "status", "customer_name", "email",
        "txn_id", "txn_type", "amount", "merchant", "description", "txn_ts", "source_write_ts", "ingest_ts",
        _sla(), "write_ms",
    )


def account_lookup(accounts: DataFrame, customers: DataFrame, account_id) -> DataFrame:
    """One account with its owner.

    Nothing enforces that an account is one row, so its rows are counted, no further than
    the bound, before they are broadcast.
    """
    one = accounts.where(F.col("account_id") == account_id)
    small = one.limit(_FEW_ROWS + 1).count() <= _FEW_ROWS
    return (F.broadcast(one) if small else one).join(customers, "customer_id").select(
        "account_id", "account_type", "balance", "status",
        one["updated_at"].alias("updated_at"), one["source_updated_at"].alias("source_updated_at"),
        full_name("first_name", "last_name").alias("customer_name"),
        "first_name", "last_name", "email", "phone",
        latency_ms(one["source_updated_at"], one["updated_at"]).alias("write_ms"),
    )


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def account_history(landing: DataFrame, account_id=None, n: int = 20) -> DataFrame:
    """The latest ``n`` transactions of one account, or of every account."""
    columns = ["account_id", "txn_id", "txn_type", "amount", "merchant", "description",
               "txn_ts", "source_write_ts", "ingest_ts"]
    newest = [F.desc("txn_ts"), F.desc("txn_id")]
    if account_id is not None:
        rows = landing.where(F.col("account_id") == account_id).orderBy(*newest).limit(n)
    else:
        rows = top_per_key(landing.select(*columns), ["account_id"], newest, n)
    return rows.select(*columns, _sla())


def live_feed(landing: DataFrame, n: int = 50) -> DataFrame:
    """The latest ``n`` landed rows by ingest time."""
    return (
        landing.select(*FEED_COLUMNS)
        .orderBy(F.desc("ingest_ts"), F.desc("txn_id"))
        .limit(n)
        .withColumn("sla_ms", latency_ms("source_write_ts", "ingest_ts"))
    )


def unseen(rows: DataFrame, seen: DataFrame, key: str = "txn_id") -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def merge_feed(new: DataFrame, shown: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    """Unseen rows in front of those already shown, cut to ``n``.

    ``order`` is the display order inside each generation, newest first. Both
    sides are at most ``n`` rows after their own top-n, the bound for broadcasting.
    """
    newest = [F.desc(c) for c in order]
    old = shown.orderBy(*newest).limit(n)
    fresh = new.join(F.broadcast(old.select("txn_id")), "txn_id", "left_anti").orderBy(*newest).limit(n)
    merged = fresh.withColumn("is_new", F.lit(True)).unionByName(old.withColumn("is_new", F.lit(False)))
    return merged.orderBy(F.desc("is_new"), *newest).limit(n)


def since(df: DataFrame, ts_col: str, as_of: Column, minutes: int = 5) -> DataFrame:
    """Rows not older than ``minutes`` before ``as_of``."""
    start = (as_of.cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))).cast("timestamp_ntz")
    return df.where(F.col(ts_col) >= start)


def known_ids(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose id is present and not zero."""
    return rows.where(F.col(key).isNotNull() & (F.col(key) != 0))


def only_listed(df: DataFrame, ids: DataFrame, key: str, counted: bool = False) -> DataFrame:
    """IN-list against another result; broadcast only where the caller has counted it."""
    wanted = ids.select(key)
    return df.join(F.broadcast(wanted) if counted else wanted, key, "left_semi")

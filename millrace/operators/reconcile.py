"""Source against landing: what arrived, what is pending, and how late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import latency_ms, null_if_zero
from millrace.operators.serving import known_ids, only_listed
from millrace.session import cut_lineage

_BOUNDED_ROWS = 10_000


def reconcile(
    source: DataFrame,
    landing: DataFrame,
    accounts: DataFrame,
    source_rows: int | None = None,
    zero_as_null: bool = False,
) -> DataFrame:
    """Each source row with its landed row, if any, and the current balance.

    Repeated landed ids count once, the newest. ``source_rows`` says that the source
    side is a top-n: it is worked out once and counted, and if it is small, landing and accounts are
    filtered by broadcast ids, so that neither big table is shuffled.
    """
    small = False
    if source_rows is not None:
        source = cut_lineage(source)
        small = source.count() <= _BOUNDED_ROWS
    arrivals = known_ids(landing.select("txn_id", "source_write_ts", "ingest_ts"), "txn_id")
    balances = accounts.select("account_id", F.col("balance").alias("current_balance"))
    if small:
        arrivals = only_listed(arrivals, source, "txn_id", counted=True)
        balances = only_listed(balances, source, "account_id", counted=True)
    sla = latency_ms("source_write_ts", "ingest_ts")
    # Times only, so copies of an id are combined in a hash table before the shuffle.
    newest = arrivals.groupBy("txn_id").agg(
        F.max_by("source_write_ts", "ingest_ts").alias("source_write_ts"), F.max("ingest_ts").alias("ingest_ts")
    )
    landed = newest.select(
        "txn_id",
        F.lit(True).alias("arrived"),
        "ingest_ts",
        (null_if_zero(sla) if zero_as_null else sla).alias("sla_ms"),
    )
    return (
        source.join(landed, "txn_id", "left")
        .join(balances, "account_id", "left")
        .select(
            "txn_id", "account_id", "txn_type", "amount", "merchant", "source_write_ts",
            F.col("balance_after").alias("source_balance_after"),
            F.coalesce("arrived", F.lit(False)).alias("arrived"),
            "ingest_ts", "sla_ms", "current_balance",
        )
    )


def delivery_rate(arrived: Column, total: Column) -> Column:
    """Whole percent; null without source rows."""
    return F.round(arrived * 100 / F.nullif(total, F.lit(0)), 0).cast("long")


def delivery_counts(matched: DataFrame) -> DataFrame:
    counts = matched.agg(
        F.count("*").alias("source_count"),
        F.count_if("arrived").alias("arrived_count"),
        F.count_if(~F.col("arrived")).alias("pending_count"),
    )
    return counts.withColumn("delivered_pct", delivery_rate(F.col("arrived_count"), F.col("source_count")))


def distinct_accounts(rows: DataFrame) -> DataFrame:
    return rows.select("account_id").distinct()

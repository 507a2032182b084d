"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local threads. Each
query runs once to warm up and then ``BENCH_RUNS`` times; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from millrace.plans.catalog import QUERIES
from millrace.plans.fixtures import Bank
from millrace.schemas import ACCOUNTS
from millrace.session import scratch_path
from millrace.sources.feeds import table_stream
from millrace.sources.store import SnapshotTable
from millrace.streaming.merges import AppendWriter, ProgressLog, start

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "account_activity", "account_lookup", "account_history_topn", "live_feed_50", "feed_merge",
    "reconcile_recent", "reconcile_all", "landing_sla_5min", "latency_percentiles", "rolling_percentiles",
    "status_row", "incremental_txn", "incremental_backlog", "parse_flat", "parse_envelope",
    "fold_members", "net_changes", "merge_members", "merge_accounts", "merge_customers",
    "apply_ledger", "running_balance", "balance_breaks", "ledger_replay",
    "quality_rejects", "fk_orphans", "display_columns", "stream_members", "stream_dedup",
]
READS = 20


def run(spark: SparkSession, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def point_read(spark: SparkSession) -> float:
    """Seconds of one read by key from a stored table, the mean of ``READS``."""
    bank = Bank(spark, FOLDER)
    table = SnapshotTable(spark, scratch_path(spark, "bench-accounts"), ACCOUNTS.schema, ("account_id",))
    table.commit(bank.accounts.select(*ACCOUNTS.schema.names), "load", 0)
    ids = [r[0] for r in bank.accounts.select("account_id").limit(READS + 3).collect()]
    times = []
    for account in ids:
        started = time.perf_counter()
        table.lookup(account).collect()
        times.append(time.perf_counter() - started)
    return sum(times[3:]) / len(times[3:])


def stream_tick(spark: SparkSession) -> float:
    """Seconds of one micro-batch that appends to the ledger under the 500 ms trigger, the mean after the first."""
    base = scratch_path(spark, "bench-tick")
    landing = Bank(spark, FOLDER).landing().limit(8000)
    landing.repartition(8).write.parquet(f"{base}/in")
    progress = ProgressLog()
    spark.streams.addListener(progress)
    try:
        stream = table_stream(spark, f"{base}/in", landing.schema, files_per_batch=1)
        query = start(stream.drop("ingest_ts"), AppendWriter(f"{base}/out"), f"{base}/checkpoint")
        query.processAllAvailable()
        query.stop()
    finally:
        spark.streams.removeListener(progress)
    spent = [ms for _, rows, ms in progress.entries if rows][1:]
    return sum(spent) / len(spent) / 1000


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        slow = name.startswith("stream_")
        if not slow:
            run(spark, name)
        times[name] = round(min(run(spark, name) for _ in range(1 if slow else RUNS)), 3)
    if not sys.argv[1:]:
        times["point_read"] = round(point_read(spark), 3)
        times["stream_tick"] = round(stream_tick(spark), 3)
    spark.stop()
    line = {
        "metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

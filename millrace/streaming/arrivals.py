"""Reconciliation of two streams by id, with timers: pending after a deadline, arrived whenever the row lands.

Rows are matched by id alone, whatever their clocks say: a row that lands long after
its deadline, or is stamped before it was written, still ends as arrived. A
processing-time timer reports what is open at its deadline; a landing that comes
later follows as a correction. State holds open rows only, packed per bucket of ids, so
that a batch costs a few state calls a bucket and works on whole arrays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from millrace.functions import latency_ms

# Tasks get the processor with the job, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])
#: ``transformWithState`` keeps its state in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A run to the end of what is there (``interval=None``) also needs this: Spark would run empty batches for timers without end.
TO_THE_END = {**STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
_COLUMNS = ["txn_id", "account_id", "has_account", "written", "landed", "kind"]
_WRITTEN, _LANDED, _TOLD = 1, 2, 4
_OUT = "txn_id long, account_id long, has_account long, written long, landed long, kind long"


class Arrivals(StatefulProcessor):
    """Open rows of one bucket: ``kind`` tells whether a row was written, has landed, has been reported."""

    def __init__(self, deadline_ms: int):
        self.deadline = deadline_ms * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        parts = [self._held(), *[r[_COLUMNS].to_numpy(np.int64) for r in rows]]
        yield self._settle(np.concatenate(parts), timer_values.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        yield self._settle(self._held(), timer_values.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass

    def _held(self) -> np.ndarray:
        held = self.state.get() if self.state.exists() else None
        return np.frombuffer(held[0], np.int64).reshape(-1, len(_COLUMNS)) if held else np.zeros((0, len(_COLUMNS)), np.int64)

    def _settle(self, rows: np.ndarray, now_ms: int) -> pd.DataFrame:
        """What has arrived, and what is open at its deadline; the rest waits."""
        rows = one_per_id(rows)
        written, landed, told = ((rows[:, 5] & flag) > 0 for flag in (_WRITTEN, _LANDED, _TOLD))
        arrived = written & landed
        due = rows[:, 3] + self.deadline
        late = written & ~landed & ~told & (due <= now_ms * 1000)
        out = rows[arrived | late].copy()
        rows[late, 5] |= _TOLD
        left = rows[~arrived]
        if len(left):
            self.state.update((left.tobytes(),))
        else:
            self.state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waiting = due[written & ~landed & ~told & ~late]
        if len(waiting):
            self.handle.registerTimer(int(-(-waiting.min() // 1000)))
        return pd.DataFrame(out, columns=_COLUMNS)


def one_per_id(rows: np.ndarray) -> np.ndarray:
    """Rows of one id as one: the earliest write with its account, the earliest landing, all flags."""
    order = np.lexsort((rows[:, 3], (rows[:, 5] & _WRITTEN) == 0, rows[:, 0]))
    rows = rows[order]
    starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, np.int64)
    merged = rows[starts].copy()
    if len(rows):
        merged[:, 5] = np.bitwise_or.reduceat(rows[:, 5], starts)
        never = np.iinfo(np.int64).max
        earliest = np.minimum.reduceat(np.where(rows[:, 5] & _LANDED, rows[:, 4], never), starts)
        merged[:, 4] = np.where(earliest == never, 0, earliest)
    return merged


def arrivals(source: DataFrame, landing: DataFrame, deadline_ms: int = 60_000, buckets: int = 256) -> DataFrame:
    """A row (txn_id, account_id, source_write_ts, arrived, ingest_ts, sla_ms) per report: open at the deadline, or arrived.

    ``source`` has txn_id, account_id and source_write_ts, ``landing`` txn_id and ingest_ts; rows without an id
    or time cannot be matched and are left out. A row that was reported open is reported
    again when it lands; ``settled`` keeps the last word. ``buckets`` is at least the
    number of tasks and fixed for the life of a checkpoint. The session needs the settings of ``STORE``.
    """
    nothing = F.lit(0).cast("long")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    wrote = source.where("txn_id is not null and source_write_ts is not null").select(
        "txn_id", F.coalesce("account_id", nothing).alias("account_id"), F.col("account_id").isNotNull().cast("long").alias("has_account"),
        micros("source_write_ts").alias("written"), nothing.alias("landed"), F.lit(_WRITTEN).cast("long").alias("kind"),
    )
    came = landing.where("txn_id is not null and ingest_ts is not null").select(
        "txn_id", nothing.alias("account_id"), nothing.alias("has_account"), nothing.alias("written"), micros("ingest_ts").alias("landed"),
        F.lit(_LANDED).cast("long").alias("kind"),
    )
    both = wrote.unionByName(came).withColumn("bucket", F.pmod(F.xxhash64("txn_id"), F.lit(buckets)).cast("int"))
    found = both.groupBy("bucket").transformWithStateInPandas(Arrivals(deadline_ms), _OUT, "Append", "ProcessingTime")
    arrived = F.col("kind").bitwiseAND(_LANDED) != 0
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    told = found.select(
        "txn_id", F.when(F.col("has_account") == 1, F.col("account_id")).alias("account_id"), time("written").alias("source_write_ts"),
        arrived.alias("arrived"), F.when(arrived, time("landed")).alias("ingest_ts"),
    )
    return told.withColumn("sla_ms", latency_ms("source_write_ts", "ingest_ts"))


def settled(reports: DataFrame) -> DataFrame:
    """One row per id: arrived if any report says so, then the earliest landing."""
    rest = [c for c in reports.columns if c != "txn_id"]
    best = reports.groupBy("txn_id").agg(
        F.min(F.struct((~F.col("arrived")).alias("open"), "ingest_ts", "source_write_ts", "account_id", "sla_ms", "arrived")).alias("r")
    )
    return best.select("txn_id", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*reports.columns)

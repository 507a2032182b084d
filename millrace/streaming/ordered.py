"""Micro-batches merged by position, so that neither batch boundaries nor arrival order change the result."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import utc_now
from millrace.operators import foldstate
from millrace.operators.changes import SKIP
from millrace.operators.foldstate import DELETED, LAST, FoldRule
from millrace.operators.merge import BROADCAST_ROWS
from millrace.operators.ordered import number_rows
from millrace.sources.store import SnapshotTable
from millrace.streaming.merges import BatchLog, observed

STAMP, ID, ID_AT = "stamped", "surrogate", "surrogate_at"


@dataclass
class OrderedTable:
    """A table of unique keys, stored as fold states; a deleted key keeps its state, so that older changes stay older.

    ``id_column`` numbers rows in the order in which their lifetimes were first seen live; a key that was deleted and came
    back gets a new number. ``stamp_column`` holds the time of the last write to a key, ``constants`` columns that all rows share.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    rule: FoldRule
    id_column: str | None = None
    stamp_column: str | None = None
    constants: dict[str, Column] = field(default_factory=dict)
    buckets: int | None = None

    def __post_init__(self):
        extra = [
            T.StructField(STAMP, T.TimestampNTZType()), T.StructField(ID, T.LongType()), T.StructField(ID_AT, self.rule.position),
        ]
        stored = T.StructType([*self.rule.state_schema(self.schema).fields, *extra])
        self.states = SnapshotTable(self.spark, self.path, stored, self.rule.keys, self.buckets)

    def load(self, rows: DataFrame, given: dict[str, Column], writer: str = "load", batch_id: int = 0) -> None:
        """Start from rows whose changes are unknown, at their own source times."""
        seeded = foldstate.seed(rows, self.rule, given)
        kept = {STAMP: self.stamp_column, ID: self.id_column}
        extra = [F.col(c).alias(n) for n, c in kept.items() if c]
        own = rows.select(*self.rule.keys, *extra).withColumn("_held", F.lit(True))
        held = seeded.join(own, list(self.rule.keys))
        full = held.withColumns({
            **{n: F.lit(None) for n, c in kept.items() if not c}, ID_AT: F.col(f"{LAST}.at"),
        })
        highest = full.agg(F.coalesce(F.max(ID).cast("long"), F.lit(0).cast("long"))).first()[0]
        self.states.commit(full.select(*self.states.schema.names), writer, batch_id, last_id=highest)

    def _rows(self, states: DataFrame) -> DataFrame:
        live = states.where(foldstate.is_live())
        made = live.select(*foldstate.values(self.rule), F.col(STAMP).alias("_stamp"), F.col(ID).alias("_id"))
        named = {c.name: F.col(c.name) if c.name in made.columns else F.lit(None) for c in self.schema}
        named.update(self.constants)
        if self.stamp_column:
            named[self.stamp_column] = F.col("_stamp")
        if self.id_column:
            named[self.id_column] = F.col("_id")
        return made.select(*[named[f.name].cast(f.dataType).alias(f.name) for f in self.schema])

    def read(self) -> DataFrame:
        return self._rows(self.states.read())

    def lookup(self, *key) -> DataFrame:
        return self._rows(self.states.lookup(*key))


@dataclass
class OrderedWriter:
    """Merge a batch of routed changes into an ``OrderedTable``; only buckets with a changed key are read and written.

    A batch that is committed already is left out, and since states merge by maxima,
    changes that come again under another batch number alter nothing either.
    """

    table: OrderedTable
    name: str = "member"
    stamp: Column = field(default_factory=utc_now)
    log: BatchLog | None = None

    def __call__(self, changes: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        if self.table.states.head().has_batch(self.name, batch_id):
            return
        try:
            outcome = self._merge(changes, batch_id)
        except Exception:
            if self.log:
                self.log.write_failure(self.table.spark, self.name, batch_id)
            raise
        if self.log:
            self.log.write(self.table.spark, self.name, batch_id, outcome["changes"], started, outcome)

    def _merge(self, changes: DataFrame, batch_id: int) -> dict[str, int]:
        table, rule = self.table, self.table.rule
        before = table.states.head()
        read = Observation()
        seen = changes.where(F.col("action") != SKIP).observe(read, F.count("*").alias("changes"))
        folded = foldstate.state_of(seen, rule).withColumn(STAMP, self.stamp.cast("timestamp_ntz")).persist()
        try:
            # One row per touched bucket.
            sizes = folded.groupBy(table.states.bucket().alias("b")).count().collect()
            touched = {r["b"] for r in sizes}
            if not touched:
                table.states.switch(table.states.following(before, self.name, batch_id, touched))
                return dict.fromkeys(("changes", "matched", "inserted", "deleted"), 0)
            old = table.states.read(before, touched).withColumn("_was", foldstate.is_live())
            kept = {STAMP: F.max(STAMP), ID: F.max(ID), ID_AT: F.max(ID_AT), "_was": F.max("_was"), "_hit": F.max("_hit")}
            merged = foldstate.merge_states(old, folded.withColumn("_hit", F.lit(True)), rule, kept)
            last_id = before.last_id
            if table.id_column:
                few = sum(r["count"] for r in sizes) <= BROADCAST_ROWS
                merged, last_id = self._numbered(merged.persist(), last_id, few)
            live, was, hit = foldstate.is_live(), F.coalesce("_was", F.lit(False)), F.coalesce("_hit", F.lit(False))
            counted = Observation()
            written = merged.observe(
                counted, F.count_if(hit & live & was).alias("matched"), F.count_if(live & ~was).alias("inserted"),
                F.count_if(hit & ~live & was).alias("deleted"),
            )
            table.states.write_version(written, before.version + 1)
            outcome = {**observed(read), **observed(counted)}
        finally:
            folded.unpersist()
            if table.id_column and touched:
                self._held.unpersist()
        table.states.switch(table.states.following(before, self.name, batch_id, touched, last_id, outcome))
        return outcome

    def _numbered(self, merged: DataFrame, last_id: int, few: bool) -> tuple[DataFrame, int]:
        """Live states without a number of this lifetime get the next ones, in the order of their changes."""
        self._held = merged
        current = F.col(ID).isNotNull() & (F.col(DELETED).isNull() | (F.col(ID_AT) > F.col(DELETED)))
        needs = foldstate.is_live() & ~current
        keys = list(self.table.rule.keys)
        new = merged.where(needs).select(*keys, F.col(f"{LAST}.at").alias("_at"))
        added = new.count()
        if not added:
            return merged, last_id
        if few:  # no more rows than the counted changes
            numbers = new.withColumn("_new", F.row_number().over(Window.orderBy("_at", *keys)) + F.lit(last_id).cast("long"))
        else:
            numbers = number_rows(new, ["_at", *keys], "_new", last_id)
        joined = merged.join(F.broadcast(numbers) if few else numbers, keys, "left")
        named = joined.withColumns({ID: F.coalesce("_new", ID), ID_AT: F.coalesce("_at", ID_AT)})
        return named.drop("_new", "_at"), last_id + added

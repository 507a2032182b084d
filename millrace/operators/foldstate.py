"""Fold states: all changes of a key, in a form that merges in any order and any grouping.

``fold_changes`` gives the effect of the changes of one batch. A batch cut elsewhere, or a
change that arrives after newer ones, needs more: the position of the latest value of
every column, of the last upsert and of the last delete. Each of these is a maximum over
the changes, so states merge by taking maxima: the result is the same in one batch or in
many, in order or not, and a change that is delivered twice counts once.

With a source time first in the order the newest change wins; with the position
in the topic, the last one written. Keys are unique here: one state each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.changes import DELETE, UPSERT

LAST, DELETED = "last", "deleted"


@dataclass(frozen=True)
class FoldRule:
    """Which columns keep their latest value unless it is null (``merged``) or always (``replaced``), and the order of changes.

    ``order`` names the order's columns and types; it is unique per key, and a null in one of them comes first.
    """

    keys: tuple[str, ...]
    order: str
    merged: tuple[str, ...] = ()
    replaced: tuple[str, ...] = ()

    @property
    def position(self) -> T.StructType:
        return T.StructType.fromDDL(self.order)

    def entry(self, column: str) -> str:
        return f"latest_{column}"

    @property
    def entries(self) -> list[str]:
        return [*[self.entry(c) for c in self.merged], LAST, DELETED]

    def state_schema(self, rows: T.StructType) -> T.StructType:
        """The stored form of the states of rows that have the columns of ``rows``."""
        at = T.StructField("at", self.position)
        fields = [rows[k] for k in self.keys]
        fields += [T.StructField(self.entry(c), T.StructType([at, T.StructField("v", rows[c].dataType)])) for c in self.merged]
        fields.append(T.StructField(LAST, T.StructType([at, *[rows[c] for c in self.replaced]])))
        return T.StructType([*fields, T.StructField(DELETED, self.position)])

    def at(self, given: dict[str, Column]) -> Column:
        return F.struct(*[given[f.name].cast(f.dataType).alias(f.name) for f in self.position])

    def parts(self, rows: DataFrame, at: Column, where: Column) -> list[Column]:
        """The entries that one row contributes where it is an upsert."""
        merged = [
            F.when(where & F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))).alias(self.entry(c)) for c in self.merged
        ]
        return [*merged, F.when(where, F.struct(at.alias("at"), *[F.col(c) for c in self.replaced])).alias(LAST)]


def state_of(changes: DataFrame, rule: FoldRule, action: str = "action") -> DataFrame:
    """One state per changed key; a change that is null in all of the order is refused."""
    names = rule.position.names
    known = reduce(Column.__or__, [F.col(c).isNotNull() for c in names])
    at = F.when(known, rule.at({c: F.col(c) for c in names})).otherwise(F.raise_error(F.lit(f"a change has no value in {', '.join(names)}")))
    upsert, delete = F.col(action) == UPSERT, F.col(action) == DELETE
    entries = [*rule.parts(changes, at, upsert), F.when(delete, at).alias(DELETED)]
    each = changes.where(upsert | delete).select(*rule.keys, *entries)
    return each.groupBy(*rule.keys).agg(*[F.max(c).alias(c) for c in rule.entries])


def seed(rows: DataFrame, rule: FoldRule, given: dict[str, Column]) -> DataFrame:
    """States of rows that are there already, at the order values ``given``; other parts of the order are null and come first.

    So a change of the row's own source time is applied over it, an older one is not.
    Rows that repeat a key are refused, since one state cannot stand for several rows.
    """
    at = rule.at({c: given.get(c, F.lit(None)) for c in rule.position.names})
    each = rows.select(*rule.keys, *rule.parts(rows, at, F.lit(True)))
    once = each.groupBy(*rule.keys).agg(F.count("*").alias("_rows"), *[F.max(c).alias(c) for c in rule.entries if c != DELETED])
    repeated = F.raise_error(F.lit(f"rows repeat a key of {', '.join(rule.keys)}"))
    checked = once.withColumn(LAST, F.when(F.col("_rows") == 1, F.col(LAST)).otherwise(repeated))
    return checked.drop("_rows").withColumn(DELETED, F.lit(None).cast(rule.position))


def merge_states(states: DataFrame, more: DataFrame, rule: FoldRule, kept: dict[str, Column] | None = None) -> DataFrame:
    """One state per key of both; ``kept`` names further aggregates over a key's (at most two) rows."""
    both = states.unionByName(more, allowMissingColumns=True)
    return both.groupBy(*rule.keys).agg(*[F.max(c).alias(c) for c in rule.entries], *[v.alias(c) for c, v in (kept or {}).items()])


def is_live() -> Column:
    """A key has a row if an upsert follows its last delete."""
    return F.col(LAST).isNotNull() & (F.col(DELETED).isNull() | (F.col(f"{LAST}.at") > F.col(DELETED)))


def values(rule: FoldRule) -> list[Column]:
    """The columns of a live state's row: keys, merged and replaced."""
    since = lambda at: F.col(DELETED).isNull() | (F.col(at) > F.col(DELETED))
    merged = [F.when(since(f"{rule.entry(c)}.at"), F.col(f"{rule.entry(c)}.v")).alias(c) for c in rule.merged]
    return [*[F.col(k) for k in rule.keys], *merged, *[F.col(f"{LAST}.{c}").alias(c) for c in rule.replaced]]

"""Fold many ordered changes per key into one effect per key.

The result equals applying the changes one at a time: a delete wipes what came
before it, later upserts build up again, null attributes leave values alone.
All of it is one aggregation, so rows of a busy key are combined on the map
side and no task ever holds a key's whole history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import salted_lookup

UPSERT, DELETE, SKIP = "upsert", "delete", "skip"


def _order(order: list[str]) -> Column:
    """The order value; a change without any is refused, since it would be lost without a trace.

    Where there are several columns, a null in one of them comes first.
    """
    refused = F.raise_error(F.lit(f"a change has no value in {', '.join(order)}"))
    if len(order) == 1:
        return F.coalesce(F.col(order[0]), refused)
    known = reduce(Column.__or__, [F.col(c).isNotNull() for c in order])
    return F.when(known, F.struct(*order)).otherwise(refused)


def fold_changes(
    changes: DataFrame,
    keys: list[str],
    order: list[str],
    merged: list[str] = (),
    replaced: list[str] = (),
    action: str = "action",
) -> DataFrame:
    """One row per key.

    ``merged`` columns keep the latest non-null value since the last delete;
    ``replaced`` columns take the last upsert's value even when it is null.
    ``order`` is unique per key; a row that is null in all of it is refused.

    Added columns: ``wiped`` (a delete happened), ``live`` (an upsert follows the
    last delete), ``first_upsert``, ``last_upsert``, ``last_delete``, ``changes``.
    """
    at = _order(list(order))
    is_upsert = F.col(action) == UPSERT
    is_delete = F.col(action) == DELETE
    found = [
        F.max(F.when(is_upsert & F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(f"_m_{c}")
        for c in merged
    ]
    if replaced:
        found.append(
            F.max(F.when(is_upsert, F.struct(at.alias("at"), *[F.col(c) for c in replaced]))).alias("_last")
        )
    grouped = changes.groupBy(*keys).agg(
        F.min(F.when(is_upsert, at)).alias("first_upsert"),
        F.max(F.when(is_upsert, at)).alias("last_upsert"),
        F.max(F.when(is_delete, at)).alias("last_delete"),
        F.count(F.when(is_upsert | is_delete, 1)).alias("changes"),
        *found,
    )
    wiped = F.col("last_delete").isNotNull()
    live = F.col("last_upsert").isNotNull() & (~wiped | (F.col("last_upsert") > F.col("last_delete")))

    def since_delete(entry: str, field: str) -> Column:
        e = F.col(entry)
        return F.when(~wiped | (e["at"] > F.col("last_delete")), e[field])

    return grouped.where(F.col("changes") > 0).select(
        *keys,
        wiped.alias("wiped"),
        live.alias("live"),
        *[since_delete(f"_m_{c}", "v").alias(c) for c in merged],
        *[since_delete("_last", c).alias(c) for c in replaced],
        "first_upsert",
        "last_upsert",
        "last_delete",
        "changes",
    )


def with_birth(
    folded: DataFrame, changes: DataFrame, keys: list[str], order: list[str], action: str = "action"
) -> DataFrame:
    """Add ``born``: the first upsert of each live key's current lifetime.

    Only keys that were deleted and came back need a second look at the changes.
    That look is salted, so a busy key is read by many tasks.
    """
    at = _order(list(order))
    reborn = folded.where("wiped and live").select(*keys, F.col("last_delete").alias("_cut"))
    upserts = changes.where(F.col(action) == UPSERT).select(*keys, at.alias("_at"))
    births = (
        salted_lookup(upserts, reborn, list(keys), F.col("_at"))
        .where(F.col("_at") > F.col("_cut"))
        .groupBy(*keys)
        .agg(F.min("_at").alias("_born"))
    )
    return (
        folded.join(births, list(keys), "left")
        .withColumn("born", F.when(F.col("live"), F.coalesce("_born", "first_upsert")))
        .drop("_born")
    )


def net_changes(
    changes: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    low,
    high,
    action: str = "action",
) -> DataFrame:
    """Net effect per key of the changes with ``low < order <= high``.

    ``changes`` reaches back to the beginning: a key's state before the range
    tells an insert from an update, and a key that came and went has no row.
    """
    at = F.col(order[0])
    is_change = F.col(action).isin(UPSERT, DELETE)
    seen = changes.where(is_change & (at <= F.lit(high)))
    before = F.when(at <= F.lit(low), F.struct(at.alias("at"), (F.col(action) == UPSERT).alias("up")))
    inside = F.when(at > F.lit(low), F.struct(at.alias("at"), (F.col(action) == UPSERT).alias("up")))
    existed = seen.groupBy(*keys).agg(
        F.max(before).alias("_before"),
        F.max(inside).alias("_last"),
    )
    state = (
        existed.where(F.col("_last").isNotNull())
        .withColumn("_was", F.coalesce(F.col("_before")["up"], F.lit(False)))
        .withColumn("_is", F.col("_last")["up"])
        .where("_was or _is")
    )
    values = fold_changes(seen, keys, order, merged=columns, action=action).select(*keys, *columns)
    op = (
        F.when(F.col("_was") & F.col("_is"), "update")
        .when(F.col("_is"), "insert")
        .otherwise("delete")
    )
    return (
        state.select(*keys, op.alias("net_op"))
        .join(values, list(keys))
        .select(
            *keys, "net_op",
            *[F.when(F.col("net_op") != "delete", F.col(c)).alias(c) for c in columns],
        )
    )

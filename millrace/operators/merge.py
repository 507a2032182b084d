"""Keyed merge, delete and update over whole snapshots.

Parquet tables have no row-level MERGE, so a merge is: fold the changes to one
row per key, join once, write the new snapshot. The target is never grouped, so
a match key that repeats in the target updates all its rows and stays spread.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.changes import fold_changes, with_birth
from millrace.operators.ordered import CHUNK_ROWS, number_rows
from millrace.schemas import MEMBER_ATTRIBUTES, MEMBER_KEYS

# A folded batch is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class MergeRule:
    """How folded changes act on a target row.

    merged     take the new value unless it is null
    replaced   take the new value always
    on_insert  set when a row is new, kept when it exists
    stamps     constants set on both update and insert
    id_column  surrogate key given to new rows
    unique     the keys are unique in the target
    """

    keys: tuple[str, ...]
    merged: tuple[str, ...] = ()
    replaced: tuple[str, ...] = ()
    on_insert: tuple[str, ...] = ()
    stamps: dict[str, Column] = field(default_factory=dict)
    id_column: str | None = None
    unique: bool = False

    def fold(self, changes: DataFrame, order: list[str]) -> DataFrame:
        """One row per key; with a surrogate key also ``born``, the order of new rows."""
        folded = self.fold_only(changes, order)
        return with_birth(folded, changes, list(self.keys), order) if self.id_column else folded

    def fold_only(self, changes: DataFrame, order: list[str]) -> DataFrame:
        return fold_changes(
            changes, list(self.keys), order,
            merged=list(self.merged), replaced=[*self.replaced, *self.on_insert],
        )


def account_rule(batch_ts: Column) -> MergeRule:
    """Existing accounts take balance, status and times; type and owner stay."""
    return MergeRule(
        keys=("account_id",),
        replaced=("balance", "status", "source_updated_at"),
        on_insert=("customer_id", "account_type"),
        stamps={"updated_at": batch_ts},
        unique=True,
    )


def customer_rule(batch_ts: Column) -> MergeRule:
    """Every attribute is overwritten, blanks included."""
    return MergeRule(
        keys=("customer_id",),
        replaced=("first_name", "last_name", "email", "phone", "street", "city", "state", "zip", "source_updated_at"),
        stamps={"updated_at": batch_ts},
        unique=True,
    )


def member_rule(batch_ts: Column, tag: str = "EXTERNAL", carry_source_ts: bool = True) -> MergeRule:
    """Golden record matched on a secondary key; only given attributes change."""
    return MergeRule(
        keys=MEMBER_KEYS,
        merged=MEMBER_ATTRIBUTES,
        replaced=("source_updated_at",) if carry_source_ts else (),
        stamps={"source_system": F.lit(tag), "updated_at": batch_ts},
        id_column="member_id",
    )


def _is_small(folded: DataFrame, limit: int) -> bool:
    """Bounded check: stops counting at the limit."""
    return folded.limit(limit + 1).count() <= limit


def apply_merge(
    target: DataFrame,
    folded: DataFrame,
    rule: MergeRule,
    last_id: int | None = None,
    small: bool | None = None,
    max_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The target after the folded changes.

    ``folded`` is read several times; pass it persisted or checkpointed, with its
    ``hits`` from ``resolve`` if they are known. A small one (counted, or vouched for by ``small``) is broadcast and the target is not
    shuffled at all. Beyond that, unique keys meet in one full outer join; other
    keys use a left join, whose skewed parts Spark splits at run time.
    """
    keys = list(rule.keys)
    if small is None:
        small = _is_small(folded, BROADCAST_ROWS)
    if rule.unique and not small and not rule.id_column:
        return _merge_unique(target, folded, rule)
    folded = folded if "hits" in folded.columns else resolve(target, folded, keys, small)
    hint = F.broadcast if small else (lambda df: df)
    changed = [*rule.merged, *rule.replaced]
    effect = folded.select(
        *keys, F.lit(True).alias("_hit"), F.col("wiped").alias("_wiped"), F.col("live").alias("_live"),
        *[F.col(c).alias(f"_n_{c}") for c in changed],
    )
    updates = F.coalesce(F.col("_hit") & ~F.col("_wiped"), F.lit(False))

    def new_value(c: str) -> Column:
        if c in rule.merged:
            value = F.coalesce(F.col(f"_n_{c}"), F.col(c))
        elif c in rule.replaced:
            value = F.col(f"_n_{c}")
        elif c in rule.stamps:
            value = rule.stamps[c].cast(target.schema[c].dataType)
        else:
            return F.col(c)
        return F.when(updates, value).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)

    def fresh_row(c: str) -> Column:
        kind = target.schema[c].dataType
        if c in rule.stamps:
            value = rule.stamps[c]
        elif c in keys or c in (*changed, *rule.on_insert):
            value = F.col(c)
        elif c == rule.id_column:
            value = F.col("_id")
        else:
            value = F.lit(None)
        return value.cast(kind).alias(c)

    matched = target.join(hint(effect), keys, "left")
    kept = matched.where(~F.coalesce("_wiped", F.lit(False))).select(*[new_value(c) for c in target.columns])

    born = folded.where("live and (wiped or hits = 0)")
    if rule.id_column:
        start = last_id if last_id is not None else highest_id(target, rule.id_column)
        if small:
            # At most BROADCAST_ROWS rows: one task may number them.
            number = F.row_number().over(Window.orderBy("born", *keys))
            born = born.withColumn("_id", number + F.lit(start).cast("long"))
        else:
            born = number_rows(born, ["born", *keys], "_id", start, max_rows)
    inserted = born.select(*[fresh_row(c) for c in target.columns])
    return kept.unionByName(inserted)


def _merge_unique(target: DataFrame, folded: DataFrame, rule: MergeRule) -> DataFrame:
    keys = list(rule.keys)
    given = [*rule.merged, *rule.replaced, *rule.on_insert]
    effect = folded.select(
        *keys, "wiped", "live", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in given]
    )
    both = target.withColumn("_old", F.lit(True)).join(effect, keys, "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    updated = hit & F.col("_old").isNotNull() & ~F.col("wiped")
    fresh = hit & F.col("_old").isNull() & F.col("live") & ~F.col("wiped")
    stays = ~hit | updated | fresh

    def value(c: str) -> Column:
        old, new = F.col(c), F.col(f"_n_{c}")
        if c in keys:
            result = old
        elif c in rule.stamps:
            result = F.when(hit, rule.stamps[c]).otherwise(old)
        elif c in rule.merged:
            result = F.when(updated, F.coalesce(new, old)).when(hit, new).otherwise(old)
        elif c in rule.replaced:
            result = F.when(hit, new).otherwise(old)
        elif c in rule.on_insert:
            result = F.when(hit & ~updated, new).otherwise(old)
        else:
            result = F.when(~hit | updated, old)
        return result.cast(target.schema[c].dataType).alias(c)

    def again(c: str) -> Column:
        if c in rule.stamps:
            result = rule.stamps[c]
        else:
            result = F.col(c) if c in (*keys, *given) else F.lit(None)
        return result.cast(target.schema[c].dataType).alias(c)

    # A key that was deleted and came back is one row, however often the target held it.
    reborn = folded.where("wiped and live").select(*[again(c) for c in target.columns])
    return reborn.unionByName(both.where(stays).select(*[value(c) for c in target.columns]))


def resolve(target: DataFrame, folded: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Folded rows with ``hits``, the number of target rows of their key.

    The target side is counted per key before the join, so a key that repeats
    often in the target is one row there.
    """
    touched = target.select(*keys)
    if small:
        touched = touched.join(F.broadcast(folded.select(*keys)), list(keys), "left_semi")
    counted = touched.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return (
        folded.join(counted, list(keys), "left")
        .withColumn("hits", F.coalesce("_rows", F.lit(0).cast("long")))
        .drop("_rows")
    )


def highest_id(target: DataFrame, id_column: str) -> int:
    return target.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long")).first()[0]


def merge_outcomes(resolved: DataFrame) -> DataFrame:
    """One row: changes folded, target rows updated and deleted, rows inserted.

    Taken from the join itself: an update counts as matched, an insert never does.
    """
    return resolved.agg(
        F.coalesce(F.sum("changes"), F.lit(0)).alias("changes"),
        F.coalesce(F.sum(F.when(~F.col("wiped"), F.col("hits"))), F.lit(0)).alias("matched"),
        F.count_if(F.expr("live and (wiped or hits = 0)")).alias("inserted"),
        F.coalesce(F.sum(F.when(F.col("wiped"), F.col("hits"))), F.lit(0)).alias("deleted"),
    )


def delete_keys(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Remove every target row whose key is in ``gone``."""
    return target.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def update_columns(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overwrite some columns of existing rows; ``changes`` has one row per key."""
    new = changes.select(
        *keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in columns]
    )
    hit = F.coalesce("_hit", F.lit(False))
    return target.join(new, list(keys), "left").select(
        *[
            F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fill nulls, and add columns that are missing altogether."""
    filled = {
        c: F.coalesce(F.col(c), value) if c in df.columns else value for c, value in defaults.items()
    }
    return df.withColumns(filled)


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])

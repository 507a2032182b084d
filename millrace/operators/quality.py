"""Data-quality rules of a contract, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schemas import Contract


def violations(contract: Contract) -> Column:
    """Names of the broken rules of a row, as an array."""
    checks = [
        (F.col(c).isNull(), f"null:{c}") for c in contract.not_null
    ] + [
        (~F.col(c).isin(*allowed), f"domain:{c}") for c, allowed in contract.domains.items()
    ] + [
        (F.length(c) > n, f"length:{c}") for c, n in contract.max_length.items()
    ]
    return F.array_compact(F.array(*[F.when(broken, name) for broken, name in checks]))


def check_rows(df: DataFrame, contract: Contract) -> DataFrame:
    return df.withColumn("violations", violations(contract))


def split_valid(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with their violations; a bad row never stops a load."""
    checked = check_rows(df, contract)
    bad = F.size("violations") > 0
    return checked.where(~bad).drop("violations"), checked.where(bad)


def cut_to_length(df: DataFrame, contract: Contract) -> DataFrame:
    return df.withColumns(
        {c: F.substring(c, 1, n) for c, n in contract.max_length.items() if c in df.columns}
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Foreign-key values without a parent, with how many rows use each.

    Child rows are counted per key before the join, so a busy key is one row there.
    """
    used = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("child_rows"))
    known = parent.select(F.col(parent_key).alias(child_key))
    return used.join(known, child_key, "left_anti")


def mask_columns(
    df: DataFrame, columns: list[str], role, allowed: tuple[str, ...], mask: str = "****"
) -> DataFrame:
    """Show the columns to allowed roles only."""
    role = role if isinstance(role, Column) else F.lit(role)
    return df.withColumns(
        {c: F.when(role.isin(*allowed), F.col(c)).otherwise(F.lit(mask)) for c in columns}
    )

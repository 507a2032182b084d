"""Balances carried along a ledger: running totals, checks, updates and replay."""

from __future__ import annotations

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import overdraft
from millrace.operators.merge import update_columns
from millrace.operators.ordered import (
    BROADCAST_CHUNKS, CHUNK, CHUNK_ROWS, chunk_rows, previous_value, running_sum,
)
from millrace.operators.overdraft import MIN_CREDIT_CENTS
from millrace.schemas import DEPOSIT_ACCOUNT_TYPES, MONEY, OUTGOING_TYPES
from millrace.session import cut_lineage

ORDER = ["txn_ts", "txn_id"]

# The rule travels with the task, so workers need no copy of this package.
register_pickle_by_value(overdraft)


def running_balance(
    txns: DataFrame, accounts: DataFrame | None = None, out: str = "running_balance", max_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Sum of amounts per account in order, on top of an opening balance if given."""
    size = txns.count()
    if accounts is None:
        return running_sum(txns, ["account_id"], ORDER, F.col("amount"), out, max_rows, size)
    # Joined first: the ranges made next spread a busy account again.
    opening = accounts.select("account_id", F.col("balance").alias("_opening"))
    summed = running_sum(txns.join(opening, "account_id"), ["account_id"], ORDER, F.col("amount"), out, max_rows, size)
    return summed.withColumn(out, (F.col(out) + F.col("_opening")).cast(MONEY)).drop("_opening")


def last_balances(txns: DataFrame) -> DataFrame:
    return txns.groupBy("account_id").agg(
        F.max_by("balance_after", F.struct(*ORDER)).alias("balance"),
        F.max("txn_ts").alias("last_txn_ts"),
    )


def apply_ledger(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """Accounts with the balance after their last transaction."""
    latest = last_balances(txns).withColumnRenamed("last_txn_ts", "source_updated_at")
    return update_columns(accounts, latest, ["account_id"], ["balance", "source_updated_at"])


def balance_breaks(txns: DataFrame, accounts: DataFrame, max_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows whose balance does not follow from the row before, and accounts whose
    balance differs from the end of their ledger."""
    columns = ["account_id", "txn_id", "txn_ts", "amount", "balance_after"]
    chained = previous_value(txns.select(*columns), ["account_id"], ORDER, "balance_after", "_before", max_rows)
    expected = (F.col("_before") + F.col("amount")).cast(MONEY)
    steps = chained.where(F.col("_before").isNotNull() & (F.col("balance_after") != expected)).select(
        F.lit("step").alias("kind"), "account_id", "txn_id",
        expected.alias("expected"), F.col("balance_after").alias("found"),
    )
    ends = txns.groupBy("account_id").agg(
        F.max(F.struct(*ORDER, "balance_after")).alias("_end")
    )
    closing = (
        ends.join(accounts.select("account_id", "balance"), "account_id")
        .where(F.col("_end.balance_after") != F.col("balance"))
        .select(
            F.lit("end").alias("kind"), "account_id", F.col("_end.txn_id").alias("txn_id"),
            F.col("_end.balance_after").alias("expected"), F.col("balance").alias("found"),
        )
    )
    return steps.unionByName(closing)


# -- replay with the overdraft rule -----------------------------------------

_BOOKED = (
    "account_id long, chunk int, txn_id long, txn_ts timestamp_ntz, txn_type string, opening long, "
    "booked long, after long, accepted boolean"
)
_TRIED = "account_id long, chunk int, opening long, closing long"
_OPENINGS = "account_id long, chunk int, opening long, work boolean"
_ALWAYS = -(1 << 62)


def _need(prefix: str) -> Column:
    """The least opening balance from which a row books in full if all rows before it did."""
    return (
        F.when(~F.col("outgoing"), F.lit(MIN_CREDIT_CENTS) - F.col(prefix))
        .when(F.col("deposit"), -F.col(prefix))
        .otherwise(F.lit(_ALWAYS))
    )


def by_rule(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of every (account, chunk) that book in full from its opening balance, and those from the first one that does not.

    Both have ``start_at``: the balance before the row where all before it booked in
    full, and the balance before the first row of the rest.
    """
    so_far = (
        Window.partitionBy("account_id", "chunk")
        .orderBy(*ORDER)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.withColumn("_prefix", F.sum("cents").over(so_far)).withColumn("_need", _need("_prefix"))
    marked = summed.withColumn("_full", F.col("opening") >= F.max("_need").over(so_far))
    full = marked.where("_full").withColumn("start_at", F.col("opening") + F.col("_prefix") - F.col("cents"))
    last_full = F.last(F.when(F.col("_full"), F.col("_prefix")), ignorenulls=True).over(so_far)
    rest = marked.withColumn("start_at", F.col("opening") + F.coalesce(last_full, F.lit(0))).where("not _full")
    return full, rest


def _booked(rows: DataFrame) -> DataFrame:
    """Walk every (account, chunk) from its opening balance, in cents.

    Rows that book in full are sums; only those from the first other one on are walked in Python.
    """
    key = ["account_id", "chunk"]
    columns = [*key, *ORDER, "txn_type", "cents", "outgoing", "deposit", "opening"]
    full, rest = by_rule(rows.select(*columns))
    summed = full.select(
        *key, "txn_id", "txn_ts", "txn_type", "opening", F.col("cents").alias("booked"),
        (F.col("start_at") + F.col("cents")).alias("after"), F.lit(True).alias("accepted"),
    )
    sorted_rows = rest.select(*columns, "start_at").repartition(*key).sortWithinPartitions(*key, *ORDER)
    return summed.unionByName(sorted_rows.mapInPandas(overdraft.replay_sorted, _BOOKED))


def _in_money(booked: DataFrame) -> DataFrame:
    def money(c: str):
        return (F.col(c) / 100).cast(MONEY)

    return booked.select(
        "account_id", "txn_id", "txn_ts", "txn_type",
        F.when(F.col("accepted"), money("booked")).alias("amount"),
        money("after").alias("balance_after"), "accepted",
    )


def _chunk_summaries(rows: DataFrame) -> DataFrame:
    """Per (account, chunk): the total, and the least opening balance from which
    every row books in full, so that the chunk merely adds its total."""
    so_far = (
        Window.partitionBy("account_id", "chunk")
        .orderBy(*ORDER)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.withColumn("_prefix", F.sum("cents").over(so_far)).groupBy("account_id", "chunk").agg(
        F.max(_need("_prefix")).cast("long").alias("need"),
        F.sum("cents").cast("long").alias("total"),
        F.max("start").alias("start"),
    )


def replay(accounts: DataFrame, txns: DataFrame, max_rows: int = CHUNK_ROWS) -> DataFrame:
    """Book each account's transactions in order under the overdraft rule.

    Money in is refused while the balance would stay under 1.00. Money out that
    would take a deposit account below zero is cut so that a twentieth of the
    balance is left. Loans may go negative.

    A busy account spans several bounded chunks. A chunk whose opening balance is
    high enough only adds its total. The others are worked out in parallel from
    the best known opening, and again only where the opening then turns out
    different, until every opening follows from the chunk before it. Accounts of
    one chunk, nearly all of them, need no such round.
    """
    opening = accounts.select(
        "account_id",
        (F.col("balance") * 100).cast("long").alias("start"),
        F.col("account_type").isin(*DEPOSIT_ACCOUNT_TYPES).alias("deposit"),
    )
    # Joined before chunking: a join on the account alone would bring a busy
    # account's chunks back into one task.
    rows = txns.select(
        "account_id", "txn_id", "txn_ts", "txn_type",
        (F.col("amount") * 100).cast("long").alias("cents"),
        F.col("txn_type").isin(*OUTGOING_TYPES).alias("outgoing"),
    ).join(opening, "account_id")
    chunked, chunks = chunk_rows(rows, ["account_id"], ORDER, max_rows)
    chunked = chunked.withColumnRenamed(CHUNK, "chunk")
    key = ["account_id", "chunk"]
    if chunks == 1:
        return _in_money(_booked(chunked.withColumnRenamed("start", "opening")))

    # Chunks are contiguous ranges, so the accounts lying in more than one chunk
    # have at most twice as many (account, chunk) pairs as there are chunks. That
    # bounds every table of the rounds below, also for broadcasting.
    near = F.broadcast if chunks <= BROADCAST_CHUNKS else (lambda df: df)
    split = (
        chunked.groupBy("account_id").agg(F.min("chunk").alias("_a"), F.max("chunk").alias("_b"))
        .where("_a < _b").select("account_id")
    )
    parts = cut_lineage(chunked.join(near(split), "account_id"))
    summaries = cut_lineage(_chunk_summaries(parts))
    done = accounts.sparkSession.createDataFrame([], _TRIED)
    while True:
        known = summaries.join(near(done.withColumnRenamed("opening", "tried")), key, "left")
        openings = cut_lineage(known.groupBy("account_id").applyInPandas(overdraft.propagate, _OPENINGS))
        work = openings.where("work").select(*key, "opening")
        if work.isEmpty():
            break
        tried = _booked(parts.join(near(work), key)).groupBy(*key, "opening").agg(
            F.max_by("after", F.struct(*ORDER)).alias("closing")
        )
        done = cut_lineage(done.join(near(work), key, "left_anti").unionByName(tried))
    exact = chunked.join(near(openings.select(*key, "opening")), key, "left")
    return _in_money(_booked(exact.withColumn("opening", F.coalesce("opening", "start"))))

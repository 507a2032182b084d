"""Ledger replay on a stream: one balance per account is the state."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import overdraft
from millrace.schemas import DEPOSIT_ACCOUNT_TYPES, MONEY, OUTGOING_TYPES

register_pickle_by_value(overdraft)

_OUT = (
    "account_id long, txn_id long, txn_ts timestamp_ntz, txn_type string, "
    "booked long, after long, accepted boolean"
)


def _booker():
    # Nested, so that the function travels with the task by value.
    walk = overdraft.replay_sorted

    def book(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["txn_ts", "txn_id"])
        opening = state.get[0] if state.exists else int(rows["opening"].iloc[0])
        for done in walk([rows.assign(opening=opening, start_at=opening, chunk=0)]):
            state.update((int(done["after"].iloc[-1]),))
            yield done[["account_id", "txn_id", "txn_ts", "txn_type", "booked", "after", "accepted"]]

    return book


def replay_stream(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """Book arriving transactions under the overdraft rule of ``ledger.replay``.

    ``accounts`` is a static table giving the opening balance. A micro-batch is
    bounded at its source; its rows of one account are put in order before they
    are booked, and micro-batches follow the ledger's order.
    """
    opening = accounts.select(
        "account_id",
        (F.col("balance") * 100).cast("long").alias("opening"),
        F.col("account_type").isin(*DEPOSIT_ACCOUNT_TYPES).alias("deposit"),
    )
    rows = txns.select(
        "account_id", "txn_id", "txn_ts", "txn_type",
        (F.col("amount") * 100).cast("long").alias("cents"),
        F.col("txn_type").isin(*OUTGOING_TYPES).alias("outgoing"),
    ).join(opening, "account_id")
    booked = rows.groupBy("account_id").applyInPandasWithState(
        _booker(), _OUT, "balance long", "append", GroupStateTimeout.NoTimeout
    )

    def money(c: str):
        return (F.col(c) / 100).cast(MONEY)

    return booked.select(
        "account_id", "txn_id", "txn_ts", "txn_type",
        F.when(F.col("accepted"), money("booked")).alias("amount"),
        money("after").alias("balance_after"), "accepted",
    )

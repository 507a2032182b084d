"""The overdraft rule in whole cents, and its walk along sorted rows.

``ledger.replay`` runs these inside tasks that hold bounded chunks of accounts.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd

# Least balance that money in must reach, and the share of the
# balance (one part in twenty) that a partial debit leaves.
MIN_CREDIT_CENTS = 100
LEFT_SHARE = 20


def partial_debit(balance: int) -> int:
    """The balance a partial debit leaves, rounded half away from zero."""
    magnitude = (2 * abs(balance) + LEFT_SHARE) // (2 * LEFT_SHARE)
    return magnitude if balance >= 0 else -magnitude


def step(balance: int, amount: int, outgoing: bool, deposit: bool) -> tuple[int, int, bool]:
    """One transaction: (new balance, booked amount, accepted)."""
    new = balance + amount
    if new < MIN_CREDIT_CENTS and not outgoing:
        return balance, 0, False
    if deposit and new < 0:
        new = partial_debit(balance)
        if new == balance:
            return balance, 0, False
    return new, new - balance, True


def replay_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by group and order; the state is one balance.

    A group may begin in one batch and go on in the next.
    """
    group, balance = None, 0
    for rows in batches:
        booked, after, accepted = [], [], []
        columns = (rows[c].tolist() for c in ("account_id", "chunk", "start_at", "cents", "outgoing", "deposit"))
        for account, chunk, opening, cents, outgoing, deposit in zip(*columns):
            if (account, chunk) != group:
                group, balance = (account, chunk), opening
            balance, moved, ok = step(balance, cents, outgoing, deposit)
            booked.append(moved)
            after.append(balance)
            accepted.append(ok)
        yield rows[["account_id", "chunk", "txn_id", "txn_ts", "txn_type", "opening"]].assign(
            booked=booked, after=after, accepted=accepted
        )


def propagate(chunks: pd.DataFrame) -> pd.DataFrame:
    """Openings along one account's chunk summaries.

    They are exact up to the first chunk that still needs work, and the best
    guess after it. The last chunk's closing is never needed.
    """
    chunks = chunks.sort_values("chunk")
    balance = int(chunks["start"].iloc[0])
    openings, work = [], []
    last = len(chunks) - 1
    columns = zip(chunks["need"], chunks["total"], chunks["tried"], chunks["closing"])
    for i, (need, total, tried, closing) in enumerate(columns):
        openings.append(balance)
        known = not pd.isna(tried) and int(tried) == balance
        unknown = i < last and not known and balance < int(need)
        work.append(unknown)
        if known or (unknown and not pd.isna(closing)):
            balance = int(closing)
        else:
            balance += int(total)
    return chunks[["account_id", "chunk"]].assign(opening=openings, work=work)

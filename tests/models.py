"""Plain sequential models of the merge and of the ledger rule."""

from __future__ import annotations

ATTRIBUTES = ("first_name", "email", "phone", "street", "city", "state", "zip")


def apply_one_by_one(target, changes, tag="EXTERNAL", carry_source_ts=True, next_id=1):
    """Rows are dicts; changes are applied in order, each to all matching rows."""
    rows = [dict(r) for r in target]
    for c in changes:
        key = (c["ssn_last4"], c["last_name"])
        hits = [r for r in rows if (r["ssn_last4"], r["last_name"]) == key]
        if c["action"] == "skip":
            continue
        if c["action"] == "delete":
            rows = [r for r in rows if (r["ssn_last4"], r["last_name"]) != key]
            continue
        for r in hits:
            for a in ATTRIBUTES:
                r[a] = c[a] if c[a] is not None else r[a]
            r["source_system"] = tag
            if carry_source_ts:
                r["source_updated_at"] = c["source_updated_at"]
        if not hits:
            new = {a: c[a] for a in ATTRIBUTES}
            new.update(
                member_id=next_id, ssn_last4=key[0], last_name=key[1], source_system=tag,
                source_updated_at=c["source_updated_at"] if carry_source_ts else None,
            )
            next_id += 1
            rows.append(new)
    return rows


def replay_one_by_one(balance, deposit, txns, outgoing_types):
    """Cents. Yields (balance after, booked amount or None) per transaction."""
    for kind, amount in txns:
        new = balance + amount
        if new < 100 and kind not in outgoing_types:
            yield balance, None
            continue
        if deposit and new < 0:
            twentieth = (abs(balance) * 2 + 20) // 40 * (1 if balance >= 0 else -1)
            if twentieth == balance:
                yield balance, None
                continue
            new = twentieth
        yield new, new - balance
        balance = new

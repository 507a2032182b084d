"""Change-event queries: every message form parsed back to change rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.fixtures import Bank
from millrace.plans.oracles import ATTRIBUTES
from millrace.plans.registry import query
from millrace.schemas import MEMBER_ATTRIBUTES
from millrace.sources import envelope

_PARSED = f"""select update_id, ssn_last4, last_name, {', '.join(ATTRIBUTES)}, operation,
    source_ts as source_updated_at, {{op}} as op, operation='delete' as is_delete,
    epoch_ms(source_ts) as source_ts_ms,
    case when ssn_last4='' then 'skip' when operation='delete' then 'delete' else 'upsert' end as action
    from member_updates"""
_IMAGE_OP = "case when operation='delete' then 'd' when first_name is null then 'u' else 'c' end"


@query("parse_flat", _PARSED.format(op="case when operation='delete' then 'd' else 'c' end"))
def parse_flat(bank: Bank) -> DataFrame:
    return envelope.route(envelope.parse_flat(bank.flat_messages()))


@query("parse_envelope", _PARSED.format(op=_IMAGE_OP))
def parse_envelope(bank: Bank) -> DataFrame:
    return envelope.route(envelope.parse_envelope(bank.envelope_messages()))


@query("parse_custom", _PARSED.format(op=_IMAGE_OP))
def parse_custom(bank: Bank) -> DataFrame:
    return envelope.route(envelope.parse_custom(bank.envelope_messages("operation")))


@query("unwrap_envelope", f"""select update_id, ssn_last4, last_name, {', '.join(ATTRIBUTES)}, operation,
    strftime(source_ts, '%Y-%m-%dT%H:%M:%S.%g') as source_ts, {_IMAGE_OP} as "__op",
    case when operation='delete' then 'true' else 'false' end as "__deleted",
    epoch_ms(source_ts) as "__source_ts_ms" from member_updates""")
def unwrap_envelope(bank: Bank) -> DataFrame:
    return envelope.unwrap(bank.envelope_rows())


@query("drop_tombstones", "select update_id from member_updates")
def drop_tombstones(bank: Bank) -> DataFrame:
    return envelope.drop_tombstones(bank.flat_messages()).select("update_id")


@query("corrupt_messages", """select update_id, bad, case when bad then substring(ssn_last4 || last_name, 1, 3) end as text_start
    from (select *, email is not null as bad from member_updates)""")
def corrupt_messages(bank: Bank) -> DataFrame:
    """Messages with an email are cut short; they are set apart, the rest parse."""
    broken = F.when(F.col("email").isNotNull(), F.concat("ssn_last4", "last_name", F.lit("{"))).otherwise(
        F.to_json(F.struct(F.struct("update_id", "ssn_last4").alias("payload")))
    )
    events = envelope.read_events(bank.member_updates.select("update_id", broken.alias("value")), envelope.FLAT_EVENT)
    good, bad = envelope.split_corrupt(events)
    return good.select("update_id", F.lit(False).alias("bad"), F.lit(None).cast("string").alias("text_start")).unionByName(
        bad.select("update_id", F.lit(True).alias("bad"), F.substring("value", 1, 3).alias("text_start"))
    )


_FAULTS = """case update_id % 7 when 0 then 'corrupt' when 1 then 'unknown operation' when 2 then 'bad time'
    when 3 then 'no row image' end"""


def _faulty_messages(bank: Bank) -> DataFrame:
    """Envelope messages of which four in seven cannot be read, each in its own way."""
    kind = F.col("update_id") % 7
    time = F.when(kind == 2, "soon").when(kind == 4, F.unix_millis(F.col("source_ts").cast("timestamp")).cast("string"))
    image = F.struct("update_id", "ssn_last4", "last_name", F.coalesce(time, F.col("source_ts").cast("string")).alias("source_ts"))
    event = F.struct(F.when(kind == 1, "t").otherwise("c").alias("op"), F.when(kind != 3, image).alias("after"))
    return bank.member_updates.select("update_id", F.when(kind == 0, "{cut").otherwise(F.to_json(event)).alias("value"))


@query("event_rejects", f"select update_id, {_FAULTS} as reason from member_updates where update_id % 7 < 4")
def event_rejects(bank: Bank) -> DataFrame:
    return envelope.rejects(_faulty_messages(bank), "envelope").select("update_id", "reason")


@query("event_accepted", """select update_id, source_ts as source_updated_at, 'c' as op from member_updates where update_id % 7 >= 4""")
def event_accepted(bank: Bank) -> DataFrame:
    """Also those whose time is a number of milliseconds."""
    return envelope.parse_envelope(_faulty_messages(bank)).select("update_id", "source_updated_at", "op")


@query("snapshot_then_changes", """select account_id, balance, 'r' as op, 0 as phase, source_updated_at as at from accounts
    union all select account_id, balance_after, 'u', 1, txn_ts from ledger""")
def snapshot_then_changes(bank: Bank) -> DataFrame:
    snapshot = bank.accounts.select("account_id", "balance", F.col("source_updated_at").alias("at"))
    changes = bank.transactions(balance=True).select(
        "account_id", F.col("balance_after").alias("balance"), F.col("txn_ts").alias("at"), F.lit("u").alias("op")
    )
    return envelope.snapshot_then_changes(snapshot, changes)


@query("table_filter", """select update_id, case when operation='delete' then 'd' else 'c' end as op from member_updates
    where case when operation='delete' then 'members' when email is not null then 'accounts' else 'member_updates' end
      in ('members', 'member_updates')""")
def table_filter(bank: Bank) -> DataFrame:
    table = (
        F.when(F.col("operation") == "delete", "members").when(F.col("email").isNotNull(), "accounts")
        .otherwise("member_updates")
    )
    events = bank.member_updates.select(
        "update_id", F.when(F.col("operation") == "delete", "d").otherwise("c").alias("op"),
        F.struct(table.alias("table")).alias("source"),
    )
    return envelope.filter_tables(events, ["members", "member_updates"]).select("update_id", "op")


@query("change_diff", f"""select update_id, {', '.join(f"case when new_{c} is distinct from old_{c} then new_{c} end as {c}" for c in ATTRIBUTES)}
    from (select update_id, {', '.join(f"{c} as new_{c}" for c in ATTRIBUTES)},
      {', '.join(f"case when last_name in ('Name1','Name2','Name3') then {c} else coalesce(first_name, '') end as old_{c}" for c in ATTRIBUTES)}
      from member_updates)""")
def change_diff(bank: Bank) -> DataFrame:
    same = F.col("last_name").isin("Name1", "Name2", "Name3")
    before = F.struct(*[
        F.when(same, F.col(c)).otherwise(F.coalesce("first_name", F.lit(""))).alias(c) for c in MEMBER_ATTRIBUTES
    ])
    images = bank.member_updates.select(
        F.struct("update_id", *MEMBER_ATTRIBUTES).alias("after"), before.alias("before")
    )
    return envelope.shape_changes(images, ["update_id"], list(MEMBER_ATTRIBUTES))

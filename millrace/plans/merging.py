"""Fold, merge, delete, keyed update and ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import ledger
from millrace.operators.changes import fold_changes, net_changes
from millrace.operators.merge import (
    account_rule, apply_merge, customer_rule, delete_keys, member_rule, merge_outcomes, resolve,
    update_columns, upper_columns, with_defaults,
)
from millrace.operators.ordered import newest_per_key, number_rows
from millrace.plans.fixtures import BATCH_TS, BEFORE_TS, Bank, at
from millrace.plans.oracles import ATTRIBUTES, fold_sql, member_tables
from millrace.plans.registry import query
from millrace.schemas import MEMBER_ATTRIBUTES, MEMBER_KEYS, MEMBERS
from millrace.session import cut_lineage

MEMBER_TABLES = member_tables("EXTERNAL", "carry")
_KEYS = list(MEMBER_KEYS)
_ORDER = ["update_id"]


def _old_changes(bank: Bank) -> DataFrame:
    return bank.member_changes.where(F.col("update_id") <= bank.half)


def _new_changes(bank: Bank) -> DataFrame:
    return bank.member_changes.where(F.col("update_id") > bank.half)


def members_before(bank: Bank) -> DataFrame:
    """Golden records built from the first half of the changes."""
    return members_of(_old_changes(bank))


def members_of(changes: DataFrame) -> DataFrame:
    """Golden records built from changes alone."""
    rule = member_rule(at(BEFORE_TS))
    # Numbering counts its rows first; the fold is cut off so that it runs once.
    live = cut_lineage(rule.fold(changes, _ORDER).where("live"))
    return number_rows(live, ["born"], "member_id").select(
        "member_id", *_KEYS, *MEMBER_ATTRIBUTES,
        F.lit("EXTERNAL").alias("source_system"), at(BEFORE_TS).alias("updated_at"), "source_updated_at",
    ).select(*MEMBERS.schema.names)


_FOLDED = f"""select ssn_last4, last_name, wiped, live, {', '.join(ATTRIBUTES)}, source_updated_at, born, changes from all_folded"""


@query("fold_members", _FOLDED, {"all_folded": fold_sql("changes")})
def fold_members(bank: Bank) -> DataFrame:
    return member_rule(at(BATCH_TS)).fold(bank.member_changes, _ORDER).select(
        *_KEYS, "wiped", "live", *MEMBER_ATTRIBUTES, "source_updated_at", "born", "changes"
    )


@query("merge_outcomes", """select cast(sum(f.changes) as bigint) as changes,
    cast(sum(case when not f.wiped and m.member_id is not null then 1 else 0 end) as bigint) as matched,
    cast(sum(case when f.live and (f.wiped or m.member_id is null) then 1 else 0 end) as bigint) as inserted,
    cast(sum(case when f.wiped and m.member_id is not null then 1 else 0 end) as bigint) as deleted
    from new_fold f left join members m on m.ssn_last4=f.ssn_last4 and m.last_name=f.last_name""", MEMBER_TABLES)
def merge_outcome_counts(bank: Bank) -> DataFrame:
    folded = member_rule(at(BATCH_TS)).fold_only(_new_changes(bank), _ORDER)
    return merge_outcomes(resolve(members_before(bank), folded, _KEYS))


def _merged_members(bank: Bank, tag: str, carry_source_ts: bool) -> DataFrame:
    rule = member_rule(at(BATCH_TS), tag, carry_source_ts)
    target = members_before(bank)
    folded = cut_lineage(rule.fold(_new_changes(bank), _ORDER))
    return apply_merge(target, folded, rule)


@query("merge_members", "select * from merged", MEMBER_TABLES)
def merge_members(bank: Bank) -> DataFrame:
    return _merged_members(bank, "EXTERNAL", True)


@query("merge_members_stream", "select * from merged", member_tables("STREAM", "leave"))
def merge_members_stream(bank: Bank) -> DataFrame:
    return _merged_members(bank, "STREAM", False)


@query("merge_members_envelope", "select * from merged", member_tables("STREAM", "carry"))
def merge_members_envelope(bank: Bank) -> DataFrame:
    return _merged_members(bank, "STREAM", True)


@query("delete_members", """select m.* from members m where not exists (select 1 from new_changes c
    where c.action='delete' and c.ssn_last4=m.ssn_last4 and c.last_name=m.last_name)""", MEMBER_TABLES)
def delete_members(bank: Bank) -> DataFrame:
    return delete_keys(members_before(bank), _new_changes(bank).where("action = 'delete'"), _KEYS)


@query("net_changes", """select b.ssn_last4, b.last_name,
    case when was and now_up then 'update' when now_up then 'insert' else 'delete' end as net_op,
    case when now_up then f.first_name end as first_name, case when now_up then f.email end as email,
    case when now_up then f.phone end as phone, case when now_up then f.street end as street
    from (select ssn_last4, last_name,
        coalesce(arg_max(action, update_id) filter (where update_id <= h // 2) = 'upsert', false) as was,
        arg_max(action, update_id) filter (where update_id > h // 2) = 'upsert' as now_up
      from changes join half on true where action <> 'skip' and update_id <= h group by 1, 2) b
    join old_fold f on f.ssn_last4=b.ssn_last4 and f.last_name=b.last_name
    where now_up is not null and (was or now_up)""", MEMBER_TABLES)
def net_change_rows(bank: Bank) -> DataFrame:
    return net_changes(
        bank.member_changes, _KEYS, _ORDER, ["first_name", "email", "phone", "street"], bank.half // 2, bank.half
    )


# -- keyed tables -------------------------------------------------------------

ACCOUNT_CHANGES = {
    "account_changes": """select 1000 + (account_id-1000)*20 as account_id, account_id-1000 as customer_id,
        'CHECKING' as account_type, balance_after as balance,
        case when txn_type='FEE' then 'FROZEN' else 'ACTIVE' end as status, txn_ts as source_updated_at, txn_id from ledger""",
    "account_fold": """select account_id, max_by(customer_id, txn_id) as customer_id, max_by(account_type, txn_id) as account_type,
        max_by(balance, txn_id) as balance, max_by(status, txn_id) as status,
        max_by(source_updated_at, txn_id) as source_updated_at from account_changes group by 1""",
}


ACCOUNTS_SQL = """select coalesce(a.account_id, f.account_id) as account_id,
    coalesce(a.customer_id, f.customer_id) as customer_id, coalesce(a.account_type, f.account_type) as account_type,
    coalesce(f.balance, a.balance) as balance, coalesce(f.status, a.status) as status,
    case when f.account_id is null then a.updated_at else timestamp '2024-02-01 00:00:05' end as updated_at,
    coalesce(f.source_updated_at, a.source_updated_at) as source_updated_at
    from accounts a full join account_fold f on f.account_id = a.account_id"""


@query("merge_accounts", ACCOUNTS_SQL, ACCOUNT_CHANGES)
def merge_accounts(bank: Bank) -> DataFrame:
    changes = bank.account_changes()
    rule = account_rule(at(BATCH_TS))
    return apply_merge(bank.accounts, cut_lineage(rule.fold(changes, ["txn_id"])), rule)


_PROFILE = ("first_name", "last_name", "email", "phone", "street", "city", "state", "zip")
CUSTOMER_CHANGES = {
    "profile_changes": """select user_id*20 as customer_id, coalesce(first_name, '') as first_name, last_name,
        coalesce(email, '') as email, coalesce(phone, '') as phone, coalesce(street, '') as street,
        coalesce(city, '') as city, coalesce(state, '') as state, coalesce(zip, '') as zip, source_ts, update_id
        from member_updates join events on event_id = update_id""",
    "profile_fold": "select customer_id, " + ", ".join(f"max_by({c}, update_id) as {c}" for c in _PROFILE)
        + ", max_by(source_ts, update_id) as source_ts from profile_changes group by 1",
}


CUSTOMERS_SQL = "select coalesce(c.customer_id, f.customer_id) as customer_id, " + ", ".join(
    f"case when f.customer_id is null then c.{c} else f.{c} end as {c}" for c in _PROFILE
) + """, case when f.customer_id is null then c.updated_at else timestamp '2024-02-01 00:00:05' end as updated_at,
    case when f.customer_id is null then c.updated_at else f.source_ts end as source_updated_at
    from customers c full join profile_fold f on f.customer_id = c.customer_id"""


@query("merge_customers", CUSTOMERS_SQL, CUSTOMER_CHANGES)
def merge_customers(bank: Bank) -> DataFrame:
    target, changes = bank.current_customers(), bank.customer_changes()
    rule = customer_rule(at(BATCH_TS))
    return apply_merge(target, cut_lineage(rule.fold(changes, _ORDER)), rule)


@query("profile_update", """select c.customer_id, c.first_name, c.last_name, c.email, c.phone,
    case when p.customer_id is null then c.street else p.street end as street,
    case when p.customer_id is null then c.city else p.city end as city,
    case when p.customer_id is null then c.state else p.state end as state,
    case when p.customer_id is null then c.zip else p.zip end as zip, c.updated_at
    from customers c left join (select user_id as customer_id, max_by(street, update_id) as street,
      max_by(city, update_id) as city, max_by(state, update_id) as state, max_by(zip, update_id) as zip
      from member_updates join events on event_id = update_id where street is not null group by 1) p
    on p.customer_id = c.customer_id""")
def profile_update(bank: Bank) -> DataFrame:
    moves = bank.member_updates.where("street is not null").select("update_id", "street", "city", "state", "zip").join(
        bank.events.select(F.col("event_id").alias("update_id"), F.col("user_id").alias("customer_id")), "update_id"
    )
    newest = newest_per_key(moves, ["customer_id"], _ORDER)
    return update_columns(bank.customers.drop("ssn_last4"), newest, ["customer_id"], ["street", "city", "state", "zip"])


_LANDED = "txn_id, account_id, txn_type, amount, description, merchant, txn_ts, source_write_ts"


@query("landing_with_defaults", f"""select {_LANDED}, coalesce(ingest_ts, timestamp '2024-02-01 00:00:05') as ingest_ts,
    'CORE' as source_system from ledger""")
def landing_with_defaults(bank: Bank) -> DataFrame:
    return with_defaults(bank.ledger(), {"ingest_ts": at(BATCH_TS), "source_system": F.lit("CORE")})


@query("landing_upper", f"""select txn_id as "TXN_ID", account_id as "ACCOUNT_ID", txn_type as "TXN_TYPE", amount as "AMOUNT",
    description as "DESCRIPTION", merchant as "MERCHANT", txn_ts as "TXN_TS", source_write_ts as "SOURCE_WRITE_TS" from ledger""")
def landing_upper(bank: Bank) -> DataFrame:
    return upper_columns(bank.transactions())


# -- ledger ---------------------------------------------------------------------

@query("apply_ledger", """select a.account_id, a.customer_id, a.account_type, coalesce(l.balance, a.balance) as balance,
    a.status, coalesce(l.ts, a.source_updated_at) as source_updated_at, a.updated_at
    from accounts a left join (select account_id, max_by(balance_after, txn_id) as balance, max(txn_ts) as ts
      from ledger group by 1) l on l.account_id = a.account_id""")
def apply_ledger(bank: Bank) -> DataFrame:
    return ledger.apply_ledger(bank.accounts, bank.transactions(balance=True))


@query("running_balance", "select txn_id, account_id, amount, balance_after as running_balance from ledger")
def running_balance(bank: Bank) -> DataFrame:
    txns = bank.transactions().select("txn_id", "account_id", "txn_ts", "amount")
    return ledger.running_balance(txns, bank.accounts).drop("txn_ts")


@query("balance_breaks", """select 'step' as kind, account_id, txn_id, cast(prev + amount as decimal(18,2)) as expected, found
    from (select *, lag(found) over (partition by account_id order by txn_id) as prev from shown_ledger)
    where prev is not null and found <> prev + amount
    union all select 'end', a.account_id, e.txn_id, e.found, a.balance from accounts a join
      (select account_id, max(txn_id) as txn_id, max_by(found, txn_id) as found from shown_ledger group by 1) e
      on e.account_id = a.account_id where e.found <> a.balance""",
    {"shown_ledger": "select *, case when amount > 150 then balance_after + 1 else balance_after end as found from ledger"})
def balance_breaks(bank: Bank) -> DataFrame:
    """Balances one unit off on large rows show up as breaks."""
    off = F.when(F.col("amount") > 150, F.col("balance_after") + 1).otherwise(F.col("balance_after"))
    shown = bank.transactions(balance=True).withColumn("balance_after", off.cast("decimal(18,2)"))
    return ledger.balance_breaks(shown, bank.accounts)


_REPLAY = {
    "replay_rows": """select l.account_id, txn_id, l.txn_ts, l.txn_type, cast(amount * 100 as bigint) as cents,
        txn_type in ('DEBIT', 'WITHDRAWAL', 'FEE', 'TRANSFER_OUT') as outgoing,
        account_type in ('CHECKING', 'SAVINGS', 'MONEY_MARKET') as deposit, cast(balance * 100 as bigint) as start,
        row_number() over (partition by l.account_id order by l.txn_ts, txn_id) as n
        from ledger l join accounts a on a.account_id = l.account_id""",
    # One row of each account a step; a partial debit leaves a twentieth, rounded half away from zero.
    "replayed": """select * from (with recursive walk as (
        select account_id, cast(0 as bigint) as n, start as before, start as after from replay_rows where n = 1
        union all
        select r.account_id, r.n, w.after,
          case when w.after + cents < 100 and not outgoing then w.after
            when deposit and w.after + cents < 0 then sign(w.after) * ((2 * abs(w.after) + 20) // 40)
            else w.after + cents end
        from walk w join replay_rows r on r.account_id = w.account_id and r.n = w.n + 1) select * from walk) w""",
    "replay_booked": """select r.*, before, after, not (before + cents < 100 and not outgoing)
        and not (deposit and before + cents < 0 and after = before) as accepted
        from replayed w join replay_rows r on r.account_id = w.account_id and r.n = w.n""",
}


@query("ledger_replay", """select account_id, txn_id, txn_ts, txn_type,
    case when accepted then cast((after - before) * 0.01 as decimal(18,2)) end as amount,
    cast(after * 0.01 as decimal(18,2)) as balance_after, accepted from replay_booked""", _REPLAY)
def ledger_replay(bank: Bank) -> DataFrame:
    return ledger.replay(bank.accounts, bank.transactions())

"""The same tables and queries as SQL text, to check results in another engine."""

from __future__ import annotations

import re

# Tables of FIXTURES.md. ``ledger`` also holds rows that have not arrived.
TABLES = {
    "k_events": """select *, cast(json_extract_string(props, '$.k') as int) as k,
        date_trunc('millisecond', ts) as ms from events""",
    "customers": """select c_custkey as customer_id, lpad(cast(c_custkey*61%10000 as varchar),4,'0') as ssn_last4,
        'Customer' as first_name, 'Name' || (c_custkey%50) as last_name,
        'c' || c_custkey || '@example.com' as email,
        case when c_custkey%7<>0 then '555-' || lpad(cast(c_custkey%10000 as varchar),4,'0') end as phone,
        (c_custkey%900+100) || ' Main St' as street, n_name as city, substring(n_name,1,2) as state,
        lpad(cast(c_custkey*37%100000 as varchar),5,'0') as zip,
        timestamp '2024-01-01 00:00:00' + interval '1' second * c_custkey as updated_at
        from customer join nation on c_nationkey = n_nationkey""",
    "accounts": """select 1000+c_custkey as account_id, c_custkey as customer_id,
        case c_mktsegment when 'BUILDING' then 'SAVINGS' when 'MACHINERY' then 'LOAN'
          when 'FURNITURE' then 'MONEY_MARKET' else 'CHECKING' end as account_type,
        cast(c_acctbal as decimal(18,2)) as balance,
        case when c_custkey%11=0 then 'FROZEN' when c_custkey%13=0 then 'CLOSED' else 'ACTIVE' end as status,
        timestamp '2024-01-01 00:00:00' + interval '1' second * c_custkey as source_updated_at,
        timestamp '2024-01-01 00:00:00' + interval '1' second * (c_custkey + c_custkey%5) as updated_at
        from customer""",
    "ledger": """select event_id as txn_id, 1000+user_id as account_id, txn_type, amount,
        txn_type || ' #' || event_id as description, 'Merchant' || (event_id%29) as merchant,
        cast(cast(c_acctbal as decimal(18,2)) + sum(amount) over (partition by user_id order by event_id
          rows between unbounded preceding and current row) as decimal(18,2)) as balance_after,
        ms as txn_ts, ms as source_write_ts,
        case when event_id%17<>0 then ms + to_milliseconds(k*97) end as ingest_ts
        from (select *, case event_type when 'purchase' then 'DEBIT' when 'signup' then 'DEPOSIT'
            when 'view' then 'TRANSFER_IN' when 'click' then 'FEE' else 'WITHDRAWAL' end as txn_type,
          cast(case when event_type in ('signup','view') then value else -value end as decimal(18,2)) as amount
          from k_events) e join customer on c_custkey = user_id""",
    "landing": """select *, date_diff('millisecond', source_write_ts, ingest_ts) as sla_ms
        from ledger where ingest_ts is not null""",
    "member_updates": """select event_id as update_id,
        case when k=50 then '' else lpad(cast(user_id*61%10000 as varchar),4,'0') end as ssn_last4,
        'Name' || (user_id%50) as last_name,
        case when k%2=0 then 'Customer' end as first_name,
        case when event_type='click' then 'e' || event_id || '@example.com' end as email,
        case when event_type='view' then '555-' || lpad(cast(k as varchar),4,'0') end as phone,
        case when event_type in ('signup','purchase') then k || ' Main St' end as street,
        case when event_type in ('signup','purchase') then 'City' || (k%20) end as city,
        case when event_type in ('signup','purchase') then 'S' || (k%10) end as state,
        case when event_type in ('signup','purchase') then lpad(cast(k as varchar),5,'0') end as zip,
        case when event_type='error' and k<10 then 'delete' else 'upsert' end as operation,
        ms as source_ts, ms as updated_at from k_events""",
    "half": "select coalesce(max(event_id), 0)//2 as h from events",
    "changes": """select *, case when ssn_last4='' then 'skip' when operation='delete' then 'delete' else 'upsert' end as action
        from member_updates""",
    "batch_log": """select case batch_no%3 when 0 then 'txn' when 1 then 'keyed' else 'member' end as path, *
        from (select event_id//50 as batch_no, max(ts) as finished_ts, count(*) as rows,
          cast(sum(k) as bigint) as duration_ms, count(*) filter (where event_type='view') as matched,
          count(*) filter (where event_type='signup') as inserted,
          count(*) filter (where event_type='error' and value>100) as errors from k_events group by 1)""",
    "landing_state": "select max(ingest_ts) as as_of from landing",
}

ATTRIBUTES = ("first_name", "email", "phone", "street", "city", "state", "zip")


def fold_sql(changes: str, keys: str = "ssn_last4, last_name", seq: str = "update_id") -> str:
    """Fold of a change table, written as the definition reads."""
    alive = f"action='upsert' and {seq} > coalesce(ld, -1)"
    latest = ", ".join(
        f"arg_max({c}, {seq}) filter (where {alive} and {c} is not null) as {c}" for c in ATTRIBUTES
    )
    return f"""select {keys}, ld is not null as wiped, count(*) filter (where {alive}) > 0 as live, {latest},
        max({{'s': {seq}, 't': source_ts}}) filter (where {alive})['t'] as source_updated_at,
        min({seq}) filter (where {alive}) as born, count(*) as changes
        from (select *, max({seq}) filter (where action='delete') over (partition by {keys}) as ld
          from {changes} where action <> 'skip') group by {keys}, ld"""


def member_tables(tag: str, source_ts: str) -> dict[str, str]:
    """Golden records before and after a merge of the second half of the changes."""
    columns = "member_id, ssn_last4, last_name, " + ", ".join(ATTRIBUTES) + ", source_system, updated_at, source_updated_at"
    kept = ", ".join(f"coalesce(f.{c}, t.{c}) as {c}" for c in ATTRIBUTES)
    updated_source = {"carry": "f.source_updated_at", "leave": "t.source_updated_at"}[source_ts]
    inserted_source = {"carry": "source_updated_at", "leave": "cast(null as timestamp)"}[source_ts]
    return {
        "old_changes": "select * from changes where update_id <= (select h from half)",
        "new_changes": "select * from changes where update_id > (select h from half)",
        "old_fold": fold_sql("old_changes"),
        "new_fold": fold_sql("new_changes"),
        "members": f"""select row_number() over (order by born) as member_id, ssn_last4, last_name,
            {', '.join(ATTRIBUTES)}, 'EXTERNAL' as source_system, timestamp '2024-02-01 00:00:00' as updated_at,
            source_updated_at from old_fold where live""",
        "merged": f"""select {columns} from members t
              where not exists (select 1 from new_fold f where f.ssn_last4=t.ssn_last4 and f.last_name=t.last_name)
            union all select t.member_id, t.ssn_last4, t.last_name, {kept}, '{tag}', timestamp '2024-02-01 00:00:05',
              {updated_source} from members t join new_fold f on f.ssn_last4=t.ssn_last4 and f.last_name=t.last_name
              where not f.wiped
            union all select (select max(member_id) from members) + row_number() over (order by born), ssn_last4,
              last_name, {', '.join(ATTRIBUTES)}, '{tag}', timestamp '2024-02-01 00:00:05', {inserted_source}
              from new_fold f where live and (wiped or not exists
                (select 1 from members t where f.ssn_last4=t.ssn_last4 and f.last_name=t.last_name))""",
    }


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the table definitions it needs."""
    known = {**TABLES, **(extra or {})}
    needed: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                need(known[name])
                needed.append(name) if name not in needed else None

    need(body)
    ctes = ", ".join(f"{name} as ({known[name]})" for name in needed)
    return f"with {ctes} {body}" if needed else body

"""Serving, reconciliation, scan and metric queries."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import latency_ms
from millrace.operators import metrics, reconcile, serving
from millrace.plans.fixtures import Bank, at
from millrace.plans.merging import members_of
from millrace.plans.oracles import TABLES, fold_sql
from millrace.plans.registry import query
from millrace.sources import scans

CURSOR = scans.Cursor(datetime(2024, 1, 10), 2)
EARLY = scans.Cursor(datetime(2024, 1, 1, 0, 1), 60)


@query("account_activity", """select a.account_id, a.account_type, a.balance as current_balance, a.status,
    c.first_name || ' ' || c.last_name as customer_name, c.email, t.txn_id, t.txn_type, t.amount, t.merchant,
    t.description, t.txn_ts, t.source_write_ts, t.ingest_ts, t.sla_ms,
    date_diff('millisecond', a.source_updated_at, a.updated_at) as write_ms
    from accounts a join customers c on a.customer_id = c.customer_id join landing t on a.account_id = t.account_id""")
def account_activity(bank: Bank) -> DataFrame:
    return serving.account_activity(bank.accounts, bank.customers, bank.landing())


@query("account_lookup", """select a.account_id, a.account_type, a.balance, a.status, a.updated_at, a.source_updated_at,
    c.first_name || ' ' || c.last_name as customer_name, c.first_name, c.last_name, c.email, c.phone,
    date_diff('millisecond', a.source_updated_at, a.updated_at) as write_ms
    from accounts a join customers c on a.customer_id = c.customer_id where a.account_id = 1007""")
def account_lookup(bank: Bank) -> DataFrame:
    return serving.account_lookup(bank.accounts, bank.customers, 1007)


@query("account_history_topn", """select account_id, txn_id, txn_type, amount, merchant, description, txn_ts,
    source_write_ts, ingest_ts, sla_ms from (select *, row_number() over (partition by account_id
    order by txn_ts desc, txn_id desc) as rn from landing) where rn <= 20""")
def account_history_topn(bank: Bank) -> DataFrame:
    return serving.account_history(bank.landing())


_FEED = """select txn_id, account_id, txn_type, amount, merchant, txn_ts, source_write_ts, ingest_ts, sla_ms
    from landing order by ingest_ts desc, txn_id desc limit """


@query("live_feed_50", _FEED + "50")
def live_feed_50(bank: Bank) -> DataFrame:
    return serving.live_feed(bank.landing(), 50)


@query("initial_feed_25", _FEED + "25")
def initial_feed_25(bank: Bank) -> DataFrame:
    return serving.live_feed(bank.landing(), 25)


@query("recent_source_20", """select txn_id, account_id, txn_type, amount, merchant, txn_ts, source_write_ts
    from ledger order by txn_ts desc, txn_id desc limit 20""")
def recent_source_20(bank: Bank) -> DataFrame:
    rows = bank.transactions().select(
        "txn_id", "account_id", "txn_type", "amount", "merchant", "txn_ts", "source_write_ts"
    )
    return scans.recent_rows(rows, ["txn_ts", "txn_id"], 20)


@query("feed_merge", """select * from (select txn_id, amount, ingest_ts, true as is_new from fresh union all
    select txn_id, amount, ingest_ts, false from shown) order by is_new desc, ingest_ts desc, txn_id desc limit 50""",
    {
        "shown": """select txn_id, amount, ingest_ts from landing
            where ingest_ts <= (select max(ingest_ts) - interval 90 minute from landing)
            order by ingest_ts desc, txn_id desc limit 50""",
        "feed": "select txn_id, amount, ingest_ts from landing order by ingest_ts desc, txn_id desc limit 50",
        "fresh": "select * from feed where txn_id not in (select txn_id from shown)",
    })
def feed_merge(bank: Bank) -> DataFrame:
    landing = bank.landing().select("txn_id", "amount", "ingest_ts", "source_write_ts", "account_id", "txn_type", "merchant", "txn_ts")
    cut = landing.agg(F.max("ingest_ts") - F.expr("interval 90 minutes")).scalar()
    columns = ["txn_id", "amount", "ingest_ts"]
    shown = landing.where(F.col("ingest_ts") <= cut).select(*columns)
    return serving.merge_feed(serving.live_feed(landing, 50).select(*columns), shown, ["ingest_ts", "txn_id"], 50)


_MATCH = """select s.txn_id, s.account_id, s.txn_type, s.amount, s.merchant, s.source_write_ts,
    s.balance_after as source_balance_after, l.txn_id is not null as arrived, l.ingest_ts, {sla} as sla_ms,
    a.balance as current_balance from {source} s left join landing l on l.txn_id = s.txn_id and l.txn_id <> 0
    left join accounts a on a.account_id = s.account_id"""
_RECENT = {"recent": "select * from ledger order by txn_ts desc, txn_id desc limit 20"}


@query("reconcile_recent", _MATCH.format(sla="nullif(l.sla_ms, 0)", source="recent"), _RECENT)
def reconcile_recent(bank: Bank) -> DataFrame:
    recent = scans.recent_rows(bank.transactions(balance=True), ["txn_ts", "txn_id"], 20)
    return reconcile.reconcile(recent, bank.landing(), bank.accounts, source_rows=20, zero_as_null=True)


@query("reconcile_all", _MATCH.format(sla="l.sla_ms", source="ledger"))
def reconcile_all(bank: Bank) -> DataFrame:
    return reconcile.reconcile(bank.transactions(balance=True), bank.landing(), bank.accounts)


@query("reconcile_counts", """select count(*) as source_count, count(l.txn_id) as arrived_count,
    count(*) - count(l.txn_id) as pending_count,
    cast(round(count(l.txn_id) * 100.0 / nullif(count(*), 0), 0) as bigint) as delivered_pct
    from ledger s left join landing l on l.txn_id = s.txn_id""")
def reconcile_counts(bank: Bank) -> DataFrame:
    source = bank.transactions().withColumn("balance_after", F.lit(None).cast("decimal(18,2)"))
    return reconcile.delivery_counts(reconcile.reconcile(source, bank.landing(), bank.accounts))


@query("batch_accounts", "select distinct account_id from ledger where txn_id <> 0")
def batch_accounts(bank: Bank) -> DataFrame:
    return reconcile.distinct_accounts(serving.known_ids(bank.transactions(), "txn_id"))


@query("listed_balances", """select account_id, balance from accounts
    where account_id in (select account_id from landing)""")
def listed_balances(bank: Bank) -> DataFrame:
    return serving.only_listed(bank.accounts.select("account_id", "balance"), bank.landing(), "account_id")


@query("unseen_rows", "select txn_id, account_id, amount from ledger where txn_id not in (select txn_id from landing)")
def unseen_rows(bank: Bank) -> DataFrame:
    return serving.unseen(bank.transactions(), bank.landing()).select("txn_id", "account_id", "amount")


@query("landing_sla_5min", """select count(*) as n_rows, round(avg(sla_ms), 0) as avg_latency_ms from landing
    where ingest_ts >= (select as_of - interval 5 minute from landing_state)""")
def landing_sla_5min(bank: Bank) -> DataFrame:
    landing = bank.landing()
    return metrics.landing_sla(landing, landing.agg(F.max("ingest_ts")).scalar(), 5)


@query("landing_sla_avg_s", "select round(avg(sla_ms) / 1000, 1) as avg_sla_s from landing")
def landing_sla_avg_s(bank: Bank) -> DataFrame:
    return metrics.mean_sla_seconds(bank.landing())


_MEMBERS_NOW = {
    "all_folded": fold_sql("changes"),
    "members_now": "select *, timestamp '2024-02-01 00:00:00' as updated_at from all_folded where live",
}


@query("member_summary", "select count(*) as n_rows, max(updated_at) as latest from members_now", _MEMBERS_NOW)
def member_summary(bank: Bank) -> DataFrame:
    return metrics.count_and_latest(members_of(bank.member_changes))


@query("member_write_latency", """select count(*) as n_rows,
    round(avg(date_diff('millisecond', source_updated_at, updated_at)), 3) as avg_write_ms from members_now""", _MEMBERS_NOW)
def member_write_latency(bank: Bank) -> DataFrame:
    return metrics.count_and_write_latency(members_of(bank.member_changes))


@query("table_counts", """select 'accounts' as table_name, count(*) as n_rows from accounts
    union all select 'customers', count(*) from customers union all select 'landing', count(*) from landing
    union all select 'member_updates', count(*) from member_updates union all select 'transactions', count(*) from ledger""")
def table_counts(bank: Bank) -> DataFrame:
    tables = {
        "accounts": bank.accounts, "customers": bank.customers, "landing": bank.landing(),
        "member_updates": bank.member_updates, "transactions": bank.transactions(),
    }
    return reduce(DataFrame.unionByName, [metrics.row_count(df, name) for name, df in tables.items()])


@query("account_state", "select account_id, customer_id, account_type, balance from accounts")
def account_state(bank: Bank) -> DataFrame:
    return scans.load_account_state(bank.accounts)


@query("first_txn_time", "select min(txn_ts) as first_ts from ledger")
def first_txn_time(bank: Bank) -> DataFrame:
    return scans.first_time(bank.transactions(), "txn_ts")


# -- cursors ------------------------------------------------------------------

_AFTER = "({ts} > timestamp '2024-01-10' or ({ts} = timestamp '2024-01-10' and {id} > 2))"
_AFTER_EARLY = "(updated_at > timestamp '2024-01-01 00:01:00' or (updated_at = timestamp '2024-01-01 00:01:00' and {id} > 60))"


@query("incremental_txn", f"""select txn_id, account_id, txn_type, amount, description, merchant, txn_ts, source_write_ts
    from ledger where {_AFTER.format(ts='txn_ts', id='txn_id')} order by txn_ts, txn_id limit 20""")
def incremental_txn(bank: Bank) -> DataFrame:
    columns = ["txn_id", "account_id", "txn_type", "amount", "description", "merchant", "txn_ts", "source_write_ts"]
    return scans.incremental_scan(bank.transactions(), "txn_ts", "txn_id", CURSOR, 20, columns)


@query("incremental_backlog", f"""select txn_id, account_id, txn_type, amount, txn_ts from ledger
    where {_AFTER.format(ts='txn_ts', id='txn_id')}""")
def incremental_backlog(bank: Bank) -> DataFrame:
    columns = ["txn_id", "account_id", "txn_type", "amount", "txn_ts"]
    return scans.incremental_scan(bank.transactions(), "txn_ts", "txn_id", CURSOR, columns=columns)


@query("incremental_accounts", f"""select account_id, customer_id, account_type, balance, status, updated_at from accounts
    where {_AFTER_EARLY.format(id='account_id')} order by updated_at, account_id limit 30""")
def incremental_accounts(bank: Bank) -> DataFrame:
    columns = ["account_id", "customer_id", "account_type", "balance", "status", "updated_at"]
    return scans.incremental_scan(bank.accounts, "updated_at", "account_id", EARLY, 30, columns)


@query("incremental_customers", f"""select customer_id, first_name, last_name, email, coalesce(phone, '') as phone, street,
    city, state, zip, updated_at from customers
    where {_AFTER_EARLY.format(id='customer_id')} order by updated_at, customer_id limit 30""")
def incremental_customers(bank: Bank) -> DataFrame:
    columns = ["customer_id", "first_name", "last_name", "email", "phone", "street", "city", "state", "zip", "updated_at"]
    rows = scans.incremental_scan(bank.customers, "updated_at", "customer_id", EARLY, 30, columns)
    return rows.withColumn("phone", F.coalesce("phone", F.lit("")))


@query("incremental_members", f"""select update_id, ssn_last4, last_name, operation, source_ts, updated_at from member_updates
    where {_AFTER.format(ts='updated_at', id='update_id')} order by updated_at, update_id limit 30""")
def incremental_members(bank: Bank) -> DataFrame:
    columns = ["update_id", "ssn_last4", "last_name", "operation", "source_ts", "updated_at"]
    return scans.incremental_scan(bank.member_updates, "updated_at", "update_id", CURSOR, 30, columns)


@query("init_cursors", """select 'transactions' as table_name, least(timestamp '2024-02-01' - interval 10 second,
    min(txn_ts) - interval 1 second) as cursor_ts from ledger
    union all select t, timestamp '2024-02-01' from (values ('accounts'), ('customers'), ('member_updates')) v(t)""")
def init_cursors(bank: Bank) -> DataFrame:
    return scans.init_cursors(bank.transactions(), at("2024-02-01 00:00:00"))


# -- metrics --------------------------------------------------------------------

def _point(p: int, value: str) -> str:
    return f"round(max(case when rn = least(cast(floor(n*{p}/100) as bigint)+1, n) then {value} end), 1) as p{p}"


@query("latency_percentiles", f"""select txn_type, {', '.join(_point(p, 'sla_ms') for p in (50, 95, 99))} from
    (select txn_type, sla_ms, row_number() over (partition by txn_type order by sla_ms) as rn,
      count(*) over (partition by txn_type) as n from landing) group by txn_type""")
def latency_percentiles(bank: Bank) -> DataFrame:
    rows = bank.landing().select("txn_type", latency_ms("source_write_ts", "ingest_ts").alias("sla_ms"))
    return metrics.percentiles(rows, ["txn_type"], "sla_ms")


@query("rolling_percentiles", f"""select txn_type, {', '.join(_point(p, 'sla_ms') for p in (50, 95, 99))} from
    (select txn_type, sla_ms, row_number() over (partition by txn_type order by sla_ms) as rn,
      count(*) over (partition by txn_type) as n from (select *, row_number() over (partition by txn_type
      order by txn_id desc) as age from landing) where age <= 1000) group by txn_type""")
def rolling_percentiles(bank: Bank) -> DataFrame:
    rows = bank.landing().select("txn_type", "txn_id", latency_ms("source_write_ts", "ingest_ts").alias("sla_ms"))
    return metrics.rolling_percentiles(rows, ["txn_type"], "sla_ms", ["txn_id"])


_BOUND = 0.01


@query("sketch_percentiles", "select txn_type, count(*) as n, true as p50_holds, true as p95_holds, true as p99_holds from landing group by txn_type")
def sketch_percentiles(bank: Bank) -> DataFrame:
    """One sketch per batch of a thousand rows, merged per type; each percentile's rank is checked on the rows."""
    rows = bank.landing().select("txn_id", "txn_type", latency_ms("source_write_ts", "ingest_ts").alias("sla_ms"))
    batches = rows.groupBy("txn_type", F.floor(F.col("txn_id") / 1000).alias("batch_no")).agg(metrics.quantile_sketch(F.col("sla_ms")).alias("sketch"))
    found = metrics.sketch_percentiles(batches, ["txn_type"], "sketch")
    ranked = rows.join(F.broadcast(found), "txn_type").groupBy("txn_type", "n")

    def holds(p: int) -> Column:
        below, upto = (F.count_if(F.col("sla_ms") < F.col(f"p{p}")), F.count_if(F.col("sla_ms") <= F.col(f"p{p}")))
        return ((below / F.count("*") <= p / 100 + _BOUND) & (upto / F.count("*") >= p / 100 - _BOUND)).alias(f"p{p}_holds")

    return ranked.agg(*[holds(p) for p in (50, 95, 99)])


_RATE = {
    "entries": "select * from batch_log",
    "newest": "select max(finished_ts) as as_of from batch_log",
}


@query("throughput_60_5", """select cast(coalesce(sum(rows) filter (where epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', finished_ts)) <= 60), 0) as bigint) as rows_last_60s,
    cast(coalesce(sum(rows) filter (where epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', finished_ts)) <= 5), 0) as bigint) as rows_last_5s,
    round(coalesce(sum(rows) filter (where epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', finished_ts)) <= 5), 0) / 5, 1) as tps_last_5s
    from entries join newest on true""", _RATE)
def throughput_60_5(bank: Bank) -> DataFrame:
    log = bank.batch_log()
    return metrics.throughput(log, log.agg(F.max("finished_ts")).scalar())


@query("lifetime_throughput", """select count(*) as total, cast(epoch(max(ts)) as bigint) - cast(epoch(min(ts)) as bigint) as elapsed_s,
    coalesce(round(count(*) / nullif(cast(epoch(max(ts)) as bigint) - cast(epoch(min(ts)) as bigint), 0), 1), 0) as rate
    from (select date_trunc('second', ts) as ts from events)""")
def lifetime_throughput(bank: Bank) -> DataFrame:
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    totals = bank.events.agg(F.count("*").alias("total"), (F.max(second) - F.min(second)).alias("elapsed_s"))
    return totals.withColumn("rate", metrics.lifetime_rate(F.col("total"), F.col("elapsed_s")))


@query("batch_log_latency", """select path, batch_no, rows, duration_ms, duration_ms / greatest(rows, 1) as row_ms
    from batch_log""")
def batch_log_latency(bank: Bank) -> DataFrame:
    return metrics.per_row_ms(bank.batch_log()).select("path", "batch_no", "rows", "duration_ms", "row_ms")


@query("ingest_totals", """select path, cast(sum(rows) as bigint) as total_rows, count(*) as batches,
    cast(sum(errors) as bigint) as errors from batch_log group by path""")
def ingest_totals(bank: Bank) -> DataFrame:
    return metrics.ingest_totals(bank.batch_log())


_STATUS = {
    **_RATE,
    "samples": """select path, batch_no, case when path='txn' then cast(duration_ms as double)
        else duration_ms / greatest(rows, 1) end as v from batch_log""",
    "ranked": """select path, v, row_number() over (partition by path order by v) as rn, count(*) over (partition by path) as n
        from (select *, row_number() over (partition by path order by batch_no desc) as age from samples) where age <= 1000""",
    "points": f"select path, {', '.join(_point(p, 'v') for p in (50, 95, 99))} from ranked group by path",
    "rate": """select sum(rows) filter (where epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', finished_ts)) <= 60) as r60,
        sum(rows) filter (where epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', finished_ts)) <= 5) as r5
        from (select * from batch_log where path='txn') join newest on true""",
}


def _status_sql(paths: tuple[str, ...]) -> str:
    points = [f"(select p{p} from points where path='{path}') as {path}_p{p}_ms" for path in paths for p in (50, 95, 99)]
    totals = [f"(select cast(coalesce(sum(rows), 0) as bigint) from batch_log where path='{path}') as total_{path}" for path in paths]
    return "select " + ", ".join([*points, *totals]) + """, (select cast(sum(matched) as bigint) from batch_log) as member_matched,
    (select cast(sum(inserted) as bigint) from batch_log) as member_inserted,
    (select cast(sum(errors) as bigint) from batch_log) as errors,
    (select cast(coalesce(r60, 0) as bigint) from rate) as rows_last_60s,
    (select cast(coalesce(r5, 0) as bigint) from rate) as rows_last_5s,
    (select round(coalesce(r5, 0) / 5, 1) from rate) as tps_last_5s,
    (select cast(epoch(date_trunc('second', as_of)) - epoch(timestamp '2024-01-01') as bigint) from newest) as uptime_s"""


@query("status_row", _status_sql(metrics.PATHS), _STATUS)
def status_row(bank: Bank) -> DataFrame:
    log = bank.batch_log()
    return metrics.status_row(log, log.agg(F.max("finished_ts")).scalar(), at("2024-01-01 00:00:00"))


@query("status_by_table", _status_sql(metrics.TABLE_PATHS), {
    **_STATUS, "batch_log": TABLES["batch_log"].replace("case batch_no%3 when 0 then 'txn' when 1 then 'keyed' else 'member' end",
        "case batch_no%4 when 0 then 'txn' when 1 then 'account' when 2 then 'customer' else 'member' end"),
})
def status_by_table(bank: Bank) -> DataFrame:
    """The status row of a log that keeps accounts and customers apart."""
    log = bank.batch_log(metrics.TABLE_PATHS)
    return metrics.status_row(log, log.agg(F.max("finished_ts")).scalar(), at("2024-01-01 00:00:00"), metrics.TABLE_PATHS)

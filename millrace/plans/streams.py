"""The streaming operators run to the end of the given tables.

Each query stages a table in parts in the shared scratch folder, runs the stream
once per part from its checkpoint, and reads the result back.
"""

from __future__ import annotations

import functools
import math
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.foldstate import FoldRule
from millrace.operators.merge import account_rule, customer_rule, member_rule
from millrace.plans.fixtures import BATCH_TS, Bank, at
from millrace.plans.merging import ACCOUNT_CHANGES, ACCOUNTS_SQL, CUSTOMER_CHANGES, CUSTOMERS_SQL
from millrace.plans.oracles import ATTRIBUTES, fold_sql
from millrace.plans.registry import query
from millrace.schemas import ACCOUNTS, CUSTOMERS_CURRENT, LANDING, MEMBER_ATTRIBUTES, MEMBER_KEYS, MEMBERS, Contract
from millrace.session import own_session, scratch_path
from millrace.sources import envelope, mixed
from millrace.sources.feeds import FeedConfig, change_stream, table_stream, write_topic
from millrace.sources.polled import polled_stream
from millrace.sources.store import SnapshotTable
from millrace.streaming.arrivals import TO_THE_END, arrivals, settled
from millrace.streaming.merges import AppendWriter, MergeWriter, Writer, append_stream, fan_out, finish, start
from millrace.streaming.ordered import OrderedTable, OrderedWriter
from millrace.streaming.windows import first_arrivals, sliding_throughput

_PARTS = 3


def _parts(df: DataFrame, id_col: str, top: int, cuts: list[int] | None = None) -> list[DataFrame]:
    """The rows in contiguous id ranges, of the same width where no cuts are given."""
    cuts = [top * i // _PARTS for i in range(1, _PARTS)] if cuts is None else cuts
    lows, highs = [None, *cuts], [*cuts, None]
    parts = []
    for low, high in zip(lows, highs):
        part = df
        if low is not None:
            part = part.where(F.col(id_col) > low)
        if high is not None:
            part = part.where(F.col(id_col) <= high)
        parts.append(part)
    return parts


_ROWS_PER_STATE = 500_000


def _stream(**settings: str):
    """Run a query in a session of its own, with no more state partitions than the rows call for.

    A stream keeps the count it starts with and opens that many state stores in
    every batch; the caller's setting stays the upper bound.
    """

    def with_session(build: Callable[[Bank], DataFrame]) -> Callable[[Bank], DataFrame]:
        @functools.wraps(build)
        def run(bank: Bank) -> DataFrame:
            most = int(bank.spark.conf.get("spark.sql.shuffle.partitions"))
            wanted = max(8, math.ceil(bank.events.count() / _ROWS_PER_STATE))
            session = own_session(bank.spark, **{"spark.sql.shuffle.partitions": str(min(most, wanted))}, **settings)
            return build(Bank(session, bank.folder))

        return run

    return with_session


def _top(bank: Bank) -> int:
    return bank.half * 2 + 1


@query("stream_members", f"""select ssn_last4, last_name, {', '.join(ATTRIBUTES)}, 'STREAM' as source_system,
    timestamp '{BATCH_TS}' as updated_at from all_folded where live""", {"all_folded": fold_sql("changes")})
@_stream()
def stream_members(bank: Bank) -> DataFrame:
    """JSON change events merged into golden records, one micro-batch per part."""
    spark = bank.spark
    base = scratch_path(spark, "stream-members")
    table = SnapshotTable(spark, f"{base}/members", MEMBERS.schema, ("ssn_last4", "last_name"))
    rule = member_rule(at(BATCH_TS), "STREAM", carry_source_ts=False)
    writer = MergeWriter(table, rule, envelope.POSITION)
    for part in _parts(bank.flat_messages(), "update_id", _top(bank)):
        lines = F.coalesce("value", F.lit("null")).alias("value")
        part.select(lines).write.mode("append").text(f"{base}/events")
        feed = change_stream(spark, FeedConfig(path=f"{base}/events"))
        changes = envelope.route(envelope.parse_flat(feed))
        finish(start(changes, writer, f"{base}/checkpoint", interval=None))
    return table.read().drop("member_id", "source_updated_at")


_MEMBER_SQL = f"""select ssn_last4, last_name, {', '.join(ATTRIBUTES)}, 'STREAM' as source_system,
    timestamp '{BATCH_TS}' as updated_at from all_folded where live"""


@query("stream_topic", _MEMBER_SQL, {"all_folded": fold_sql("changes")})
@_stream()
def stream_topic(bank: Bank) -> DataFrame:
    """The messages of a topic of several partitions, read with their positions and merged batch by batch."""
    spark = bank.spark
    base = scratch_path(spark, "stream-topic")
    table = SnapshotTable(spark, f"{base}/members", MEMBERS.schema, ("ssn_last4", "last_name"))
    writer = MergeWriter(table, member_rule(at(BATCH_TS), "STREAM", carry_source_ts=False), ["partition", "offset"])
    for part in _parts(bank.topic_messages(), "update_id", _top(bank)):
        write_topic(part, f"{base}/topic")
        feed = change_stream(spark, FeedConfig(topic_path=f"{base}/topic"))
        finish(start(envelope.route(envelope.parse_flat(feed)), writer, f"{base}/checkpoint", interval=None))
    return table.read().drop("member_id", "source_updated_at")


def _ordered_members(bank: Bank, base: str, order: str, replaced: tuple[str, ...] = ()) -> OrderedTable:
    rule = FoldRule(MEMBER_KEYS, order, MEMBER_ATTRIBUTES, replaced)
    constants = {"source_system": F.lit("STREAM")}
    return OrderedTable(bank.spark, f"{base}/members", MEMBERS.schema, rule, "member_id", "updated_at", constants)


@query("stream_ordered", _MEMBER_SQL, {"all_folded": fold_sql("changes")})
@_stream()
def stream_ordered(bank: Bank) -> DataFrame:
    """The same topic, but the batches are dealt out without regard to the order of its messages."""
    base = scratch_path(bank.spark, "stream-ordered")
    table = _ordered_members(bank, base, "partition int, offset long")
    writer = OrderedWriter(table, stamp=at(BATCH_TS))
    messages = bank.topic_messages()
    for turn in range(_PARTS):
        write_topic(messages.where(F.pmod(F.col("update_id") * 7 + 1, F.lit(_PARTS)) == turn), f"{base}/topic")
        feed = change_stream(bank.spark, FeedConfig(topic_path=f"{base}/topic"))
        finish(start(envelope.route(envelope.parse_flat(feed)), writer, f"{base}/checkpoint", interval=None))
    return table.read().drop("member_id", "source_updated_at")


@query("newest_wins", f"""select ssn_last4, last_name, {', '.join(ATTRIBUTES)}, 'STREAM' as source_system,
    timestamp '{BATCH_TS}' as updated_at, source_updated_at from all_folded where live""", {
    "aged": "select * replace (source_ts - to_hours(update_id * 7 % 48) as source_ts) from changes",
    "aged_changes": "select *, epoch_ms(source_ts) * 1000000 + update_id as seq from aged",
    "all_folded": fold_sql("aged_changes", seq="seq"),
})
def newest_wins(bank: Bank) -> DataFrame:
    """Source times run against the arrival, over three batches; the newest time wins."""
    table = _ordered_members(bank, scratch_path(bank.spark, "newest-wins"), "source_updated_at timestamp_ntz, update_id long", ("source_updated_at",))
    writer = OrderedWriter(table, stamp=at(BATCH_TS))
    back = F.make_dt_interval(hours=(F.col("update_id") * 7 % 48).cast("int"))
    aged = bank.member_changes.withColumn("source_updated_at", (F.col("source_updated_at") - back).cast("timestamp_ntz"))
    for number, part in enumerate(_parts(aged, "update_id", _top(bank))):
        writer(part, number)
    return table.read().drop("member_id")


def _loaded(bank: Bank, base: str, name: str, rows: DataFrame, contract: Contract) -> SnapshotTable:
    table = SnapshotTable(bank.spark, f"{base}/{name}", contract.schema, contract.primary_key, drop_old=True)
    table.commit(rows.select(*contract.schema.names), "load", 0)
    return table


# An event makes four messages; a compressed file is one task's.
_EVENTS_PER_PART = 1_000_000
_ROWS_PER_FILE = 100_000
_WHOLE = 1 << 62
# Shuffle files go when an action ends.
_FEED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Whoever writes the topic has its four files open in a task, instead of sorting the messages by partition.
_TELLER = {"spark.sql.maxConcurrentOutputFileWriters": "4"}


def _cuts(bank: Bank) -> list[int]:
    """Ids between parts of about as many events, which are few enough for one micro-batch."""
    parts = max(_PARTS, math.ceil(bank.events.count() / _EVENTS_PER_PART))
    shares = [i / parts for i in range(1, parts)]
    found = bank.events.agg(F.percentile_approx("event_id", F.array(*map(F.lit, shares)), F.lit(10_000))).first()[0]
    return sorted(set(found or [0]))


def _mixed_feed(bank: Bank, base: str, checkpoint: str, writer: Writer, select: Callable[[DataFrame], DataFrame] = lambda events: events) -> None:
    """The topic of four tables in parts, one micro-batch each, from one checkpoint.

    Files come in no order of their messages, so a batch that ends within a part would let older changes follow newer ones:
    parts are bounded, batches are not. Balances are summed once, not once a part; messages are kept in the topic only.
    """
    teller = Bank(own_session(bank.spark, **_TELLER), bank.folder)
    summed = teller.transactions(balance=True)
    summed.write.parquet(f"{base}/transactions", compression="zstd")
    transactions = teller.spark.read.schema(summed.schema).parquet(f"{base}/transactions")
    for part in _parts(teller.mixed_messages(transactions), "id", _top(bank), _cuts(bank)):
        write_topic(part, f"{base}/topic", compression="gzip", rows_per_file=_ROWS_PER_FILE)
        feed = change_stream(bank.spark, FeedConfig(topic_path=f"{base}/topic", bytes_per_batch=_WHOLE))
        finish(start(select(mixed.read_mixed(feed)), writer, f"{base}/{checkpoint}", interval=None))


@query("stream_accounts", ACCOUNTS_SQL, ACCOUNT_CHANGES)
@_stream(**_FEED)
def stream_accounts(bank: Bank) -> DataFrame:
    """Account events of a topic that holds four tables, merged into the accounts."""
    base = scratch_path(bank.spark, "stream-accounts")
    table = _loaded(bank, base, "accounts", bank.accounts, ACCOUNTS)
    writer = MergeWriter(table, account_rule(at(BATCH_TS)), list(mixed.POSITION), "accounts")
    _mixed_feed(bank, base, "checkpoint", writer, lambda e: mixed.changes_of(e, mixed.ACCOUNT_IMAGE))
    return table.read()


@query("stream_customers", CUSTOMERS_SQL, CUSTOMER_CHANGES)
@_stream(**_FEED)
def stream_customers(bank: Bank) -> DataFrame:
    base = scratch_path(bank.spark, "stream-customers")
    table = _loaded(bank, base, "customers", bank.current_customers(), CUSTOMERS_CURRENT)
    writer = MergeWriter(table, customer_rule(at(BATCH_TS)), list(mixed.POSITION), "customers")
    _mixed_feed(bank, base, "checkpoint", writer, lambda e: mixed.changes_of(e, mixed.CUSTOMER_IMAGE))
    return table.read()


def four_writers(bank: Bank, base: str) -> tuple[Writer, Callable[[], dict[str, DataFrame]]]:
    """One writer for the four tables of the mixed topic, and what they hold."""
    accounts = _loaded(bank, base, "accounts", bank.accounts, ACCOUNTS)
    customers = _loaded(bank, base, "customers", bank.current_customers(), CUSTOMERS_CURRENT)
    members = SnapshotTable(bank.spark, f"{base}/members", MEMBERS.schema, MEMBER_KEYS, drop_old=True)
    order, now = list(mixed.POSITION), at(BATCH_TS)
    ledger = AppendWriter(f"{base}/ledger", now)
    columns = mixed.TRANSACTION_IMAGE.schema.names
    writer = fan_out([
        (lambda e: mixed.changes_of(e, mixed.TRANSACTION_IMAGE).select(*columns), ledger),
        (lambda e: mixed.changes_of(e, mixed.ACCOUNT_IMAGE), MergeWriter(accounts, account_rule(now), order, "accounts")),
        (lambda e: mixed.changes_of(e, mixed.CUSTOMER_IMAGE), MergeWriter(customers, customer_rule(now), order, "customers")),
        (mixed.member_changes_of, MergeWriter(members, member_rule(now, "STREAM", carry_source_ts=False), order, "members")),
    ])

    def held() -> dict[str, DataFrame]:
        rows = bank.spark.read.parquet(f"{base}/ledger").select(*LANDING.schema.names)
        return {"transactions": rows, "accounts": accounts.read(), "customers": customers.read(), "members": members.read()}

    return writer, held


@query("stream_all", f"""select 'accounts' as table_name, cast(account_id as varchar) as row_key, cast(balance as varchar) as detail from ({ACCOUNTS_SQL})
    union all select 'customers', cast(customer_id as varchar), concat_ws('|', email, city, zip) from ({CUSTOMERS_SQL})
    union all select 'members', concat_ws('|', ssn_last4, last_name), concat_ws('|', coalesce(email, '-'), coalesce(phone, '-')) from all_folded where live
    union all select 'transactions', cast(txn_id as varchar), cast(amount as varchar) from ledger""",
    {**ACCOUNT_CHANGES, **CUSTOMER_CHANGES, "all_folded": fold_sql("changes")})
@_stream(**_FEED)
def stream_all(bank: Bank) -> DataFrame:
    """Every micro-batch of the topic goes to four tables, each committing it for itself."""
    base = scratch_path(bank.spark, "stream-all")
    writer, held = four_writers(bank, base)
    # The batch is kept for its four writers, who need no more than the parsed message and its position.
    _mixed_feed(bank, base, "checkpoint", writer, lambda e: e.drop("value", "key", "timestamp"))
    rows = held()
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    told = {
        "accounts": (F.col("account_id").cast("string"), F.col("balance").cast("string")),
        "customers": (F.col("customer_id").cast("string"), F.concat_ws("|", "email", "city", "zip")),
        "members": (F.concat_ws("|", "ssn_last4", "last_name"), F.concat_ws("|", dash("email"), dash("phone"))),
        "transactions": (F.col("txn_id").cast("string"), F.col("amount").cast("string")),
    }
    parts = [rows[t].select(F.lit(t).alias("table_name"), k.alias("row_key"), d.alias("detail")) for t, (k, d) in told.items()]
    return functools.reduce(DataFrame.unionByName, parts)


_POLLED = "update_id, ssn_last4, last_name, email, operation, updated_at"


@query("stream_polled", f"select {_POLLED} from member_updates")
@_stream()
def stream_polled(bank: Bank) -> DataFrame:
    """Updates polled by (time, id) while the table grows; the cursor lives in the checkpoint."""
    base = scratch_path(bank.spark, "stream-polled")
    updates = bank.member_updates.select(*_POLLED.split(", "))
    for part in _parts(updates, "update_id", _top(bank)):
        path = _staged(bank, part, base)
        polled = polled_stream(bank.spark, path, updates.schema, "updated_at", "update_id")
        finish(append_stream(polled, f"{base}/out", f"{base}/checkpoint", interval=None))
    return bank.spark.read.schema(updates.schema).parquet(f"{base}/out")


def _staged(bank: Bank, rows: DataFrame, base: str) -> str:
    path = f"{base}/rows"
    rows.write.mode("append").parquet(path)
    return path


_LANDING = "txn_id, account_id, txn_type, amount, txn_ts, source_write_ts, ingest_ts"


@query("stream_landing", f"select {_LANDING} from landing")
@_stream()
def stream_landing(bank: Bank) -> DataFrame:
    base = scratch_path(bank.spark, "stream-landing")
    landing = bank.landing().select(*_LANDING.split(", "))
    for part in _parts(landing, "txn_id", _top(bank)):
        path = _staged(bank, part, base)
        stream = table_stream(bank.spark, path, landing.schema)
        finish(append_stream(stream, f"{base}/out", f"{base}/checkpoint", interval=None))
    return bank.spark.read.schema(landing.schema).parquet(f"{base}/out")


@query("stream_dedup", f"select {_LANDING} from landing")
@_stream()
def stream_dedup(bank: Bank) -> DataFrame:
    """Every row is delivered twice and kept once."""
    base = scratch_path(bank.spark, "stream-dedup")
    landing = bank.landing().select(*_LANDING.split(", "))
    for part in _parts(landing, "txn_id", _top(bank)):
        path = _staged(bank, part.unionByName(part), base)
        stream = first_arrivals(table_stream(bank.spark, path, landing.schema), "txn_ts", "10 minutes")
        finish(append_stream(stream, f"{base}/out", f"{base}/checkpoint", interval=None))
    return bank.spark.read.schema(landing.schema).parquet(f"{base}/out")


def _closing_row(df: DataFrame, last: DataFrame) -> DataFrame:
    """The newest row again, two days later and under id -1, so that every open
    window and pending row before it is decided."""
    later = {
        c: F.col(c) + F.expr("interval 2 days") for c in df.columns if df.schema[c].dataType.typeName() == "timestamp_ntz"
    }
    moved = last.orderBy(F.desc("txn_id")).limit(1).withColumns({"txn_id": F.lit(-1).cast("long"), **later})
    return moved.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


_LATE = "case when txn_id % 13 = 0 then interval '2' hour when txn_id % 19 = 0 then interval '-5' second else interval '0' second end"


@query("stream_reconcile", f"""select txn_id, account_id, source_write_ts, came is not null as arrived, came as ingest_ts,
    date_diff('millisecond', source_write_ts, came) as sla_ms from (select *, ingest_ts + {_LATE} as came from ledger)""")
@_stream(**TO_THE_END)
def stream_reconcile(bank: Bank) -> DataFrame:
    """Some rows land two hours late, in a later batch, and some are stamped before they were written."""
    base = scratch_path(bank.spark, "stream-reconcile")
    ledger = bank.ledger().select("txn_id", "account_id", "source_write_ts", "ingest_ts")
    late = F.col("txn_id") % 13 == 0
    shift = F.when(late, 7200).when(F.col("txn_id") % 19 == 0, -5).otherwise(0)
    came = (F.col("ingest_ts") + F.make_dt_interval(secs=shift)).cast("timestamp_ntz").alias("ingest_ts")
    landed = ledger.where("ingest_ts is not null").select("txn_id", came)
    written, landings = ledger.drop("ingest_ts"), ledger.select("txn_id", "ingest_ts")
    top = _top(bank)
    batches = [*zip(_parts(written, "txn_id", top), _parts(landed.where(~late), "txn_id", top)), (None, landed.where(late))]
    for source_part, landed_part in batches:
        if source_part is not None:
            source_part.write.mode("append").parquet(f"{base}/source")
        landed_part.write.mode("append").parquet(f"{base}/landing")
        source = table_stream(bank.spark, f"{base}/source", written.schema)
        landing = table_stream(bank.spark, f"{base}/landing", landings.schema)
        finish(append_stream(arrivals(source, landing, buckets=32), f"{base}/out", f"{base}/checkpoint", interval=None))
    return settled(bank.spark.read.parquet(f"{base}/out"))


@query("stream_throughput", """select w as window_start, w + interval 60 second as window_end, count(*) as n_rows
    from (select unnest(generate_series(time_bucket(interval 15 second, ingest_ts) - interval 45 second,
      time_bucket(interval 15 second, ingest_ts), interval 15 second)) as w from landing) group by w""")
@_stream()
def stream_throughput(bank: Bank) -> DataFrame:
    base = scratch_path(bank.spark, "stream-throughput")
    landing = bank.landing().select("txn_id", "ingest_ts")
    for part in [*_parts(landing, "txn_id", _top(bank)), _closing_row(landing, landing)]:
        path = _staged(bank, part, base)
        rates = sliding_throughput(
            table_stream(bank.spark, path, landing.schema), width="60 seconds", slide="15 seconds", delay="1 hour"
        )
        finish(append_stream(rates, f"{base}/out", f"{base}/checkpoint", interval=None))
    return bank.spark.read.parquet(f"{base}/out")

"""The banking tables, derived by Spark from the given star-schema tables.

``FIXTURES.md`` describes the mapping; ``plans.oracles`` holds the same mapping
as SQL text for the checking engine.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ms_precision
from millrace.operators.ordered import running_sum
from millrace.schemas import MEMBER_ATTRIBUTES, MONEY
from millrace.session import use_utc
from millrace.sources.envelope import computed_once, normalise_polled, route

START = "2024-01-01 00:00:00"
# Fixed write times of the merge examples.
BEFORE_TS = "2024-02-01 00:00:00"
BATCH_TS = "2024-02-01 00:00:05"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _plus_seconds(seconds: Column) -> Column:
    return (at(START) + F.make_dt_interval(secs=seconds)).cast("timestamp_ntz")


def _digits(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


class Bank:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = use_utc(spark), folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def half(self) -> int:
        """Event id that splits the change history in two; one number."""
        return self.events.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] // 2

    @cached_property
    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            key.alias("customer_id"),
            _digits(key * 61 % 10000, 4).alias("ssn_last4"),
            F.lit("Customer").alias("first_name"),
            F.concat(F.lit("Name"), (key % 50).cast("string")).alias("last_name"),
            F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com")).alias("email"),
            F.when(key % 7 != 0, F.concat(F.lit("555-"), _digits(key % 10000, 4))).alias("phone"),
            F.concat((key % 900 + 100).cast("string"), F.lit(" Main St")).alias("street"),
            F.col("n_name").alias("city"),
            F.substring("n_name", 1, 2).alias("state"),
            _digits(key * 37 % 100000, 5).alias("zip"),
            _plus_seconds(key).alias("updated_at"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        key = F.col("c_custkey")
        segment = F.col("c_mktsegment")
        return self.table("customer").select(
            (key + 1000).alias("account_id"),
            key.alias("customer_id"),
            F.when(segment == "BUILDING", "SAVINGS")
            .when(segment == "MACHINERY", "LOAN")
            .when(segment == "FURNITURE", "MONEY_MARKET")
            .otherwise("CHECKING").alias("account_type"),
            F.col("c_acctbal").cast(MONEY).alias("balance"),
            F.when(key % 11 == 0, "FROZEN").when(key % 13 == 0, "CLOSED").otherwise("ACTIVE").alias("status"),
            _plus_seconds(key).alias("source_updated_at"),
            _plus_seconds(key + key % 5).alias("updated_at"),
        )

    def ledger(self, balance: bool = False, arrival: bool = True) -> DataFrame:
        """Source transactions; ``ingest_ts`` is null where a row has not arrived."""
        kind = F.col("event_type")
        txn_type = (
            F.when(kind == "purchase", "DEBIT").when(kind == "signup", "DEPOSIT")
            .when(kind == "view", "TRANSFER_IN").when(kind == "click", "FEE").otherwise("WITHDRAWAL")
        )
        ts = ms_precision("ts")
        ingest = F.expr("timestampadd(MILLISECOND, _late, txn_ts)").cast("timestamp_ntz")
        rows = computed_once(self.events, "k", F.from_json("props", "k int")["k"]) if arrival else self.events
        rows = rows.select(
            F.col("event_id").alias("txn_id"),
            (F.col("user_id") + 1000).alias("account_id"),
            txn_type.alias("txn_type"),
            F.when(kind.isin("signup", "view"), F.col("value")).otherwise(-F.col("value")).cast(MONEY).alias("amount"),
            F.concat(F.lit("Merchant"), (F.col("event_id") % 29).cast("string")).alias("merchant"),
            ts.alias("txn_ts"),
            ts.alias("source_write_ts"),
            *([(F.col("k") * 97).alias("_late")] if arrival else []),
        ).withColumn("description", F.concat("txn_type", F.lit(" #"), F.col("txn_id").cast("string")))
        columns = ["txn_id", "account_id", "txn_type", "amount", "description", "merchant"]
        tail = ["txn_ts", "source_write_ts"]
        if arrival:
            rows = rows.withColumn("ingest_ts", F.when(F.col("txn_id") % 17 != 0, ingest)).drop("_late")
            tail.append("ingest_ts")
        if not balance:
            return rows.select(*columns, *tail)
        # Joined first: the ranges made for the sum spread a busy account again.
        # Order by id: times are unique and ascending with it.
        opening = self.accounts.select("account_id", F.col("balance").alias("_opening"))
        summed = running_sum(
            rows.join(opening, "account_id"), ["account_id"], ["txn_id"], F.col("amount"), "_sum",
            size=self.events.count(),
        )
        return summed.select(*columns, (F.col("_opening") + F.col("_sum")).cast(MONEY).alias("balance_after"), *tail)

    def transactions(self, balance: bool = False) -> DataFrame:
        return self.ledger(balance, arrival=False)

    def landing(self, balance: bool = False) -> DataFrame:
        return self.ledger(balance).where(F.col("ingest_ts").isNotNull())

    @cached_property
    def member_updates(self) -> DataFrame:
        kind, user = F.col("event_type"), F.col("user_id")
        k = F.col("_k")
        moved = kind.isin("signup", "purchase")
        return self.events.withColumn("_k", F.from_json("props", "k int")["k"]).select(
            F.col("event_id").alias("update_id"),
            F.when(k == 50, "").otherwise(_digits(user * 61 % 10000, 4)).alias("ssn_last4"),
            F.concat(F.lit("Name"), (user % 50).cast("string")).alias("last_name"),
            F.when(k % 2 == 0, "Customer").alias("first_name"),
            F.when(kind == "click", F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("@example.com"))).alias("email"),
            F.when(kind == "view", F.concat(F.lit("555-"), _digits(k, 4))).alias("phone"),
            F.when(moved, F.concat(k.cast("string"), F.lit(" Main St"))).alias("street"),
            F.when(moved, F.concat(F.lit("City"), (k % 20).cast("string"))).alias("city"),
            F.when(moved, F.concat(F.lit("S"), (k % 10).cast("string"))).alias("state"),
            F.when(moved, _digits(k, 5)).alias("zip"),
            F.when((kind == "error") & (k < 10), "delete").otherwise("upsert").alias("operation"),
            ms_precision("ts").alias("source_ts"),
            ms_precision("ts").alias("updated_at"),
        )

    @cached_property
    def member_changes(self) -> DataFrame:
        """Routed changes with their action."""
        return route(normalise_polled(self.member_updates))

    def flat_messages(self, *keep) -> DataFrame:
        """Flat events as JSON: a third as objects, a third wrapped in a JSON
        string, a third with a padded key; deletes flagged, plus tombstones."""
        form = F.col("update_id") % 3
        padded = F.when(form == 2, F.concat("ssn_last4", F.lit("  "))).otherwise(F.col("ssn_last4"))
        payload = F.struct(
            "update_id", padded.alias("ssn_last4"), "last_name", *MEMBER_ATTRIBUTES, "operation",
            F.date_format("source_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("source_ts"),
            F.when(F.col("operation") == "delete", "d").otherwise("c").alias("__op"),
            F.when(F.col("operation") == "delete", "true").otherwise("false").alias("__deleted"),
            F.unix_millis(F.col("source_ts").cast("timestamp")).alias("__source_ts_ms"),
        )
        text = F.to_json(F.struct(payload.alias("payload")))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
        value = F.when(form == 1, quoted).otherwise(text)
        tombstone = F.when(F.col("operation") == "delete", F.array(value, F.lit(None))).otherwise(F.array(value))
        return self.member_updates.select("update_id", F.explode(tombstone).alias("value"), *keep)

    def topic_messages(self) -> DataFrame:
        """The flat messages with key, timestamp and an offset that is unique; a tombstone follows its delete."""
        key = F.concat_ws("|", "ssn_last4", "last_name").alias("key")
        offset = F.col("update_id") * 2 + F.col("value").isNull().cast("long")
        flat = self.flat_messages("source_ts", key)
        return flat.select("update_id", offset.alias("offset"), F.col("source_ts").cast("timestamp").alias("timestamp"), "key", "value")

    def _images(self) -> DataFrame:
        fields = ["update_id", "ssn_last4", "last_name", *MEMBER_ATTRIBUTES, "operation",
                  F.date_format("source_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("source_ts")]
        gone = F.col("operation") == "delete"
        image = F.struct(*fields)
        return self.member_updates.select(
            "update_id",
            gone.alias("gone"),
            F.when(gone, image).alias("before"),
            F.when(~gone, image).alias("after"),
            F.struct(
                F.lit("member_updates").alias("table"),
                F.unix_millis(F.col("source_ts").cast("timestamp")).alias("ts_ms"),
            ).alias("source"),
            F.when(gone, "d").when(F.col("first_name").isNull(), "u").otherwise("c").alias("op"),
        )

    def envelope_rows(self) -> DataFrame:
        """Before/after events as structs."""
        return self._images().drop("gone")

    def envelope_messages(self, op_field: str = "op") -> DataFrame:
        """Before/after events as JSON, with ``op`` codes or ``operation`` words."""
        op = F.col("op")
        if op_field == "operation":
            op = F.when(op == "d", "delete").when(op == "u", "update").otherwise("insert")
        text = F.to_json(F.struct(op.alias(op_field), "before", "after", "source"))
        return computed_once(self._images(), "value", text).select("update_id", "value")

    def account_changes(self, transactions: DataFrame | None = None) -> DataFrame:
        """A new balance per transaction, for every twentieth account."""
        user = F.col("account_id") - 1000
        return (self.transactions(balance=True) if transactions is None else transactions).select(
            (user * 20 + 1000).alias("account_id"), user.alias("customer_id"), F.lit("CHECKING").alias("account_type"),
            F.col("balance_after").alias("balance"),
            F.when(F.col("txn_type") == "FEE", "FROZEN").otherwise("ACTIVE").alias("status"),
            F.col("txn_ts").alias("source_updated_at"), "txn_id", F.lit("upsert").alias("action"),
        )

    def customer_changes(self) -> DataFrame:
        """A whole profile per member update, for every twentieth customer."""
        blank = {c: F.coalesce(F.col(c), F.lit("")) for c in MEMBER_ATTRIBUTES}
        owner = self.events.select(F.col("event_id").alias("update_id"), (F.col("user_id") * 20).alias("customer_id"))
        rows = self.member_updates.withColumns(blank).join(owner, "update_id")
        return rows.withColumns({"source_updated_at": F.col("source_ts"), "action": F.lit("upsert")})

    def current_customers(self) -> DataFrame:
        return self.customers.drop("ssn_last4").withColumn("source_updated_at", F.col("updated_at"))

    def mixed_messages(self, transactions: DataFrame | None = None) -> DataFrame:
        """Before/after events of four tables in one topic: (id, offset, timestamp, key, value).

        ``transactions`` are those with balances where they are stored already; a range of ids then costs no look at the others.
        """
        transactions = self.transactions(balance=True) if transactions is None else transactions

        def told(rows: DataFrame, number: int, table: str, image: list[str], id_col: str, key: Column, ts: str, gone: Column = F.lit(False)) -> DataFrame:
            kinds = dict(rows.dtypes)
            iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(c) if kinds[c] == "timestamp_ntz" else F.col(c)
            row = F.struct(*[iso(c) for c in image])
            source = F.struct(F.lit(table).alias("table"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"))
            text = F.to_json(F.struct(
                F.when(gone, "d").otherwise("c").alias("op"), F.when(gone, row).alias("before"), F.when(~gone, row).alias("after"), source.alias("source"),
            ))
            return rows.select(
                F.col(id_col).alias("id"), (F.col(id_col) * 4 + number).alias("offset"), F.col(ts).cast("timestamp").alias("timestamp"),
                F.concat(F.lit(f"{table}:"), key).alias("key"), text.alias("value"),
            )

        account = ["account_id", "customer_id", "account_type", "balance", "status", "source_updated_at"]
        profile = ["customer_id", "first_name", "last_name", *MEMBER_ATTRIBUTES[1:], "source_updated_at"]
        update = ["update_id", "ssn_last4", "last_name", *MEMBER_ATTRIBUTES, "operation", "source_ts"]
        txn = ["txn_id", "account_id", "txn_type", "amount", "description", "merchant", "balance_after", "txn_ts", "source_write_ts"]
        parts = [
            told(self.account_changes(transactions), 0, "accounts", account, "txn_id", F.col("account_id").cast("string"), "source_updated_at"),
            told(self.customer_changes(), 1, "customers", profile, "update_id", F.col("customer_id").cast("string"), "source_updated_at"),
            told(self.member_updates, 2, "member_updates", update, "update_id", F.concat_ws("|", "ssn_last4", "last_name"), "source_ts", F.col("operation") == "delete"),
            told(transactions, 3, "transactions", txn, "txn_id", F.col("account_id").cast("string"), "txn_ts"),
        ]
        return reduce(DataFrame.unionByName, parts)

    def batch_log(self, paths: tuple[str, ...] = ("txn", "keyed", "member")) -> DataFrame:
        """Fifty events make a batch; its path and outcome come from its rows."""
        batch = F.floor(F.col("event_id") / 50).cast("long")
        kind = F.col("event_type")
        path = F.element_at(F.array(*map(F.lit, paths)), (F.col("batch_no") % len(paths) + 1).cast("int"))
        return (
            self.events.groupBy(batch.alias("batch_no"))
            .agg(
                F.max("ts").alias("finished_ts"),
                F.count("*").alias("rows"),
                F.sum(F.from_json("props", "k long")["k"]).alias("duration_ms"),
                F.count_if(kind == "view").alias("matched"),
                F.count_if(kind == "signup").alias("inserted"),
                F.count_if((kind == "error") & (F.col("value") > 100)).alias("errors"),
            )
            .select(path.alias("path"), "batch_no", "finished_ts", "rows", "duration_ms", "matched", "inserted", "errors")
        )

"""Data-quality, masking and column-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import quality
from millrace.plans.fixtures import Bank, at
from millrace.plans.registry import query
from millrace.schemas import ACCOUNTS, CUSTOMERS, MONEY, TRANSACTIONS

_BROKEN = {
    "shown": """select account_id, customer_id, case when account_id%19=0 then 'BROKERAGE' else account_type end as account_type,
        case when account_id%23=0 then null else balance end as balance,
        case when account_id%29=0 then 'SUSPENDED-UNTIL-REVIEW' else status end as status from accounts""",
    "checked": """select *, list_filter([case when balance is null then 'null:balance' end,
        case when account_type='BROKERAGE' then 'domain:account_type' end,
        case when length(status)>10 then 'domain:status' end,
        case when length(status)>10 then 'length:status' end], lambda x: x is not null) as v from shown""",
}


def _shown_accounts(bank: Bank) -> DataFrame:
    key = F.col("account_id")
    return bank.accounts.select(
        "account_id", "customer_id",
        F.when(key % 19 == 0, "BROKERAGE").otherwise(F.col("account_type")).alias("account_type"),
        F.when(key % 23 != 0, F.col("balance")).alias("balance"),
        F.when(key % 29 == 0, "SUSPENDED-UNTIL-REVIEW").otherwise(F.col("status")).alias("status"),
    )


@query("quality_rejects", "select account_id, array_to_string(v, ',') as violations from checked where len(v) > 0", _BROKEN)
def quality_rejects(bank: Bank) -> DataFrame:
    bad = quality.split_valid(_shown_accounts(bank), ACCOUNTS)[1]
    return bad.select("account_id", F.array_join("violations", ",").alias("violations"))


@query("quality_valid", "select account_id, customer_id, account_type, balance, status from checked where len(v) = 0", _BROKEN)
def quality_valid(bank: Bank) -> DataFrame:
    return quality.split_valid(_shown_accounts(bank), ACCOUNTS)[0]


@query("cut_lengths", """select account_id, substring(status, 1, 10) as status, substring(account_type, 1, 20) as account_type
    from shown""", _BROKEN)
def cut_lengths(bank: Bank) -> DataFrame:
    return quality.cut_to_length(_shown_accounts(bank), ACCOUNTS).select("account_id", "status", "account_type")


@query("pk_duplicates", """select txn_id, cast(2 as bigint) as copies from ledger where amount > 50""")
def pk_duplicates(bank: Bank) -> DataFrame:
    """Rows above fifty are delivered twice."""
    rows = bank.transactions().select("txn_id", "amount")
    return quality.duplicate_keys(rows.unionByName(rows.where("amount > 50")), list(TRANSACTIONS.primary_key))


@query("fk_orphans", """select account_id, count(*) as child_rows from ledger
    where account_id not in (select account_id from accounts where status = 'ACTIVE') group by 1""")
def fk_orphans(bank: Bank) -> DataFrame:
    return quality.orphans(bank.transactions(), "account_id", bank.accounts.where("status = 'ACTIVE'"), "account_id")


@query("mask_ssn", """select customer_id, viewer, case when viewer in ('BANKER', 'ADMIN') then ssn_last4 else '****' end as ssn_last4
    from (select *, case customer_id%3 when 0 then 'TELLER' when 1 then 'BANKER' else 'ADMIN' end as viewer from customers)""")
def mask_ssn(bank: Bank) -> DataFrame:
    third = F.col("customer_id") % 3
    viewer = F.when(third == 0, "TELLER").when(third == 1, "BANKER").otherwise("ADMIN")
    rows = bank.customers.select("customer_id", viewer.alias("viewer"), "ssn_last4")
    return quality.mask_columns(rows, ["ssn_last4"], F.col("viewer"), ("BANKER", "ADMIN"))


@query("latency_bands", """select case when sla_ms < 1000 then 'under_1s' when sla_ms < 3000 then '1s_to_3s'
    when sla_ms < 6000 then '3s_to_6s' else 'over_6s' end as band, count(*) as n_rows from landing group by 1""")
def latency_bands(bank: Bank) -> DataFrame:
    ms = fn.latency_ms("source_write_ts", "ingest_ts")
    return bank.landing().groupBy(fn.latency_band(ms).alias("band")).agg(F.count("*").alias("n_rows"))


_TENTHS = "(((ms+50)//100)//10) || '.' || (((ms+50)//100)%10) || 's'"
_SIZED = "format('{:,}', cast(floor(abs(amount)) as bigint)) || '.' || lpad(cast(cast(abs(amount)*100 as bigint)%100 as varchar), 2, '0')"


@query("display_columns", f"""select txn_id,
    case when ms is null then '—' when ms < 1000 then ms || 'ms' when ms >= 10000 then ((ms+500)//1000) || 's' else {_TENTHS} end as short_label,
    case when ms is null then 'pending...' when ms < 1000 then ms || 'ms' else {_TENTHS} end as long_label,
    case when age < 60 then age || 's ago' when age < 3600 then (age//60) || 'm ago' else (age//3600) || 'h ago' end as age,
    case when age < 60 then age || 's ago' when age < 3600 then (age//60) || 'm ago' else strftime(txn_ts, '%H:%M:%S') end as age_clock,
    case when amount >= 0 then '+$' else '$' end || {_SIZED} as feed_amount,
    case when amount >= 0 then '+$' else '-$' end || {_SIZED} as signed_amount,
    'ACC-' || case when length(cast(account_id*7-6900 as varchar)) < 4 then lpad(cast(account_id*7-6900 as varchar), 4, '0') else cast(account_id*7-6900 as varchar) end as account_label,
    coalesce(strftime(ingest_ts, '%H:%M:%S.%g'), '') as clock,
    case when amount >= 0 then 'credit' else 'debit' end as amount_class,
    case when txn_type in ('DEPOSIT','TRANSFER_IN') then 'credit' when txn_type in ('DEBIT','WITHDRAWAL') then 'debit'
      when txn_type='FEE' then 'fee' else 'other' end as txn_group,
    round(ms / 1000, 1) as seconds, strftime(ingest_ts, '%Y-%m-%dT%H:%M:%S.%g') as iso, cast(txn_ts as date) as txn_date,
    nullif(ms, 0) as ms_or_null
    from (select *, 2 * date_diff('millisecond', source_write_ts, ingest_ts) as ms,
      cast(round(greatest(date_diff('millisecond', txn_ts, timestamp '2024-01-30 12:00:00'), 0) / 1000) as bigint) as age from ledger)""")
def display_columns(bank: Bank) -> DataFrame:
    """Latencies are doubled here so that labels beyond ten seconds occur."""
    rows = bank.ledger().withColumn("ms", fn.latency_ms("source_write_ts", "ingest_ts") * 2)
    as_of = at("2024-01-30 12:00:00")
    return rows.select(
        "txn_id",
        fn.latency_label("ms").alias("short_label"),
        fn.latency_label("ms", missing="pending...", long_form=True).alias("long_label"),
        fn.age_label("txn_ts", as_of).alias("age"),
        fn.age_label("txn_ts", as_of, clock_after_hour=True).alias("age_clock"),
        fn.currency_text("amount").alias("feed_amount"),
        fn.currency_text("amount", keep_sign=True).alias("signed_amount"),
        fn.account_label(F.col("account_id") * 7 - 6900).alias("account_label"),
        fn.clock_text("ingest_ts").alias("clock"),
        fn.amount_class("amount").alias("amount_class"),
        fn.txn_group("txn_type").alias("txn_group"),
        fn.seconds_from_ms("ms").alias("seconds"),
        fn.iso_text("ingest_ts").alias("iso"),
        fn.utc_date("txn_ts").alias("txn_date"),
        fn.null_if_zero("ms").alias("ms_or_null"),
    )


@query("address_parts", """select customer_id, case when customer_id%5=0 then 'Anytown' else city end as city,
    case when customer_id%5=0 then 'CA' else state end as state,
    case customer_id%5 when 0 then '90210' when 1 then '00000' else zip end as zip
    from customers""")
def address_parts(bank: Bank) -> DataFrame:
    form = F.col("customer_id") % 5
    line = (
        F.when(form == 0, F.concat_ws(" ", "street", "state"))
        .when(form == 1, F.concat("city", F.lit(", "), "state"))
        .otherwise(F.concat("city", F.lit(", "), "state", F.lit(" "), "zip"))
    )
    rows = bank.customers.select("customer_id", line.alias("line"))
    return rows.select("customer_id", *[c.alias(n) for n, c in fn.address_parts("line").items()])


@query("text_rules", """select customer_id, case when customer_id%4=0 then first_name else first_name end as first_part,
    case when customer_id%4=0 then 'Smith' else last_name || ' Jr' end as rest,
    'Direct' as first_word, substring(email, 1, 8) as cut, coalesce(phone, '') as phone_text,
    case when customer_id%7<>0 then phone end as phone_back, ssn_last4 as key_text,
    first_name || ' ' || last_name as full_name
    from customers""")
def text_rules(bank: Bank) -> DataFrame:
    alone = F.col("customer_id") % 4 == 0
    name = F.when(alone, F.col("first_name")).otherwise(F.concat("first_name", F.lit(" "), "last_name", F.lit(" Jr")))
    phone = fn.blank_if_null("phone")
    return bank.customers.select(
        "customer_id", fn.first_name_of(name).alias("first_part"), fn.last_name_of(name).alias("rest"),
        fn.first_word(F.concat(F.lit("Direct "), "city")).alias("first_word"),
        fn.cut_text("email", 8).alias("cut"), phone.alias("phone_text"), fn.null_if_blank(phone).alias("phone_back"),
        fn.trimmed_key(F.concat("ssn_last4", F.lit("  "))).alias("key_text"),
        fn.full_name("first_name", "last_name").alias("full_name"),
    )


@query("amount_rules", """select account_id, cast(greatest(0.01, round(balance * 0.0001, 2)) as decimal(18,2)) as interest,
    cast(greatest(50.00, least(balance, 5000.00)) as decimal(18,2)) as clamped, status = 'ACTIVE' as active from accounts""")
def amount_rules(bank: Bank) -> DataFrame:
    return bank.accounts.select(
        "account_id", fn.interest_amount("balance").alias("interest"),
        fn.clamp("balance", 50, 5000).cast(MONEY).alias("clamped"), fn.is_active("status").alias("active"),
    )


@query("ledger_text_rules", """select txn_id, case when txn_type in ('DEBIT','WITHDRAWAL','FEE','TRANSFER_OUT') then -abs(amount) else abs(amount) end as signed,
    case txn_type when 'DEBIT' then 'POS Purchase - ' || merchant when 'DEPOSIT' then merchant || ' Payroll' when 'FEE' then merchant
      when 'WITHDRAWAL' then 'ATM Withdrawal' else 'Internal Account Transfer' end as text,
    case txn_type when 'DEBIT' then merchant when 'DEPOSIT' then merchant when 'WITHDRAWAL' then 'ATM' else 'House Bank' end as party
    from ledger""")
def ledger_text_rules(bank: Bank) -> DataFrame:
    detail = F.when(F.col("txn_type") == "DEPOSIT", F.concat("merchant", F.lit(" Payroll"))).otherwise(F.col("merchant"))
    rows = bank.transactions().withColumn("detail", detail)
    return rows.select(
        "txn_id", fn.signed_amount("txn_type", F.abs("amount")).alias("signed"),
        fn.txn_description("txn_type", "detail").alias("text"), fn.txn_merchant("txn_type", "detail").alias("party"),
    )


@query("length_rejects", """select customer_id, 'length:phone' as violations from customers where phone is not null""")
def length_rejects(bank: Bank) -> DataFrame:
    """Phone numbers are lengthened past their limit; nothing else is wrong."""
    long_phone = F.concat("phone", F.lit(" extension 0123456789"))
    bad = quality.split_valid(bank.customers.withColumn("phone", long_phone), CUSTOMERS)[1]
    return bad.select("customer_id", F.array_join("violations", ",").alias("violations"))

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import quality, reconcile
from millrace.schemas import ACCOUNTS
from millrace.sources import envelope, scans

T0 = datetime(2024, 1, 1)


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expression("v"), "i").orderBy("i").collect()]


def test_latency_labels_and_bands(spark):
    ms = [0, 999, 1000, 2999, 3000, 5999, 6000, 9999, 10000, None]
    assert column(spark, ms, "long", fn.latency_label) == [
        "0ms", "999ms", "1.0s", "3.0s", "3.0s", "6.0s", "6.0s", "10.0s", "10s", "—"]
    assert column(spark, ms, "long", lambda c: fn.latency_label(c, "pending...", True))[-2:] == ["10.0s", "pending..."]
    assert column(spark, ms, "long", fn.latency_band) == [
        "under_1s", "under_1s", "1s_to_3s", "1s_to_3s", "3s_to_6s", "3s_to_6s", "over_6s", "over_6s", "over_6s", None]


def test_latency_counts_boundaries(spark):
    df = spark.createDataFrame([(T0 + timedelta(microseconds=900), T0 + timedelta(microseconds=1100))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(fn.latency_ms("a", "b")).first()[0] == 1


def test_text_edges(spark):
    assert column(spark, [7, 12345], "long", fn.account_label) == ["ACC-0007", "ACC-12345"]
    amounts = [Decimal("1234.50"), Decimal("-1234.50"), Decimal("0")]
    assert column(spark, amounts, "decimal(18,2)", fn.currency_text) == ["+$1,234.50", "$1,234.50", "+$0.00"]
    assert column(spark, amounts, "decimal(18,2)", lambda c: fn.currency_text(c, keep_sign=True))[1] == "-$1,234.50"
    assert column(spark, ["Ann", "Ann Lee Roe"], "string", fn.last_name_of) == ["Smith", "Lee Roe"]
    assert column(spark, ["a", None], "string", lambda c: fn.full_name(F.lit("x"), c)) == ["x a", None]
    lines = ["Up, Down, NY 10001", "Town, CA", "nowhere"]
    parts = [column(spark, lines, "string", lambda c, k=k: fn.address_parts(c)[k]) for k in ("city", "state", "zip")]
    assert list(zip(*parts)) == [("Up, Down", "NY", "10001"), ("Town", "CA", "00000"), ("Anytown", "CA", "90210")]
    assert column(spark, [Decimal("-5"), Decimal("20000")], "decimal(18,2)", fn.interest_amount) == [Decimal("0.01"), Decimal("2.00")]


def test_cursor_keeps_ties(spark):
    rows = [(i, T0) for i in range(25)] + [(i, T0 + timedelta(seconds=1)) for i in range(25, 30)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz").repartition(3)
    cursor, seen = scans.Cursor(T0 - timedelta(seconds=1)), []
    while True:
        page = scans.incremental_scan(df, "ts", "id", cursor, limit=10)
        ids = sorted(r.id for r in page.collect())
        if not ids:
            break
        seen += ids
        cursor = scans.next_cursor(page, "ts", "id", cursor)
    assert seen == list(range(30))
    strict = scans.incremental_scan(df, "ts", None, scans.Cursor(T0), limit=10)
    assert sorted(r.id for r in strict.collect()) == list(range(25, 30))


def test_cursor_filter_reaches_the_file_scan(spark, tmp_path):
    spark.createDataFrame([(1, T0, "x")], "id long, ts timestamp_ntz, other string").write.parquet(str(tmp_path / "t"))
    scan = scans.incremental_scan(spark.read.parquet(str(tmp_path / "t")), "ts", "id", scans.Cursor(T0, 0), columns=["id", "ts"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThan(ts" in plan and "other" not in plan.split("ReadSchema")[1]


def test_flat_forms(spark):
    good = '{"payload":{"update_id":1,"ssn_last4":61,"last_name":"N","__deleted":"true"}}'
    wrapped = '"' + good.replace('"', '\\"') + '"'
    rows = [(good,), (wrapped,), (None,), ("{broken",), ('{"payload":{"ssn_last4":null,"last_name":"N"}}',)]
    got = envelope.route(envelope.parse_flat(spark.createDataFrame(rows, "value string"))).collect()
    assert [(r.ssn_last4, r.action) for r in got] == [("61", "delete"), ("61", "delete"), ("", "skip")]
    events = envelope.read_events(spark.createDataFrame(rows, "value string"), envelope.FLAT_EVENT)
    assert [r.value for r in envelope.split_corrupt(events)[1].collect()] == ["{broken"]


def test_zero_latency_kept_unless_asked(spark):
    source = spark.createDataFrame([(1, 5, "FEE", Decimal(1), "m", T0, Decimal(2)), (2, 6, "FEE", Decimal(1), "m", T0, Decimal(2))],
        "txn_id long, account_id long, txn_type string, amount decimal(18,2), merchant string, source_write_ts timestamp_ntz, balance_after decimal(18,2)")
    landing = spark.createDataFrame([(1, T0, T0 - timedelta(seconds=3)), (1, T0, T0)], "txn_id long, source_write_ts timestamp_ntz, ingest_ts timestamp_ntz")
    accounts = spark.createDataFrame([(5, Decimal(9))], "account_id long, balance decimal(18,2)")
    for rows in (None, 2):
        kept = {r.txn_id: (r.arrived, r.sla_ms, r.current_balance) for r in reconcile.reconcile(source, landing, accounts, rows).collect()}
        assert kept == {1: (True, 0, Decimal(9)), 2: (False, None, None)}
    nulled = reconcile.reconcile(source, landing, accounts, zero_as_null=True).where("txn_id = 1").first()
    assert nulled.sla_ms is None and nulled.arrived
    counts = reconcile.delivery_counts(reconcile.reconcile(source, landing, accounts)).first()
    assert tuple(counts) == (2, 1, 1, 50)


def test_rules_name_every_violation(spark):
    df = spark.createDataFrame([(1, 2, "GOLD", None, "ACTIVE", T0, T0), (2, 2, "LOAN", Decimal(1), "ACTIVE", T0, T0)], ACCOUNTS.schema)
    good, bad = quality.split_valid(df, ACCOUNTS)
    assert [r.account_id for r in good.collect()] == [2]
    assert bad.first().violations == ["null:balance", "domain:account_type"]

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from millrace.operators import ledger, metrics
from millrace.operators.ordered import newest_per_key, number_rows, previous_value, running_sum, split_heavy, top_per_key
from millrace.schemas import OUTGOING_TYPES, TXN_TYPES
from tests.models import replay_one_by_one

T0 = datetime(2024, 1, 1)


def busy_rows(n=400, seed=1):
    rng = random.Random(seed)
    # Account 0 holds most rows; times repeat, so ids break the ties.
    return [(i, rng.choice([0, 0, 0, 1, 2, 3, 4]), T0 + timedelta(seconds=i // 5), rng.randrange(-50, 60)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v long").repartition(5)


def test_running_sum_and_previous_over_chunks(spark):
    rows = busy_rows()
    df = frame(spark, rows)
    sums, last, want_sum, want_prev = defaultdict(int), {}, {}, {}
    for i, k, _, v in rows:
        sums[k] += v
        want_sum[i], want_prev[i] = sums[k], last.get(k)
        last[k] = v
    for size in (10_000, 37):
        got = running_sum(df, ["k"], ["ts", "id"], F.col("v"), "s", max_rows=size)
        assert {r.id: r.s for r in got.collect()} == want_sum
        prev = previous_value(df, ["k"], ["ts", "id"], "v", "p", max_rows=size)
        assert {r.id: r.p for r in prev.collect()} == want_prev


def test_number_rows_is_dense(spark):
    df = frame(spark, busy_rows(200))
    got = {r.id: r.n for r in number_rows(df, ["ts", "id"], "n", start=100, max_rows=31).collect()}
    assert got == {i: 101 + i for i in range(200)}


def test_top_and_newest(spark):
    rows = busy_rows()
    df = frame(spark, rows)
    want = defaultdict(list)
    for i, k, *_ in reversed(rows):
        if len(want[k]) < 3:
            want[k].append(i)
    for spread in (1, 4):
        got = defaultdict(list)
        for r in top_per_key(df, ["k"], [F.desc("ts"), F.desc("id")], 3, spread=spread).collect():
            got[r.k].append(r.id)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {r.k: r.id for r in newest_per_key(df, ["k"], ["ts", "id"]).collect()} == {k: v[0] for k, v in want.items()}


def test_percentile_index_rule(spark):
    def at(values, p):
        s = sorted(values)
        return round(s[min(int(len(s) * p / 100), len(s) - 1)], 1) if s else None

    cases = {"hundred": list(range(100)), "one": [7], "ties": [1] * 50 + [2] * 50, "few": [5, 1, 9]}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v long")
    for size in (10_000, 9):
        got = {r.k: (r.p50, r.p95, r.p99) for r in metrics.percentiles(df, ["k"], "v", max_rows=size).collect()}
        assert got == {k: tuple(at(vs, p) for p in (50, 95, 99)) for k, vs in cases.items()}
    assert got["hundred"][0] == 50
    empty = metrics.percentiles(df.where("v < 0"), [], "v").first()
    assert empty.p50 is None


def test_rolling_samples_are_the_latest(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(3000)], "m string, seq long, v double")
    row = metrics.rolling_percentiles(df, ["m"], "v", ["seq"], n=1000).first()
    assert (row.p50, row.p99) == (2500.0, 2990.0)


def replay_case(seed, n):
    rng = random.Random(seed)
    accounts = [
        (0, "CHECKING", Decimal("20.00")), (1, "LOAN", Decimal("-5.00")), (2, "SAVINGS", Decimal("-10.00")),
        (3, "MONEY_MARKET", Decimal("9000.00")), (4, "CHECKING", Decimal("0.00")),
    ]
    txns = []
    for i in range(n):
        kind = rng.choice(TXN_TYPES)
        size = Decimal(rng.randrange(1, 9000)) / 100
        txns.append((i, rng.choice([0, 0, 0, 0, 1, 2, 3, 4]), T0 + timedelta(seconds=i // 7), kind, -size if kind in OUTGOING_TYPES else size))
    return accounts, txns


def test_replay_equals_one_by_one_for_any_chunking(spark):
    accounts, txns = replay_case(3, 500)
    a = spark.createDataFrame(accounts, "account_id long, account_type string, balance decimal(18,2)")
    t = spark.createDataFrame(txns, "txn_id long, account_id long, txn_ts timestamp_ntz, txn_type string, amount decimal(18,2)")
    want = {}
    for account, kind, balance in accounts:
        own = [x for x in txns if x[1] == account]
        steps = replay_one_by_one(int(balance * 100), kind != "LOAN", [(x[3], int(x[4] * 100)) for x in own], OUTGOING_TYPES)
        for x, (after, booked) in zip(own, steps):
            want[x[0]] = (Decimal(after) / 100, None if booked is None else Decimal(booked) / 100)
    assert any(v[1] is None for v in want.values())
    for size in (10_000, 60):
        got = {r.txn_id: (r.balance_after, r.amount) for r in ledger.replay(a, t.repartition(3), max_rows=size).collect()}
        assert got == want


def test_balance_breaks_across_chunks(spark):
    rows, balance = [], Decimal("10.00")
    for i in range(50):
        balance += 1
        rows.append((i, 0, T0 + timedelta(seconds=i), Decimal(1), balance + (5 if i == 30 else 0)))
    t = spark.createDataFrame(rows, "txn_id long, account_id long, txn_ts timestamp_ntz, amount decimal(18,2), balance_after decimal(18,2)")
    a = spark.createDataFrame([(0, balance - 1)], "account_id long, balance decimal(18,2)")
    for size in (1000, 8):
        got = sorted((r.kind, r.txn_id) for r in ledger.balance_breaks(t, a, max_rows=size).collect())
        assert got == [("end", 49), ("step", 30), ("step", 31)]


def test_streamed_replay_equals_batch(spark, tmp_path):
    from millrace.sources.feeds import table_stream
    from millrace.streaming.balances import replay_stream
    from millrace.streaming.merges import append_stream, finish

    accounts, txns = replay_case(8, 120)
    a = spark.createDataFrame(accounts, "account_id long, account_type string, balance decimal(18,2)")
    t = spark.createDataFrame(txns, "txn_id long, account_id long, txn_ts timestamp_ntz, txn_type string, amount decimal(18,2)")
    for low in (0, 50):
        part = t.where((F.col("txn_id") >= low) & (F.col("txn_id") < (50 if low == 0 else 999)))
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = replay_stream(a, table_stream(spark, str(tmp_path / "in"), t.schema, None))
        finish(append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), interval=None))
    want = {r.txn_id: (r.amount, r.balance_after, r.accepted) for r in ledger.replay(a, t).collect()}
    got = {r.txn_id: (r.amount, r.balance_after, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_only_heavy_keys_are_chunked(spark, tmp_path):
    rows = busy_rows(3000)
    frame(spark, rows).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    light = df.where("k <> 0")
    for made in (running_sum(light, ["k"], ["ts", "id"], F.col("v"), "s", max_rows=1000), previous_value(light, ["k"], ["ts", "id"], "v", "p", max_rows=1000)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "ExistingRDD" not in plan and "Range" not in plan
    light_rows, heavy_rows, many = split_heavy(df, ["k"], 1000)
    assert many == heavy_rows.count() == sum(k == 0 for _, k, *_ in rows) and {r.k for r in heavy_rows.select("k").distinct().collect()} == {0}
    assert light_rows.count() + many == 3000
    nulls = df.withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    got = running_sum(nulls, ["k"], ["ts", "id"], F.col("v"), "s", max_rows=1000)
    want = running_sum(nulls, ["k"], ["ts", "id"], F.col("v"), "s", max_rows=10_000)
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_only_rows_from_the_first_break_are_walked(spark):
    accounts = [(0, "CHECKING", Decimal("1000.00")), (1, "CHECKING", Decimal("50.00"))]
    txns = [(i, i % 2, T0 + timedelta(seconds=i), "DEBIT", Decimal("-10.00")) for i in range(60)]
    a = spark.createDataFrame(accounts, "account_id long, account_type string, balance decimal(18,2)")
    t = spark.createDataFrame(txns, "txn_id long, account_id long, txn_ts timestamp_ntz, txn_type string, amount decimal(18,2)")
    rows = t.join(a, "account_id").selectExpr(
        "account_id", "0 as chunk", "txn_id", "txn_ts", "txn_type", "cast(amount * 100 as long) as cents", "true as outgoing", "true as deposit",
        "cast(balance * 100 as long) as opening",
    )
    full, rest = ledger.by_rule(rows)
    assert full.where("account_id = 0").count() == 30 and rest.where("account_id = 0").count() == 0
    # 50.00 pays five debits; the sixth and what follows are walked, from a balance of nothing.
    assert full.where("account_id = 1").count() == 5 and {r.start_at for r in rest.collect()} == {0}
    got = {r.txn_id: (r.balance_after, r.accepted) for r in ledger.replay(a, t).collect()}
    assert got[58] == (Decimal("700.00"), True) and got[9] == (Decimal("0.00"), True) and not got[11][1]


def test_sketches_of_batches_merge(spark):
    rng = random.Random(3)
    values = [(i // 100, "ab"[i % 2], int(rng.expovariate(0.001))) for i in range(20_000)]
    df = spark.createDataFrame(values, "batch int, k string, v long")
    stored = df.groupBy("batch", "k").agg(metrics.quantile_sketch(F.col("v")).alias("sketch"))
    none = spark.createDataFrame([(999, "a", None), (999, "c", None)], "batch int, k string, sketch binary")
    found = {r.k: r for r in metrics.sketch_percentiles(stored.unionByName(none), ["k"], "sketch").collect()}
    assert set(found) == {"a", "b"}
    for k in "ab":
        own = sorted(v for _, b, v in values if b == k)
        assert found[k].n == len(own)
        for p in (50, 95, 99):
            below, upto = sum(v < found[k][f"p{p}"] for v in own), sum(v <= found[k][f"p{p}"] for v in own)
            assert below / len(own) <= p / 100 + 0.01 and upto / len(own) >= p / 100 - 0.01

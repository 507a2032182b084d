"""Cases that once gave wrong or partial results: nulls, repeats, positions, late order, loads."""

import datetime
import itertools

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators.changes import fold_changes
from millrace.operators.merge import MergeRule, apply_merge, member_rule
from millrace.operators.metrics import percentiles, throughput
from millrace.operators.ordered import previous_value, running_sum
from millrace.schemas import MEMBERS
from millrace.sources import envelope
from millrace.sources.store import SnapshotTable
from millrace.streaming.merges import MergeWriter


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_null_keys_do_not_depend_on_chunks(spark, max_rows):
    df = spark.createDataFrame([(k, n, n) for k in (None, "a") for n in range(6)], "k string, n int, v int")
    sums = running_sum(df, ["k"], ["n"], F.col("v").cast("long"), "s", max_rows)
    before = previous_value(sums, ["k"], ["n"], "v", "p", max_rows)
    expected = {(k, n, sum(range(n + 1)), n - 1 if n else None) for k in (None, "a") for n in range(6)}
    assert {tuple(r) for r in before.select("k", "n", "s", "p").collect()} == expected
    found = {r.k: r.p50 for r in percentiles(df, ["k"], "v", (50,), max_rows=max_rows).collect()}
    assert found == {None: 3.0, "a": 3.0}


@pytest.mark.parametrize("small", [True, False])
def test_repeated_unique_key_is_reborn_once(spark, small):
    target = spark.createDataFrame([(1, "old"), (1, "older"), (2, "two"), (2, "two b"), (3, "gone")], "k long, v string")
    changes = spark.createDataFrame(
        [(1, 1, "delete", None), (1, 2, "upsert", "new"), (2, 3, "upsert", "up"), (3, 4, "delete", None), (4, 5, "upsert", "four")],
        "k long, at long, action string, v string",
    )
    rule = MergeRule(keys=("k",), replaced=("v",), unique=True)
    merged = apply_merge(target, fold_changes(changes, ["k"], ["at"], replaced=["v"]), rule, small=small)
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "new"), (2, "up"), (2, "up"), (4, "four")]


def test_a_change_without_order_is_refused(spark):
    changes = spark.createDataFrame([(1, None, "upsert")], "k long, at long, action string")
    with pytest.raises(PySparkException, match="no value in at"):
        fold_changes(changes, ["k"], ["at"]).collect()


def test_throughput_counts_every_batch_of_the_window(spark):
    now = datetime.datetime(2024, 1, 1, 0, 1, 0)
    log = spark.range(5000).select(F.lit(now - datetime.timedelta(seconds=30)).alias("finished_ts"), F.col("id").alias("batch_no"), F.lit(2).alias("rows"))
    assert throughput(log, F.lit(now)).first()["rows_last_60s"] == 10_000


EVENTS = [  # row ids come back with later deletes and updates; one change has no id
    (0, "c", 1, "p"), (1, "c", 2, "q"), (2, "d", 1, None), (3, "u", 2, "r"), (4, "u", 2, None), (5, "c", None, "s"), (6, "d", 2, None), (7, "c", 9, "t"),
]


def _messages(spark, events):
    image = lambda i, v: {"update_id": i, "ssn_last4": "0001", "last_name": "Name", "phone": v}
    import json

    rows = []
    for offset, op, i, v in events:
        side = "before" if op == "d" else "after"
        rows.append((json.dumps({"op": op, side: image(i, v), "source": {"ts_ms": 1000}}), 0, offset))
    return spark.createDataFrame(rows, "value string, partition int, offset long")


@pytest.mark.parametrize("cuts", [(), (3,), (1, 2, 3, 4, 5, 6, 7)])
@pytest.mark.parametrize("count", [3, 7, 8])
def test_topic_order_does_not_depend_on_batches(spark, tmp_path, cuts, count):
    table = SnapshotTable(spark, f"{tmp_path}/m", MEMBERS.schema, ("ssn_last4", "last_name"), buckets=2)
    now = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz")
    writer = MergeWriter(table, member_rule(now, "STREAM", carry_source_ts=False), envelope.POSITION)
    bounds = [0, *[c for c in cuts if c < count], count]
    for n, (a, b) in enumerate(itertools.pairwise(bounds)):
        part = list(reversed(EVENTS[a:b]))
        writer(envelope.route(envelope.parse_envelope(_messages(spark, part))), n)
    state = None
    for _, op, _, v in EVENTS[:count]:
        state = None if op == "d" else {"phone": v or (state or {}).get("phone")}
    assert [r.phone for r in table.read().collect()] == ([] if state is None else [state["phone"]])


def test_rejected_and_accepted_events_add_up(spark):
    df = spark.createDataFrame(
        [('{"operation":"INSERT","after":{"update_id":1}}',), ('{"operation":"drop","after":{}}',), ("{",), (None,),
         ('{"operation":"update"}',), ('{"operation":"delete","before":{"update_id":2,"source_ts":"1704067200123"}}',)],
        "value string",
    )
    good = envelope.parse_custom(df).orderBy("update_id").collect()
    assert [(r.update_id, r.op) for r in good] == [(1, "c"), (2, "d")]
    assert good[1].source_updated_at == datetime.datetime(2024, 1, 1, 0, 0, 0, 123000)
    reasons = sorted(r.reason for r in envelope.rejects(df, "custom").collect())
    assert reasons == ["corrupt", "no row image", "unknown operation"]


def _member(i):
    return (i, f"{i:04d}", "Name", None, None, None, None, None, None, None, "CORE", datetime.datetime(2024, 1, 1), None)


def test_ids_go_on_after_a_load(spark, tmp_path):
    for id_column in ("member_id", None):
        table = SnapshotTable(spark, f"{tmp_path}/{id_column}", MEMBERS.schema, ("ssn_last4", "last_name"), 4, id_column)
        table.commit(spark.createDataFrame([_member(i) for i in range(1, 6)], MEMBERS.schema), "load", 0)
        now = F.lit(datetime.datetime(2024, 1, 2)).cast("timestamp_ntz")
        writer = MergeWriter(table, member_rule(now, "STREAM", carry_source_ts=False), envelope.POSITION)
        event = EVENTS[-1]
        writer(envelope.route(envelope.parse_envelope(_messages(spark, [event]).withColumn("value", F.replace("value", F.lit('"Name"'), F.lit('"Other"'))))), 1)
        assert sorted(r.member_id for r in table.read().collect()) == [1, 2, 3, 4, 5, 6]


def test_bucket_count_is_kept(spark, tmp_path):
    path, keys = f"{tmp_path}/t", ("ssn_last4", "last_name")
    SnapshotTable(spark, path, MEMBERS.schema, keys, 4).commit(
        spark.createDataFrame([_member(i) for i in range(20)], MEMBERS.schema), "load", 0
    )
    again = SnapshotTable(spark, path, MEMBERS.schema, keys)
    assert all(again.lookup(f"{i:04d}", "Name").count() == 1 for i in range(0, 20, 7)) and again.buckets == 4
    with pytest.raises(ValueError, match="4 buckets"):
        SnapshotTable(spark, path, MEMBERS.schema, keys, 8).head()


def versions(path):
    return {(int(f.parent.name[4:]), int(f.name[7:])) for f in path.glob("data/ver=*/bucket=*")}


def test_buckets_no_head_names_are_dropped_where_asked(spark, tmp_path):
    """Each commit once left a copy of all it rewrote."""
    make = lambda name, drop: SnapshotTable(spark, str(tmp_path / name), rows(0).schema, ("k",), buckets=4, drop_old=drop)
    rows = lambda n: spark.range(40).selectExpr("id as k", f"{n} as n")
    kept, dropped = make("kept", False), make("dropped", True)
    for table in (kept, dropped):
        table.commit(rows(0), "w", 0)
        one = table.read().where(table.bucket() == 1)
        seen = [table.commit(one.selectExpr("k", f"{n} as n"), "w", n, rewritten={1}) for n in (1, 2)]
        assert {r.n for r in table.read(seen[0], {1}).collect()} == {1}  # readers on the head before lose nothing
        table.commit(rows(3), "w", 3)
        table.write_version(rows(9), 4)  # a try that never became a version
        assert table.read().where("n = 3").count() == 40
        assert {r.n for r in table.read(seen[1]).collect()} == {0, 2}
    assert {v for v, _ in versions(tmp_path / "kept")} == {0, 1, 2, 3, 4}
    assert versions(tmp_path / "dropped") == {(0, 0), (0, 2), (0, 3), (2, 1), *((v, b) for v in (3, 4) for b in range(4))}
    dropped.commit(rows(4), "w", 4)
    assert versions(tmp_path / "dropped") == {(v, b) for v in (3, 4) for b in range(4)}
    assert dropped.read().where("n = 4").count() == 40

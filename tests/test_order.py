"""Merges by position: batches, arrival order and repeats must not matter."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import foldstate
from millrace.operators.foldstate import FoldRule
from millrace.schemas import MEMBER_ATTRIBUTES, MEMBER_KEYS, MEMBERS
from millrace.streaming.merges import BatchLog
from millrace.streaming.ordered import OrderedTable, OrderedWriter
from tests.models import apply_one_by_one

T0 = datetime(2024, 1, 1)
ATTRIBUTES = ("first_name", "email", "phone", "street", "city", "state", "zip")
CHANGE = (
    "update_id long, ssn_last4 string, last_name string, " + ", ".join(f"{a} string" for a in ATTRIBUTES)
    + ", source_updated_at timestamp_ntz, action string"
)
NEWEST = FoldRule(MEMBER_KEYS, "source_updated_at timestamp_ntz, update_id long", MEMBER_ATTRIBUTES, ("source_updated_at",))


def stamp():
    return F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")


def table(spark, path, rule=NEWEST):
    return OrderedTable(spark, str(path), MEMBERS.schema, rule, "member_id", "updated_at", {"source_system": F.lit("EXTERNAL")}, buckets=4)


def random_changes(rng, n=90, keys=9):
    made = []
    for i in range(n):
        row = {"update_id": i, "ssn_last4": f"{rng.randrange(keys):04d}", "last_name": rng.choice("AB")}
        row.update({a: rng.choice([None, None, f"{a}{i}", ""]) for a in ATTRIBUTES})
        # Source times repeat, run against the arrival and are missing at times.
        row["source_updated_at"] = None if rng.random() < 0.1 else T0 + timedelta(seconds=rng.randrange(25))
        row["action"] = rng.choice(["upsert"] * 7 + ["delete", "delete", "skip"])
        made.append(row)
    return made


def frame(spark, changes):
    return spark.createDataFrame([tuple(c.values()) for c in changes], CHANGE)


def state(rows):
    return sorted((r["ssn_last4"], r["last_name"], *[str(r[a]) for a in ATTRIBUTES], str(r["source_updated_at"])) for r in rows)


def expected(changes, target=()):
    by_time = sorted(changes, key=lambda c: (c["source_updated_at"] is not None, c["source_updated_at"] or T0, c["update_id"]))
    return state(apply_one_by_one(target, by_time))


@pytest.mark.parametrize("seed", [1, 2])
def test_one_two_and_many_batches_in_any_order_give_one_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    changes = random_changes(rng)
    want = expected(changes)
    for parts in (1, 2, 6):
        arriving = list(changes)
        rng.shuffle(arriving)
        target = table(spark, tmp_path / f"p{parts}")
        writer = OrderedWriter(target, stamp=stamp())
        for p in range(parts):
            batch = arriving[p::parts] + arriving[:3]  # three changes come with every batch
            writer(frame(spark, batch), p)
        assert state(target.read().collect()) == want
        ids = [r.member_id for r in target.read().collect()]
        assert None not in ids and len(set(ids)) == len(ids)


def test_loaded_rows_keep_against_older_changes(spark, tmp_path):
    target = table(spark, tmp_path / "t")
    loaded = [
        (1, "0001", "A", "Ann", "a@x", None, "s", "c", "st", "z", "CORE", T0, T0 + timedelta(seconds=5)),
        (2, "0002", "A", "Bob", None, None, None, None, None, None, "CORE", T0, None),
    ]
    rows = spark.createDataFrame(loaded, MEMBERS.schema)
    target.load(rows, {"source_updated_at": F.col("source_updated_at")})
    assert {(r.member_id, r.ssn_last4, r.email) for r in target.read().collect()} == {(1, "0001", "a@x"), (2, "0002", None)}
    none = dict.fromkeys(ATTRIBUTES)
    change = lambda i, key, second, action="upsert", **v: {
        "update_id": i, "ssn_last4": key, "last_name": "A", **none, **v, "source_updated_at": T0 + timedelta(seconds=second), "action": action,
    }
    log = BatchLog(str(tmp_path / "log"))
    writer = OrderedWriter(target, stamp=stamp(), log=log)
    writer(frame(spark, [
        change(1, "0001", 4, email="old@x", phone="1"), change(2, "0001", 5, email="same@x"), change(3, "0002", 1, "delete"),
        change(4, "0003", 9, email="new@x"), change(5, "0001", 3, "delete"),
    ]), 1)
    found = {r.ssn_last4: r for r in target.read().collect()}
    assert set(found) == {"0001", "0003"}
    assert (found["0001"].email, found["0001"].phone, found["0001"].first_name) == ("same@x", "1", "Ann")
    assert found["0003"].member_id == 3
    writer(frame(spark, [change(6, "0002", 2, phone="2"), change(7, "0003", 8, "delete"), change(8, "0001", 6, "skip")]), 2)
    found = {r.ssn_last4: r for r in target.read().collect()}
    assert (found["0002"].member_id, found["0002"].first_name, found["0002"].phone) == (4, None, "2")
    assert found["0003"].member_id == 3 and target.lookup("0002", "A").count() == 1
    entries = sorted((r.batch_no, r.rows, r.matched, r.inserted, r.deleted) for r in log.read(spark).collect())
    assert entries == [(1, 5, 1, 1, 1), (2, 2, 1, 1, 0)]
    with pytest.raises(Exception, match="repeat a key"):
        table(spark, tmp_path / "u").load(rows.unionByName(rows), {"source_updated_at": F.col("source_updated_at")})


def test_a_failed_batch_leaves_the_table_and_runs_again(spark, tmp_path, monkeypatch):
    changes = random_changes(random.Random(4), 40)
    target = table(spark, tmp_path / "t")
    writer = OrderedWriter(target, stamp=stamp())
    writer(frame(spark, changes[:20]), 0)
    once = state(target.read().collect())

    def fail(commit):
        raise RuntimeError("stopped before the switch")

    monkeypatch.setattr(target.states, "switch", fail)
    with pytest.raises(RuntimeError):
        writer(frame(spark, changes[20:]), 1)
    monkeypatch.undo()
    assert state(target.read().collect()) == once
    writer(frame(spark, changes[20:]), 1)
    writer(frame(spark, changes[20:]), 1)
    assert state(target.read().collect()) == expected(changes)


def test_changes_without_order_are_refused_and_nothing_is_nothing(spark, tmp_path):
    rule = FoldRule(("k",), "ts timestamp_ntz, n long", ("v",))
    rows = spark.createDataFrame([("a", None, None, "x", "upsert")], "k string, ts timestamp_ntz, n long, v string, action string")
    with pytest.raises(Exception, match="no value in ts, n"):
        foldstate.state_of(rows, rule).collect()
    target = table(spark, tmp_path / "t")
    OrderedWriter(target, stamp=stamp())(frame(spark, random_changes(random.Random(1), 3)).limit(0), 0)
    assert target.read().count() == 0 and target.states.head().batches == {"member": 0}

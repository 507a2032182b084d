import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators.changes import fold_changes
from millrace.operators.merge import (
    account_rule, apply_merge, customer_rule, delete_keys, member_rule, merge_outcomes, resolve, update_columns,
)
from millrace.schemas import ACCOUNTS, MEMBERS
from tests.models import ATTRIBUTES, apply_one_by_one

CHANGE = (
    "update_id long, ssn_last4 string, last_name string, "
    + ", ".join(f"{a} string" for a in ATTRIBUTES)
    + ", source_updated_at timestamp_ntz, action string"
)
T0 = datetime(2024, 1, 1)


def stamp():
    return F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")


def random_changes(rng, n, keys=6):
    out = []
    for i in range(n):
        k = rng.choice([0] * 4 + list(range(keys)))  # one busy key
        out.append(
            {
                "update_id": i,
                "ssn_last4": "" if rng.random() < 0.05 else f"{k:04d}",
                "last_name": f"Name{k % 3}",
                **{a: rng.choice([None, None, f"{a}{i}"]) for a in ATTRIBUTES},
                "source_updated_at": None if rng.random() < 0.2 else T0 + timedelta(seconds=rng.randrange(100)),
                "action": "upsert",
            }
        )
        if out[-1]["ssn_last4"] == "":
            out[-1]["action"] = "skip"
        elif rng.random() < 0.15:
            out[-1]["action"] = "delete"
    return out


def random_target(rng):
    rows = []
    for i in range(8):  # repeated match keys on purpose
        k = rng.randrange(6)
        rows.append(
            {
                "member_id": i + 1, "ssn_last4": f"{k:04d}", "last_name": f"Name{k % 3}",
                **{a: rng.choice([None, f"old{i}"]) for a in ATTRIBUTES},
                "source_system": "CORE", "updated_at": T0, "source_updated_at": T0,
            }
        )
    return rows


def as_set(rows, ids=True):
    names = (["member_id"] if ids else []) + ["ssn_last4", "last_name", *ATTRIBUTES, "source_system", "source_updated_at"]
    return sorted((tuple(str(r[c]) for c in names) for r in rows))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("small", [True, False])
def test_fold_and_merge_equal_one_by_one(spark, seed, small):
    rng = random.Random(seed)
    target, changes = random_target(rng), random_changes(rng, 60)
    carry = seed % 2 == 0
    rule = member_rule(stamp(), "TAG", carry)
    schema = MEMBERS.schema
    target_df = spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in target], schema)
    shuffled = changes[:]
    rng.shuffle(shuffled)
    changes_df = spark.createDataFrame([tuple(c.values()) for c in shuffled], CHANGE)
    folded = rule.fold(changes_df, ["update_id"]).persist()
    got = [r.asDict() for r in apply_merge(target_df, folded, rule, last_id=8, small=small, max_rows=3).collect()]
    want = apply_one_by_one(target, changes, "TAG", carry, next_id=9)
    assert as_set(got, ids=False) == as_set(want, ids=False)
    new_got = sorted((r for r in got if r["member_id"] > 8), key=lambda r: r["member_id"])
    new_want = sorted((r for r in want if r["member_id"] > 8), key=lambda r: r["member_id"])
    assert [(r["ssn_last4"], r["last_name"]) for r in new_got] == [(r["ssn_last4"], r["last_name"]) for r in new_want]
    assert [r["member_id"] for r in new_got] == list(range(9, 9 + len(new_got)))
    counted = merge_outcomes(resolve(target_df, folded, list(rule.keys), small)).first()
    assert counted["changes"] == sum(c["action"] != "skip" for c in changes)
    assert counted["inserted"] == len(new_got)
    assert len(target) - counted["deleted"] + counted["inserted"] == len(got)
    folded.unpersist()


def test_several_batches_equal_one(spark):
    rng = random.Random(99)
    changes = random_changes(rng, 90)
    rule = member_rule(stamp(), "TAG")
    results = []
    for cut in (90, 45, 18):
        table = spark.createDataFrame([], MEMBERS.schema)
        for low in range(0, 90, cut):
            batch = spark.createDataFrame([tuple(c.values()) for c in changes[low : low + cut]], CHANGE)
            merged = apply_merge(table, rule.fold(batch, ["update_id"]), rule, small=True)
            table = spark.createDataFrame(merged.collect(), MEMBERS.schema)
        results.append(as_set([r.asDict() for r in table.collect()], ids=False))
    assert results[0] == results[1] == results[2]


def test_edge_folds(spark):
    def folded(*actions):
        rows = [(i, "k", a, v) for i, (a, v) in enumerate(actions)]
        df = spark.createDataFrame(rows, "seq long, k string, action string, v string")
        return fold_changes(df, ["k"], ["seq"], merged=["v"]).first()

    assert folded(("upsert", "a"), ("delete", None)).live is False
    back = folded(("upsert", "a"), ("delete", None), ("upsert", None))
    assert (back.wiped, back.live, back.v) == (True, True, None)
    assert folded(("delete", None), ("delete", None)).live is False
    assert folded(("upsert", None), ("upsert", None)).v is None
    assert folded(("upsert", "a"), ("upsert", None)).v == "a"


@pytest.mark.parametrize("small", [True, False])
def test_account_merge_keeps_type_and_owner(spark, small):
    target = spark.createDataFrame([(1, 10, "LOAN", None, "ACTIVE", T0, T0)], ACCOUNTS.schema)
    changes = spark.createDataFrame(
        [(1, 1, 99, "SAVINGS", 5, "FROZEN"), (2, 2, 98, "SAVINGS", 6, "ACTIVE"), (3, 1, 97, "CHECKING", 7, "CLOSED")],
        "seq long, account_id long, customer_id long, account_type string, balance int, status string",
    ).withColumns({"source_updated_at": stamp(), "action": F.lit("upsert"), "balance": F.col("balance").cast("decimal(18,2)")})
    rule = account_rule(stamp())
    rows = {r.account_id: r for r in apply_merge(target, rule.fold(changes, ["seq"]), rule, small=small).collect()}
    assert (rows[1].customer_id, rows[1].account_type, rows[1].status, int(rows[1].balance)) == (10, "LOAN", "CLOSED", 7)
    assert (rows[2].customer_id, rows[2].account_type) == (98, "SAVINGS")


def test_unique_merge_with_deletes_matches_broadcast_path(spark):
    rng = random.Random(5)
    columns = "customer_id long, first_name string, last_name string, email string, phone string, street string, city string, state string, zip string, updated_at timestamp_ntz, source_updated_at timestamp_ntz"
    target = spark.createDataFrame([(i, *["old"] * 8, T0, T0) for i in range(20)], columns)
    changes = spark.createDataFrame(
        [(s, rng.randrange(30), *[rng.choice(["", f"v{s}"]) for _ in range(8)], T0, rng.choice(["upsert", "upsert", "delete"])) for s in range(80)],
        "seq long, customer_id long, first_name string, last_name string, email string, phone string, street string, city string, state string, zip string, source_updated_at timestamp_ntz, action string",
    )
    rule = customer_rule(stamp())
    folded = rule.fold(changes, ["seq"])
    one = sorted(map(tuple, apply_merge(target, folded, rule, small=True).collect()))
    two = sorted(map(tuple, apply_merge(target, folded, rule, small=False).collect()))
    assert one == two and any("" in r for r in one)


def test_delete_and_update(spark):
    t = spark.createDataFrame([("a", 1, T0), ("a", 2, T0), ("b", 3, T0)], "k string, v int, at timestamp_ntz")
    gone = spark.createDataFrame([("a",), ("a",)], "k string")
    assert [r.v for r in delete_keys(t, gone, ["k"]).collect()] == [3]
    new = spark.createDataFrame([("a", None)], "k string, v int")
    assert sorted(map(str, (r.v for r in update_columns(t, new, ["k"], ["v"]).collect()))) == ["3", "None", "None"]

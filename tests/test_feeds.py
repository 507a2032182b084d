"""The topic of four tables at work: what its queries leave on disk, and in which order they take its parts."""

import datetime
import json
from collections import Counter

import pytest

from millrace.plans import streams
from millrace.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables of the given form, made here."""
    top = tmp_path_factory.mktemp("tables")
    kinds = ("view", "signup", "purchase", "error", "click")
    first = datetime.datetime(2024, 1, 1)
    events = [
        (n, first + datetime.timedelta(seconds=7 * n, microseconds=n), n * 13 % 20, kinds[n * 7 % 5], float(n % 90) + 0.25, json.dumps({"k": n * 11 % 100}))
        for n in range(600)
    ]
    tables = {
        "events": spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "customer": spark.createDataFrame(
            [(n, f"Customer#{n}", n % 3, n * 1.5, ("BUILDING", "MACHINERY")[n % 2]) for n in range(60)],
            "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        ),
        "nation": spark.createDataFrame([(n, f"NATION{n}", 0) for n in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name, rows in tables.items():
        rows.toPandas().astype({"ts": "datetime64[us]"} if name == "events" else {}).to_parquet(top / f"{name}.parquet")
    return top


def run(spark, folder, tmp_path, monkeypatch, name):
    """The query over parts of 150 events; its scratch folder, checked against its SQL."""
    monkeypatch.setattr(streams, "_EVENTS_PER_PART", 150)
    monkeypatch.setattr(streams, "_ROWS_PER_FILE", 9)
    monkeypatch.setattr(streams, "scratch_path", lambda _, what: str(tmp_path / what))
    assert compare(QUERIES[name](spark, str(folder)), connect(str(folder)), ORACLES[name]) is None
    return tmp_path / name.replace("_", "-")


def held_little(base, tables):
    """The messages lie in the topic alone, packed, a batch a part, and of a bucket there are two copies at most."""
    assert [f.name for f in base.iterdir() if "message" in f.name] == []
    files = list((base / "topic").rglob("part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    assert len(list((base / "checkpoint" / "commits").glob("[0-9]*"))) == 4
    for table in tables:
        copies = Counter(f.name for f in (base / table / "data").glob("ver=*/bucket=*"))
        assert copies and max(copies.values()) == 2


def test_customers_of_a_topic_in_bounded_parts(spark, folder, tmp_path, monkeypatch):
    held_little(run(spark, folder, tmp_path, monkeypatch, "stream_customers"), ["customers"])


def test_four_tables_of_a_topic_in_bounded_parts(spark, folder, tmp_path, monkeypatch):
    held_little(run(spark, folder, tmp_path, monkeypatch, "stream_all"), ["accounts", "customers", "members"])


def test_accounts_of_a_topic_in_bounded_parts(spark, folder, tmp_path, monkeypatch):
    held_little(run(spark, folder, tmp_path, monkeypatch, "stream_accounts"), ["accounts"])

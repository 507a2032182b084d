"""Topics kept as folders, polled tables, and reconciliation with timers."""

import gzip
import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.session import own_session
from millrace.sources import envelope
from millrace.sources.feeds import FeedConfig, change_stream, read_topic, table_stream, write_topic
from millrace.sources.polled import PolledReader, polled_stream
from millrace.streaming.arrivals import _LANDED, _TOLD, _WRITTEN, TO_THE_END, arrivals, one_per_id, settled
from millrace.streaming.merges import append_stream, finish, start

T0 = datetime(2024, 1, 1)


def collected(into):
    return lambda batch, number: into.append((number, [tuple(r) for r in batch.collect()]))


def test_topic_folder_gives_positions_and_shows_bad_lines(spark, tmp_path):
    messages = [(i, T0 + timedelta(seconds=i), f"k{i % 5}", None if i % 7 == 0 else json.dumps({"i": i, "q": '"'})) for i in range(40)]
    frame = spark.createDataFrame(messages, "offset long, timestamp timestamp, key string, value string")
    path = str(tmp_path / "topic")
    write_topic(frame.where("offset < 25"), path, partitions=3)
    got = []
    feed = lambda: change_stream(spark, FeedConfig(topic_path=path))
    finish(start(feed(), collected(got), str(tmp_path / "cp"), interval=None))
    write_topic(frame.where("offset >= 25"), path, partitions=3)
    (tmp_path / "topic" / "partition=1" / "bad.txt").write_text("{broken\n")
    finish(start(feed(), collected(got), str(tmp_path / "cp"), interval=None))
    rows = [r for _, batch in got for r in batch]
    assert sorted((r[3], r[1], r[0]) for r in rows if r[3] is not None) == sorted((i, k, v) for i, _, k, v in messages)
    assert [r[:4] for r in rows if r[3] is None] == [("{broken", None, 1, None)]
    assert len({(r[1], r[2]) for r in rows if r[1]}) == 5  # a key keeps its partition
    table = read_topic(spark, path)
    assert table.count() == 41
    assert [r.reason for r in envelope.rejects(table.where("offset is null"), "flat").collect()] == ["corrupt"]


def polled(spark, path, schema, got, checkpoint, **kw):
    stream = polled_stream(spark, path, schema, "at", "id", **kw)
    finish(start(stream, collected(got), checkpoint, interval=None))


def test_polled_table_restarts_without_loss_or_repeat(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, at timestamp_ntz, v string"

    def add(ids):
        rows = [(i, T0 + timedelta(seconds=i // 4), f"v{i}") for i in ids]  # four rows share a time
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(path)

    frame = spark.createDataFrame([], schema)
    got = []
    add(range(0, 10))
    polled(spark, path, frame.schema, got, str(tmp_path / "cp"))
    polled(spark, path, frame.schema, got, str(tmp_path / "cp"))  # nothing new
    add(range(10, 30))  # 10 and 11 share their time with 8 and 9
    polled(spark, path, frame.schema, got, str(tmp_path / "cp"))
    spark.createDataFrame([(99, None, "no time"), (None, T0 + timedelta(days=1), "no id")], schema).write.mode("append").parquet(path)
    add([40])
    polled(spark, path, frame.schema, got, str(tmp_path / "cp"))
    rows = [r for _, batch in got for r in batch]
    assert sorted(r[0] for r in rows) == [*range(30), 40]
    assert {r[0]: (r[1], r[2]) for r in rows}[5] == (T0 + timedelta(seconds=1), "v5")
    late = []
    polled(spark, path, frame.schema, late, str(tmp_path / "cp2"), start=(T0 + timedelta(seconds=2), 9))
    assert sorted(r[0] for _, batch in late for r in batch) == [*range(10, 30), 40]


def test_a_failed_batch_reads_the_same_rows_again(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, at timestamp_ntz"
    add = lambda a, b: spark.createDataFrame([(i, T0 + timedelta(seconds=i)) for i in range(a, b)], schema).coalesce(1).write.mode("append").parquet(path)
    add(0, 5)
    frame = spark.createDataFrame([], schema)

    def fail(batch, number):
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        finish(start(polled_stream(spark, path, frame.schema, "at", "id"), fail, str(tmp_path / "cp"), interval=None))
    add(5, 9)  # after the failed batch was planned
    got = []
    for _ in range(2):  # a run to the end is one poll
        polled(spark, path, frame.schema, got, str(tmp_path / "cp"))
    assert [sorted(r[0] for r in batch) for _, batch in got if batch] == [[*range(5)], [*range(5, 9)]]


def test_polls_are_bounded_by_file_parts_and_prune_files(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, at timestamp_ntz"
    frame = spark.createDataFrame([], schema)
    for a in range(0, 50, 10):
        spark.createDataFrame([(i, T0 + timedelta(seconds=i)) for i in range(a, a + 10)], schema).coalesce(1).write.mode("append").parquet(path)
    reader = PolledReader(frame.schema, {"path": path, "ts": "at", "tie": "id", "limit": "15"})
    ends, at = [], reader.initialOffset()
    while True:
        end = reader.latestOffset()
        if end == at:
            break
        ends.append((end["id"], len(reader.partitions(at, end))))
        at = end
    assert ends == [(19, 2), (39, 3), (49, 2)]  # the file of the cursor itself is looked at again
    assert PolledReader(frame.schema, {"path": str(tmp_path / "none"), "ts": "at", "tie": "id"}).latestOffset()["id"] == 0


def test_one_per_id():
    rows = np.array([[1, 7, 1, 50, 0, _WRITTEN], [2, 0, 0, 0, 9, _LANDED], [1, 0, 0, 0, 8, _LANDED], [1, 0, 0, 0, 6, _LANDED], [1, 7, 1, 40, 0, _WRITTEN | _TOLD]], np.int64)
    assert one_per_id(rows).tolist() == [[1, 7, 1, 40, 6, 7], [2, 0, 0, 0, 9, _LANDED]]
    assert one_per_id(rows[:0]).shape == (0, 6)


def test_late_and_skewed_rows_end_as_arrived(spark, tmp_path):
    session = own_session(spark, **TO_THE_END)
    now = datetime.now().replace(microsecond=0)
    ago = lambda **kw: now - timedelta(**kw)
    written = "txn_id long, account_id long, source_write_ts timestamp_ntz"
    landed = "txn_id long, ingest_ts timestamp_ntz"
    out = str(tmp_path / "out")

    def run(sources, landings):
        session.createDataFrame(sources, written).write.mode("append").parquet(str(tmp_path / "s"))
        session.createDataFrame(landings, landed).write.mode("append").parquet(str(tmp_path / "l"))
        s = table_stream(session, str(tmp_path / "s"), session.createDataFrame([], written).schema)
        l = table_stream(session, str(tmp_path / "l"), session.createDataFrame([], landed).schema)
        finish(append_stream(arrivals(s, l, 60_000, 4), out, str(tmp_path / "cp"), interval=None))
        reports = session.read.parquet(out)
        return reports, {r.txn_id: (r.arrived, r.sla_ms, r.account_id) for r in settled(reports).collect()}

    first = [(1, 10, ago(days=3)), (2, None, ago(hours=1)), (3, 30, ago(hours=1)), (4, 40, now + timedelta(days=1)), (None, 5, now), (5, 50, ago(hours=2))]
    _, state = run(first, [(3, ago(hours=1) - timedelta(seconds=5)), (9, now), (None, now)])
    # 3 is stamped before its write; 4 is not due yet; 9 has no source row.
    assert state == {1: (False, None, 10), 2: (False, None, None), 3: (True, -5000, 30), 5: (False, None, 50)}
    _, state = run([(9, 90, ago(seconds=1)), (5, 50, ago(hours=2))], [(1, now), (5, ago(hours=1)), (5, now)])
    assert state[1] == (True, 3 * 86_400_000, 10) and state[9][0] and state[5] == (True, 3_600_000, 50) and 4 not in state
    reports, state = run([(1, 10, ago(days=3))], [(4, now)])
    # 4 has landed before it was due; the repeated 1 does not undo its arrival.
    assert state[1][0] and state[4][0] and state[2] == (False, None, None)
    assert reports.where("txn_id = 2").count() == 1


def test_own_session_keeps_its_settings_to_itself(spark):
    spark.conf.set("millrace.test", "kept")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session = own_session(spark, **{"spark.sql.shuffle.partitions": "3"}, **TO_THE_END)
    assert session.conf.get("spark.sql.shuffle.partitions") == "3" and session.conf.get("millrace.test") == "kept"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") != "false"
    spark.conf.unset("millrace.test")


def test_compressed_topic_reads_as_the_plain_one_in_bounded_files(spark, tmp_path):
    messages = [(i, T0 + timedelta(seconds=i), f"k{i % 5}", None if i % 7 == 0 else json.dumps({"i": i, "q": "x" * 200})) for i in range(400)]
    frame = spark.createDataFrame(messages, "offset long, timestamp timestamp, key string, value string")
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    write_topic(frame, plain, partitions=3)
    write_topic(frame, packed, partitions=3, compression="gzip", rows_per_file=20)
    files = [f for f in (tmp_path / "packed").rglob("part-*") if f.is_file()]
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    assert max(len(gzip.decompress(f.read_bytes()).splitlines()) for f in files) <= 20
    size = lambda top: sum(f.stat().st_size for f in (tmp_path / top).rglob("part-*"))
    assert size("packed") * 2 < size("plain")
    want = sorted(map(str, read_topic(spark, plain).collect()))
    assert sorted(map(str, read_topic(spark, packed).collect())) == want
    got = []
    finish(start(change_stream(spark, FeedConfig(topic_path=packed)), collected(got), str(tmp_path / "cp"), interval=None))
    assert sum(len(b) for _, b in got) == 400


def test_a_line_is_parsed_once_where_rows_without_a_value_go(spark, tmp_path):
    frame = spark.createDataFrame([(1, T0, "k", "{}"), (2, T0, "k", None)], "offset long, timestamp timestamp, key string, value string")
    write_topic(frame, str(tmp_path / "topic"))
    found = envelope.drop_tombstones(read_topic(spark, str(tmp_path / "topic")))
    assert [(r.offset, r.value) for r in found.collect()] == [(1, "{}")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1

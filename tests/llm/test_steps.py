"""The named steps stand behind the results, and workers give back what they no longer use."""

import random

import numpy as np
import pytest

from millrace.llm import batches, graph, licenses, pitman_yor, simhash


def test_the_ranking_by_compression_names_licenses(monkeypatch):
    text = "Released under the MIT License.\n\nother words\n\nThis work is licensed under the GNU General Public License, version 3."
    tool = licenses.Scanner(licenses.TEMPLATES)
    names = [tool.templates[n][0] for _, _, n, *_ in tool.confirmed(text)]
    assert names == ["MIT", "GPL-3.0"]
    monkeypatch.setattr(tool, "ranked", lambda data: [])
    assert tool.confirmed(text) == []  # no wording is named without its rank


def test_a_low_rank_loses_no_wording(monkeypatch):
    tool = licenses.Scanner(licenses.TEMPLATES)
    plain = tool.ranked
    monkeypatch.setattr(tool, "ranked", lambda data: plain(data)[::-1])
    text = "Released under the ISC License. Licensed under the BSD 3-Clause License."
    assert [tool.templates[n][0] for _, _, n, *_ in tool.confirmed(text)] == ["ISC", "BSD-3-Clause"]


def test_near_copies_come_through_fingerprints(spark):
    words = [f"w{n * 7919 % 10007}" for n in range(400)]
    edited = [*words[:200], "changed", *words[201:]]
    other = [f"v{n * 7919 % 10007}" for n in range(400)]
    df = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate((words, edited, other))], "doc_id long, text string")
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    one, two = (simhash.shingle_bits(t, simhash.SHINGLE, simhash.SEED) for t in texts[:2])
    assert bin((one ^ two) % (1 << 64)).count("1") <= 4
    assert not set(simhash.band_keys(texts[0], 5, 1, 2000)) & set(simhash.band_keys(texts[1], 5, 1, 2000))
    found = simhash.near_copies(df, bands=1, rows=2000, first=1).select("doc_id", "kept_id").collect()
    assert sorted(map(tuple, found)) == [(0, 0), (1, 0)]


def test_texts_of_no_group_are_not_one_group(spark):
    members = spark.createDataFrame([(b"one", 1), (b"two", 1)], "h binary, key long").selectExpr("h", "named_struct('doc_id', 1L, 'h', h) first", "key")
    groups = spark.createDataFrame([(b"other", b"other")], "node binary, component binary")
    assert {(bytes(r.sig), r.part) for r in simhash.key_lists(members, groups).collect()} == {(b"one", -1), (b"two", -1)}


def test_a_worker_keeps_one_table_and_only_while_it_is_used():
    made = []
    make = lambda name: lambda: made.append(name) or name
    assert [batches.kept(n, make(n)) for n in ("a", "a")] == ["a", "a"] and made == ["a"]
    batches.release()
    assert batches.kept("a", make("a")) == "a" and made == ["a"]  # used by the task before
    assert batches.kept("b", make("b")) == "b" and list(batches._kept) == ["b"]
    batches.release()
    batches.release()  # a task of another operator
    assert not batches._kept


def test_places_are_looked_up_once_for_each_distinct_key(monkeypatch):
    rng = np.random.default_rng(1)
    table = np.unique(rng.integers(0, 1 << 48, 5000))
    keys = rng.choice(table[:300], 20_000)
    expected, asked, plain = np.searchsorted(table, keys), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v: asked.append(v) or plain(a, v))
    assert (pitman_yor.places(table, keys) == expected).all()
    assert len(asked[0]) <= 300 and (np.diff(asked[0]) > 0).all()


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_equal_the_model(spark, kind):
    rng = random.Random(2)
    ends = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    pairs = [*ends, *ends[:50], (7, 7), (401, 401), (None, 2), (402, None), *((500, 501 + n) for n in range(40)), *((700, 699 - n) for n in range(40))]
    group: dict[int, int] = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            old, new = sorted((group.setdefault(a, a), group.setdefault(b, b)), reverse=True)
            group |= {n: new for n, g in group.items() if g == old}
    as_kind = lambda n: n if n is None or kind == "long" else n.to_bytes(2, "big")
    edges = spark.createDataFrame([tuple(map(as_kind, p)) for p in pairs], f"a {kind}, b {kind}")
    found = sorted((r.node, r.component) for r in graph.components(edges).collect())
    assert found == sorted((as_kind(n), as_kind(g)) for n, g in group.items())
    assert graph.components(edges.where("a is null")).count() == 0


def stages_run(spark, work):
    """How many stages ran while ``work`` did."""
    context, name = spark.sparkContext, f"stages {random.random()}"
    context.setLocalProperty("spark.jobGroup.id", name)
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return sum(tracker.getStageInfo(s).numCompletedTasks > 0 for s in stages)


def test_a_round_of_components_runs_three_stages(spark, monkeypatch):
    edges = spark.createDataFrame([(n, n + 1) for n in range(200)], "a long, b long")
    cuts, plain = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: cuts.append(df) or plain(df))
    run = stages_run(spark, lambda: graph.components(edges).collect())
    rounds = len(cuts) - 1
    assert rounds > 2 and run <= 3 * rounds + 6


def test_rows_of_lists_are_shuffled_once(spark):
    members = spark.range(100).selectExpr("cast(cast(id as string) as binary) h", "id % 20 key")
    members = members.selectExpr("h", "named_struct('doc_id', 1L, 'h', h) first", "key").repartition("h")
    assert stages_run(spark, lambda: simhash.key_lists(members, None)) <= 5

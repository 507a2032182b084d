"""Interaction of filters: what every order of them removes, from paths through the lattice of filter sets.

A document is the set of filters that it fails. All that an order does shows in the
lattice of filter sets: the state is the set applied so far, an edge applies one
more filter. Documents are tallied by (part, set of failed filters), and each
edge's removals follow from those tallies. Counting paths forward from the empty
set and backward from the full one gives the number of orders through every edge,
which weights its removals for the Shapley value; the steps of each order are
read from the same edges.

Null texts count as empty, a null part as the empty string, a document without
labels as neither good nor toxic; of several labels of a document any that says
so counts. A row without an id is a copy of nothing and nothing is a copy of it;
rows that repeat an id are no copies of each other. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches
from millrace.session import cut_lineage

MARKS = bytes(sorted(b"#$%&*|"))
CAPITALS = bytes(range(65, 91))
FILTERS = "ABCDE"
#: Orders are listed one by one, so their number is bounded here.
MOST_FILTERS = 6


def failed(text: str) -> int:
    """The failed text filters as bits: few words, repeated words, capitals, marks."""
    raw = text.encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    marked = len(raw.translate(None, MARKS)) < len(raw)
    tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), marked)
    return sum(bit << n for n, bit in enumerate(tests))


def text_flags(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` (the lang), ``h`` (sixteen bytes that stand for the text) and ``mask`` of the text filters."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        texts = [t.as_py() or "" for t in batch.column(2)]
        return {
            "doc_id": batch.column(0), "part": [p.as_py() or "" for p in batch.column(1)],
            "h": [hashlib.sha256(t.encode()).digest()[:16] for t in texts], "mask": [failed(t) for t in texts],
        }

    return map_batches(docs.select("doc_id", F.col("lang").cast("string"), "text"), work, f"doc_id {kind}, part string, h binary, mask int")


def with_copies(flags: DataFrame, bit: int) -> DataFrame:
    """``flags`` with ``bit`` set in the mask of rows whose text also has a smaller id.

    Rows are looked up by text and id together, so a text of very many copies is
    spread like any other.
    """
    firsts = flags.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    # One row per distinct text on the right, at its own id, so no key of this join is frequent on both sides.
    found = flags.join(firsts.withColumn("is_first", F.lit(True)), ["h", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return found.withColumn("mask", F.col("mask").bitwiseOR(F.when(copy, bit).otherwise(0))).drop("is_first")


def tallies(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents by the filters that they fail."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    added = lambda c: F.coalesce(F.sum(c), F.lit(0))
    joined = flags.join(marked, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), added("quality").alias("good"), added("toxic").alias("toxic"))


def lattice(filters: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders): every edge with the number of orders that pass it.

    Forward counts reach a state from the empty set, backward counts leave it for the full one.
    """
    full = (1 << filters) - 1
    ways, leaving = [0] * (full + 1), [0] * (full + 1)
    ways[0] = leaving[full] = 1
    for state in range(full + 1):
        for f in range(filters):
            if not state >> f & 1:
                ways[state | 1 << f] += ways[state]
    for state in range(full, -1, -1):
        for f in range(filters):
            if not state >> f & 1:
                leaving[state] += leaving[state | 1 << f]
    return [(s, f, ways[s] * leaving[s | 1 << f]) for s in range(full + 1) for f in range(filters) if not s >> f & 1]


def audit_edges(tallied: DataFrame, filters: int) -> DataFrame:
    """One row per part and edge: what is kept and removed there, with the Shapley sum of its filter.

    ``tallied`` has a row per part and mask, so the work per part is 2 ** filters tallies
    times as many edges, whatever the number of documents.
    """
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in lattice(filters)])
    spread = tallied.select("*", F.explode(edges).alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    bit = F.expr("shiftleft(1, filter)")
    before = F.col("mask").bitwiseAND(F.col("state")) != 0
    fails = F.col("mask").bitwiseAND(bit) != 0
    removed = fails & ~before

    def added(which: Column, value: str = "n") -> Column:
        return F.sum(F.when(which, F.col(value)).otherwise(0))

    found = spread.groupBy("part", "state", "filter", "orders").agg(
        added(~before & ~fails).alias("kept"), added(removed).alias("removed"), added(fails & before).alias("redundant"),
        added(F.col("mask") == bit).alias("unique_fails"), added(removed, "good").alias("good_lost"), added(removed, "toxic").alias("toxic_lost"),
    )
    sums = found.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return found.join(sums, ["part", "filter"])


def order_steps(edges: DataFrame, names: str) -> DataFrame:
    """All orders of the filters, step by step, each step read from its edge."""
    if len(names) > MOST_FILTERS:
        raise ValueError(f"orders are listed for up to {MOST_FILTERS} filters")
    spark = edges.sparkSession
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[g] for g in order), step, state, f))
            state |= 1 << f
    steps = spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")
    # One row per step of each order of at most MOST_FILTERS filters.
    return edges.join(F.broadcast(steps), ["state", "filter"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts of that step, for all orders of the five filters A to E."""
    flags = cut_lineage(text_flags(docs))
    tallied = cut_lineage(tallies(with_copies(flags, 1 << FILTERS.index("E")), labels))
    found = order_steps(audit_edges(tallied, len(FILTERS)), FILTERS)
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

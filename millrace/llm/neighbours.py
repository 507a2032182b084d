"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into partitions of equal
size, by halving it again and again at the median of its slowest mode. A softmax
classifier learns to tell the partitions of a vector and its neighbours. Every
row is indexed under the most probable partition; a query goes to as many as
held-out rows of the sample need for their neighbours, and is ranked there by
exact inner products in double precision. Inner products of vectors of unequal length are
turned into angles by one more component before the graph is built.

Vectors that are null, zero, or hold nulls or non-finite numbers take no part,
nor do those without an id or of another length than most. Copies of a vector
have one partition and keep their ids apart. Partitions are ranked in blocks of
bounded size, so one that holds many copies is spread over tasks. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches

#: Bounds of the sample that is fitted, and of its graph.
SAMPLE = 8192
GRAPH_NEIGHBOURS = 40
EPOCHS = 15
SEED = 5
#: Rows of a partition for each block of the ranking.
BLOCK = 2048
#: Rows to a partition, on average, and the most partitions that the sample can teach.
PARTITION_ROWS = 160
MOST_PARTITIONS = 128
#: Share of the neighbours of held-out sample rows that the visited partitions must hold.
WANTED = 0.95


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, with double components."""
    whole = df.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = whole.select("vec_id", v.alias("v")).where(finite & F.exists("v", lambda x: x != 0))
    sizes = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return whole.where(F.size("v") == (sizes["n"] if sizes else 0))


def halves(near: np.ndarray, members: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two equal parts of ``members`` with few graph edges between them."""
    place = np.full(len(near), -1)
    place[members] = np.arange(len(members))
    to = place[near[members]]
    inside = to >= 0
    source = np.repeat(np.arange(len(members)), near.shape[1])[inside.ravel()]
    target = to.ravel()[inside.ravel()]
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    degree = np.bincount(source, minlength=len(members)) + 1.0
    x = rng.standard_normal(len(members))
    for _ in range(60):
        x = x - (x * degree).sum() / degree.sum()
        x = 0.5 * x + 0.5 * (np.bincount(source, x[target], len(members)) + x) / degree
        x /= np.abs(x).max() + 1e-300
    order = np.argsort(x, kind="stable")
    return members[order[: len(order) // 2]], members[order[len(order) // 2 :]]


@dataclass
class Router:
    """A softmax classifier: the probabilities of the partitions for (widened) vectors."""

    scale: float
    weights: np.ndarray
    bias: np.ndarray
    visits: int = 1

    @property
    def parts(self) -> int:
        return len(self.bias)

    def widened(self, v: np.ndarray) -> np.ndarray:
        v = v / self.scale
        rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(1, keepdims=True)))
        return np.concatenate([v, rest], 1)

    def directions(self, v: np.ndarray) -> np.ndarray:
        v = v / np.sqrt((v * v).sum(1, keepdims=True))
        return np.concatenate([v, np.zeros((len(v), 1))], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fit(sample: np.ndarray, scale: float, parts: int) -> Router:
    rng = np.random.default_rng(SEED)
    router = Router(scale, np.zeros((sample.shape[1] + 1, parts)), np.zeros(parts), parts)
    x = router.widened(sample)
    if parts == 1:
        return router
    held = len(x) // 8  # rows that only set the number of visits
    near = _nearest(x[held:], x[held:], GRAPH_NEIGHBOURS, True)
    groups = [np.arange(len(near))]
    while len(groups) < parts:
        groups = [half for g in groups for half in halves(near, g, rng)]
    label = np.empty(len(near), np.int64)
    for n, g in enumerate(groups):
        label[g] = n
    # A vector's target is half its own partition, half those of its neighbours.
    target = np.zeros((len(near), parts))
    np.add.at(target, (np.arange(len(near))[:, None], label[near]), 0.5 / near.shape[1])
    target[np.arange(len(near)), label] += 0.5
    _train(router, x[held:], target, rng)
    place = router.scores(x).argmax(1)
    best = np.argsort(-router.scores(router.directions(sample[:held])), 1, kind="stable")
    rank = np.empty_like(best)
    np.put_along_axis(rank, best, np.arange(parts)[None, :], 1)
    truth = _nearest(router.directions(sample[:held]), x[held:], 20, False) + held
    needed = np.sort(np.take_along_axis(rank, place[truth], 1).ravel())
    router.visits = min(parts, int(needed[int(np.ceil(WANTED * len(needed))) - 1]) + 1)
    return router


def _nearest(queries: np.ndarray, rows: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Places of the ``k`` largest inner products of each query; ``same`` leaves its own row out."""
    k = min(k, len(rows) - same)
    found = np.empty((len(queries), k), np.int64)
    for at in range(0, len(queries), 512):
        like = queries[at : at + 512] @ rows.T
        if same:
            like[np.arange(len(like)), at + np.arange(len(like))] = -np.inf
        found[at : at + 512] = np.argpartition(-like, k - 1, 1)[:, :k]
    return found


def _train(router: Router, x: np.ndarray, target: np.ndarray, rng) -> None:
    """Adam on the cross entropy."""
    weights = [router.weights, router.bias]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 512):
            rows = order[at : at + 512]
            out = router.scores(x[rows])
            out = np.exp(out - out.max(1, keepdims=True))
            out = (out / out.sum(1, keepdims=True) - target[rows]) / len(rows)
            step += 1
            for w, g, m, s in zip(weights, (x[rows].T @ out, out.sum(0)), mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def learn(rows: DataFrame) -> Router | None:
    """Fit on at most ``SAMPLE`` distinct vectors, chosen by their hash."""
    stats = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("scale")).first()
    if not stats["n"]:
        return None
    at = F.xxhash64("v").bitwiseAND((1 << 62) - 1)
    share = min(1.0, 2 * SAMPLE / stats["n"])
    sample = rows.select(at.alias("at"), "v").where(F.col("at") <= int(share * (1 << 62))).groupBy("at").agg(F.any_value("v").alias("v"))
    found = sample.orderBy("at").limit(SAMPLE).collect()
    parts = 1
    while parts < MOST_PARTITIONS and parts * PARTITION_ROWS < stats["n"] and parts * 64 <= len(found):
        parts *= 2
    return fit(np.array([r["v"] for r in found]), stats["scale"], parts)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def ranked(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """(query, row id, score) of the ``k`` best rows for each query; ties go to the smaller id.

    A matrix product picks what may belong to them; those are multiplied again
    one by one, in one order of summation, so that copies score alike.
    """
    rough = queries @ rows.T
    rough[query_ids[:, None] == row_ids[None, :]] = -np.inf
    least = min(k, rows.shape[0])
    slack = 1e-9 * (1 + np.abs(rows).max() * np.abs(queries).max() * rows.shape[1])
    floor = -np.partition(-rough, least - 1, 1)[:, least - 1] - slack
    for n in range(len(queries)):
        near = np.flatnonzero((rough[n] >= floor[n]) & (rough[n] > -np.inf))
        exact = (rows[near] * queries[n]).sum(1)
        order = np.lexsort((row_ids[near], -exact))[:k]
        for at in order.tolist():
            yield n, int(row_ids[near[at]]), float(exact[at])


def search(df: DataFrame, queries, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for the rows that the condition ``queries`` takes."""
    rows = usable(df)
    router = learn(rows)
    result = "query_id long, rank int, vec_id long, score double"
    if router is None:
        return df.sparkSession.createDataFrame([], result)
    visits = router.visits

    def index(batch: pa.RecordBatch) -> dict:
        v = _matrix(batch.column(1))
        return {"part": router.scores(router.widened(v)).argmax(1), "vec_id": batch.column(0), "v": batch.column(1)}

    def route(batch: pa.RecordBatch) -> dict:
        v = _matrix(batch.column(1))
        best = np.argsort(-router.scores(router.directions(v)), 1, kind="stable")[:, :visits]
        taken = pa.array(np.repeat(np.arange(len(v)), visits))
        return {"part": best.ravel(), "vec_id": batch.column(0).take(taken), "v": batch.column(1).take(taken)}

    schema = "part long, vec_id long, v array<double>"
    indexed = map_batches(rows, index, schema)
    routed = map_batches(rows.where(queries), route, schema)
    # At most MOST_PARTITIONS rows.
    sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    count = lambda found: F.element_at(F.create_map(*[F.lit(x) for p in range(router.parts) for x in (p, -(-found.get(p, 1) // BLOCK))]), F.col("part"))
    own = lambda found: F.pmod(F.xxhash64("vec_id"), count(found)).cast("int")
    each = lambda found: F.explode(F.sequence(F.lit(0), (count(found) - 1).cast("int")))
    left = routed.select("part", own(asked).alias("i"), each(sizes).alias("j"), "vec_id", "v")
    right = indexed.select("part", each(asked).alias("i"), own(sizes).alias("j"), "vec_id", "v")

    def best(queries_: pa.Table, rows_: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries_.num_rows and rows_.num_rows:
            v, ids = _matrix(rows_.column("v").combine_chunks()), rows_.column("vec_id").to_numpy()
            q, q_ids = _matrix(queries_.column("v").combine_chunks()), queries_.column("vec_id").to_numpy()
            for at in range(0, len(q), 256):
                out += [(int(q_ids[at + n]), i, s) for n, i, s in ranked(q[at : at + 256], q_ids[at : at + 256], v, ids, k)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ["part", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

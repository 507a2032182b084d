"""Document fingerprints by SimHash, and a search of all fingerprints within a Hamming radius.

The terms of a text are its words and word pairs. A term weighs 1 + ln(count),
pairs twice that, and votes with its weight on each of 128 signed bits of its
hash. The search keeps permuted block tables: the fingerprint is cut into
radius + 2 blocks, and each table leads with two of them; fingerprints within
the radius agree in at least two blocks, so they meet in some table.

Null and empty texts have no terms and fingerprint zero. Equal texts have equal
fingerprints, so repeated rows do too. Other columns are ignored and an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.batches import bounded, map_batches
from millrace.llm.phrases import BASE, mixed
from millrace.session import scratch_path

BITS = 128
PAIR_WEIGHT = 2.0


def votes(text: str | None) -> tuple[int, int]:
    """The two halves of a fingerprint as signed longs."""
    words = text.encode().split() if text else []
    if not words:
        return 0, 0
    digest = xxhash.xxh64_intdigest
    single = np.array([digest(w) for w in words], np.uint64)
    pairs = mixed(single[:-1] * np.uint64(BASE) + single[1:])
    total = np.zeros(BITS, np.float64)
    for terms, weight in ((single, 1.0), (pairs, PAIR_WEIGHT)):
        found, counts = np.unique(terms, return_counts=True)
        weights = (weight * (1 + np.log(counts))).astype(np.float32)
        for at in range(0, len(found), 4096):
            block = found[at : at + 4096]
            both = np.stack([mixed(block), mixed(~block)], 1).astype("<u8")
            bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            part = weights[at : at + 4096]
            total += 2 * (part @ bits) - part.sum()
    halves = np.packbits(total > 0, bitorder="little").view("<i8")
    return int(halves[0]), int(halves[1])


def likeness(a: tuple[int, int], b: tuple[int, int]) -> float:
    apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    return 1 - apart / BITS


def spelled(fp: tuple[int, int]) -> str:
    return "".join(f"{half & (1 << 64) - 1:016x}" for half in fp)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``low``, ``high``: the halves of each row's fingerprint."""

    def work(batch: pa.RecordBatch) -> dict:
        found = [votes(t.as_py()) for t in batch.column(1)]
        return {id_col: batch.column(0), "low": [f[0] for f in found], "high": [f[1] for f in found]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), work, f"`{id_col}` {kind}, low long, high long")


def within(fps: DataFrame, radius: int = 6) -> DataFrame:
    """(low, high, low_2, high_2, distance): all pairs of distinct fingerprints within ``radius`` bits.

    Equal fingerprints are one here; join back to the rows for their members.
    """
    blocks = radius + 2
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def bits(start: int, stop: int):
        parts = []
        for name, base in (("low", 0), ("high", 64)):
            a, b = max(start, base), min(stop, base + 64)
            if a < b:
                mask = (1 << (b - a)) - 1
                part = F.shiftrightunsigned(name, a - base).bitwiseAND(mask if mask < 1 << 63 else -1)
                parts.append(F.shiftleft(part, a - start) if a > start else part)
        return parts[0] if len(parts) == 1 else parts[0].bitwiseOR(parts[1])

    lead = [F.struct(F.lit(n).alias("table"), bits(cuts[p], cuts[p + 1]).alias("p"), bits(cuts[q], cuts[q + 1]).alias("q")) for n, (p, q) in enumerate(combinations(range(blocks), 2))]
    rows = fps.select("low", "high").distinct().select("low", "high", F.explode(F.array(*lead)).alias("t")).select("low", "high", "t.*")
    other = rows.select("table", "p", "q", F.col("low").alias("low_2"), F.col("high").alias("high_2"))
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("low_2"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high_2")))
    before = (F.col("low") < F.col("low_2")) | ((F.col("low") == F.col("low_2")) & (F.col("high") < F.col("high_2")))
    near = rows.join(other, ["table", "p", "q"]).where(before & (apart <= radius))
    return near.select("low", "high", "low_2", "high_2", apart.alias("distance")).distinct()


def _edited(doc: tuple, following: tuple) -> dict:
    """``doc`` and ``following`` are (id, text, fingerprint)."""
    text, other = doc[1] or "", following[1] or ""
    third = len(text) // 3
    edited = text[: len(text) - third] + other[:third]
    fp = votes(edited)
    return {
        "doc_id": doc[0], "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": spelled(doc[2]), "edited_fingerprint": spelled(fp),
        "near_edited": likeness(doc[2], fp), "near_next": likeness(doc[2], following[2]),
    }


def against_next(df: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document, by descending id (the first follows the last).

    Rows are dealt out by ranges of the id, so a document finds the next one in
    its own task. Only the ends of the ranges meet in a second step, two rows of
    each. Nulls come last; rows that share an id follow in the order of their texts' hash.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = StructType.fromDDL(f"{result}, part int, end string, text string, low long, high long")
    target = to_arrow_schema(schema)
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    dealt = df.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(*order).sortWithinPartitions(*order).drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def end(name: str, doc: tuple) -> dict:
            return {"doc_id": doc[0], "part": part, "end": name, "text": doc[1], "low": doc[2][0], "high": doc[2][1]}

        last = None
        for batch in batches:
            made = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                row = (doc.as_py(), text, votes(text))
                made.append(end("first", row) if last is None else _edited(last, row))
                last = row
            yield pa.RecordBatch.from_pylist(made, target)
        if last is not None:
            yield pa.RecordBatch.from_pylist([end("last", last)], target)

    path = scratch_path(df.sparkSession, "fingerprints")
    bounded(dealt).mapInArrow(run, schema).write.parquet(path)
    made = df.sparkSession.read.schema(schema).parquet(path)
    columns = [f.name for f in StructType.fromDDL(result)]
    # One row for each range, without texts.
    ranks = made.where("end = 'first'").select("part", F.row_number().over(Window.orderBy("part")).alias("rank"))
    heads = made.where("end = 'first'").join(ranks, "part")
    tails = made.where("end = 'last'").join(ranks, "part")
    count = F.lit(ranks.count())
    tails = tails.select((F.col("rank") % count + 1).alias("rank"), "doc_id", "text", "low", "high")
    heads = heads.select("rank", F.col("text").alias("text_2"), F.col("low").alias("low_2"), F.col("high").alias("high_2"))
    ends = tails.join(heads, "rank").drop("rank")

    def work(batch: pa.RecordBatch) -> dict:
        rows = [_edited((r["doc_id"], r["text"], (r["low"], r["high"])), (None, r["text_2"], (r["low_2"], r["high_2"]))) for r in batch.to_pylist()]
        return {c: [r[c] for r in rows] for c in columns}

    return made.where("end is null").select(*columns).unionByName(map_batches(ends, work, result))

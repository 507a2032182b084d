"""Packing token pieces into sequences by minimum bin slack.

Each bin starts with the longest piece left; a bitset subset-sum over the
lengths still available finds the fullest combination for the rest, and the bin's
pieces are removed. Only counts per length enter that choice, and a combination
stays the fullest for as long as its lengths last, so it is taken that many times
at once. The plan is therefore bounded by the capacity, whatever the number of
pieces: at most capacity * H(capacity) combinations, each of which uses up some
length's multiplicity.

Null texts are empty, and an empty document is one piece that holds its end
token. Repeated rows are packed each on its own; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches
from millrace.llm.bpe import codec
from millrace.session import cut_lineage

#: Pieces of one length that are numbered in one task, on average.
CELL = 4000


def pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32: token pieces of each row; only the first may be short of a cut."""

    def work(batch: pa.RecordBatch) -> dict:
        tool, end = codec(path), end_id.to_bytes(4, "little")
        rows, piece, start, length, crc = [], [], [], [], []
        for at, text in enumerate(batch.column(1)):
            ids = tool.encode(text.as_py()) + end
            size = len(ids) // 4
            stop, number = (size % capacity or capacity), 0
            begin = 0
            while begin < size:
                rows.append(at)
                piece.append(number)
                start.append(begin)
                length.append(stop - begin)
                crc.append(zlib.crc32(ids[4 * begin : 4 * stop]))
                begin, stop, number = stop, stop + capacity, number + 1
        return {id_col: batch.column(0).take(pa.array(rows)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return map_batches(df.select(id_col, text_col), work, schema)


def fullest(room: int, left: dict[int, int]) -> Counter:
    """The lengths, at most as often as ``left`` has them, with the largest sum up to ``room``."""
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, count in left.items() if count and n <= room), reverse=True):
        for _ in range(min(left[length], room // length)):
            grown = reach | (reach << length) & mask
            if grown == reach:
                break
            trail.append((length, reach))
            reach = grown
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, before in reversed(trail):
        if not before >> total & 1:
            chosen[length] += 1
            total -= length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """(times, lengths of one bin) until all counted pieces are placed."""
    left, made = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(capacity - longest, left)
        left[longest] += 1
        chosen[longest] += 1
        times = min(left[n] // m for n, m in chosen.items())
        for n, m in chosen.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
        made.append((times, chosen))
    return made


def slots(bins: list[tuple[int, Counter]]) -> list[tuple]:
    """(length, first, last, times, sequence, offset): where the numbered pieces of each length go."""
    used, sequence, made = Counter(), 0, []
    for times, chosen in bins:
        offset = 0
        for n, m in sorted(chosen.items(), reverse=True):
            made.append((n, used[n], used[n] + times * m - 1, times, sequence, offset))
            used[n] += times * m
            offset += n * m
        sequence += times
    return made


def pack(parts: DataFrame, capacity: int = 1024, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``parts`` (with a column length, 1 to ``capacity``) with sequence_id and offset added.

    ``parts`` is read several times and must give the same rows each time: pass a checkpoint or a table.
    """
    spark = parts.sparkSession
    cells = max(1, parts.count() // CELL)
    placed = parts.withColumn("cell", F.pmod(F.xxhash64(*keys), F.lit(cells)))
    held = placed.groupBy("length", "cell").count()
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("piece lengths must lie between 1 and the capacity")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "cell").orderBy(*keys)
    numbered = placed.withColumn("at", F.row_number().over(within)).join(firsts, ["length", "cell"])
    numbered = numbered.withColumn("at", F.col("at") + F.col("before") - 1)
    schema = "slot_length long, first long, last long, times long, sequence long, base long"
    table = F.broadcast(spark.createDataFrame(slots(plan(counts, capacity)), schema))
    fits = (F.col("length") == F.col("slot_length")) & F.col("at").between(F.col("first"), F.col("last"))
    step = F.col("at") - F.col("first")
    return numbered.join(table, fits).select(
        *parts.columns,
        (F.col("sequence") + step % F.col("times")).alias("sequence_id"),
        (F.col("base") + F.floor(step / F.col("times")) * F.col("length")).alias("offset"),
    )


def pack_documents(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    return pack(cut_lineage(pieces(df, path, capacity, end_id)), capacity)

"""Spelling variants: words one edit apart, found by exact signatures of their letters.

Two words that differ by one inserted, deleted or replaced letter differ by at
most two entries of their letter multisets, seen as binary vectors with one
dimension per (letter, how often so far). The dimensions are dealt out over
``PARTS`` parts, so such words agree in all but two parts at most. Every word
therefore gets one signature per choice of two parts to leave out, over the rest
of its vector; words that share a signature are compared letter by letter. This
is exact: no pair is missed whatever the parts hold.

A word's form is its most frequent near word if that is at least ``LEAD`` times as
frequent, the smaller in code-point order among equals; the root is the end of
the chain of forms. Frequencies rise along a chain, so it cannot turn back.

Null and empty texts have no words. A row without an id counts like any other,
but no letter of it is deleted by ``edited_runs``. Repeated rows count again. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.batches import bounded, map_batches
from millrace.session import cut_lineage

RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z are lower-cased
PARTS = 6
LEAD = 2
#: Occurrences of a letter up to this one are dealt out by how frequent they are, later ones by hash.
TIMES = 4
#: Distinct words a task holds before it passes its counts on.
HELD = 200_000


def edited_runs(text: str | None, doc_id: int | None, every: int) -> Counter:
    """The letter runs of a text, A-Z lower-cased; one run in ``every`` loses a letter, chosen by its crc32."""
    runs = Counter(RUN.findall(text.encode().lower().decode())) if text else Counter()
    if doc_id is None:
        return runs
    found: Counter = Counter()
    lead = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), lead)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def word_counts(df: DataFrame, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """``word``, ``n``: words of at least ``shortest`` letters that occur ``least`` times or more.

    Every task adds up its own words first, so a frequent word is one row a task.
    """
    schema = StructType.fromDDL("word string, n long")

    def passed_on(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in edited_runs(text.as_py(), doc_id, every).items():
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield passed_on(held)
                    held = Counter()
        if held:
            yield passed_on(held)

    counted = bounded(df.select("doc_id", "text")).mapInArrow(run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def dimensions(word: str) -> list[tuple[str, int]]:
    """The letter multiset as entries of a binary vector: the first, second, ... time of each letter."""
    seen: Counter = Counter()
    found = []
    for letter in word:
        seen[letter] += 1
        found.append((letter, seen[letter]))
    return found


def dealt(words: DataFrame) -> dict[tuple[str, int], int]:
    """The part of each frequent dimension, so that all parts hold about as many letters.

    Counted over all words; at most ``TIMES`` rows a letter of the alphabet come back.
    """
    letters = words.select("word", F.explode(F.split("word", "")).alias("letter"))
    times = letters.groupBy("word", "letter").count().where("letter <> ''")
    counts = times.select("letter", F.explode(F.sequence(F.lit(1), F.least(F.col("count"), F.lit(TIMES)).cast("int"))).alias("time"))
    rows = counts.groupBy("letter", "time").count().orderBy(F.desc("count"), "letter", "time").collect()
    load, parts = [0] * PARTS, {}
    for row in rows:
        part = load.index(min(load))
        parts[row["letter"], row["time"]] = part
        load[part] += row["count"]
    return parts


def signature_keys(word: str, parts: dict[tuple[str, int], int]) -> list[int]:
    """One key per choice of two parts left out, over the entries in the other parts."""
    sums = [0] * PARTS
    for letter, time in dimensions(word):
        h = xxhash.xxh64_intdigest(f"{letter}{time}")
        sums[parts.get((letter, time), h % PARTS)] += h
    whole = sum(sums)
    keys = [(whole - sums[a] - sums[b]) * PARTS * PARTS + a * PARTS + b for a, b in combinations(range(PARTS), 2)]
    return [xxhash.xxh64_intdigest((k % (1 << 128)).to_bytes(16, "little")) - (1 << 63) for k in keys]


def near_words(words: DataFrame, shortest: int = 5) -> DataFrame:
    """``a``, ``b``: all pairs of words that are one edit apart, each once, a before b.

    Words of ``shortest`` letters or more that are one edit apart have the same
    first or the same last letters, which spares most comparisons in full.
    """
    parts, ends = dealt(words), shortest // 2

    def work(batch: pa.RecordBatch) -> dict:
        given = batch.column(0).to_pylist()
        return {
            "word": given, "keys": [signature_keys(w, parts) for w in given],
            "ends": np.array([[zlib.crc32(w[:ends].encode()) >> 1, zlib.crc32(w[-ends:].encode()) >> 1] for w in given], np.int64).reshape(-1, 2) @ [1 << 32, 1],
        }

    signed = map_batches(words.select("word"), work, "word string, keys array<long>, ends long")
    listed = signed.select(F.explode("keys").alias("key"), "word", "ends")
    one = listed.toDF("key", "a", "ends_a")
    two = listed.toDF("key", "b", "ends_b")
    apart = F.col("ends_a").bitwiseXOR(F.col("ends_b"))
    alike = (F.shiftright(apart, 32) == 0) | (apart.bitwiseAND((1 << 32) - 1) == 0)
    one_edit = (F.col("a") < F.col("b")) & alike & (F.levenshtein("a", "b", 1) == 1)
    return one.join(two, (one["key"] == two["key"]) & one_edit).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where the chain of forms from each word ends; ``forms`` is (word, form), form null at an end.

    Every round doubles the part of the chains that is known.
    """
    known = cut_lineage(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = known.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = known.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = cut_lineage(longer)
        moved = not longer.where("moved").isEmpty()
        known = longer.select("word", "root")
        if not moved:
            return known


def variants(words: DataFrame, shortest: int = 5) -> DataFrame:
    """``word``, ``n``, ``form``, ``root``, ``n_near``, ``form_n`` for every word of ``words`` (word, n)."""
    words = cut_lineage(words)
    pairs = cut_lineage(near_words(words, shortest))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnsRenamed({"a": "word", "b": "near"})
    weighed = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = weighed.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    leads = -F.col("best.less") >= LEAD * F.col("n")
    named = cut_lineage(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"),
    ))
    return named.join(roots(named), "word").select("word", "form", "root", "n", "n_near", "form_n")

"""Near duplicates by SimHash, found through a byte-position inverted index.

A document's fingerprint has a bit set where over half of its shingle hashes
have it. Two fingerprints of eight bytes that differ in at most four bits share
at least four bytes, each at its own position. The index therefore lists
fingerprints under three shared positional bytes; the twenty position triples
are chosen so that any four positions contain one of them. Within a list the
shared positional bytes of each pair are tallied, pairs below four go, and the
rest are verified bit by bit.

Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows and equal texts meet in one fingerprint before any pair is made.
Rows with a null id take part; a group of such rows alone has a null id. Other
columns are ignored and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm import multimatch
from millrace.llm.batches import bounded, map_batches
from millrace.llm.graph import components
from millrace.llm.phrases import BASE, mixed
from millrace.session import cut_lineage

SEED = 42
#: Words of a shingle of the fingerprints.
SHINGLE = 4
BYTES = 8
#: Fingerprints of one list that a task compares by itself; longer lists are split into pairs of blocks.
LIST = 16_384
BLOCK = 4096
EDGES = "kind int, a long, b long, key long"


def shingle_bits(text: str | None, words: int, seed: int) -> int:
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = np.array(hashes[at : at + 4096], "<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``id_col``, ``fp`` (the fingerprint as a signed long)."""

    def work(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(0), "fp": [shingle_bits(t.as_py(), words, seed) for t in batch.column(1)]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), work, f"`{id_col}` {kind}, fp long")


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of the eight positions such that any four positions contain one of them."""
    side = [0, 0, 0, 1, 1, 1, 2, 2]
    chosen = []
    for triple in combinations(range(BYTES), 3):
        sides = sorted(side[p] for p in triple)
        held = [sides.count(s) for s in range(3)]
        if 3 in held or any(held[s] == 2 and held[(s + 1) % 3] == 1 for s in range(3)):
            chosen.append(triple)
    return chosen


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(kind, a, b): links between distinct fingerprints (columns kind, fp) at ``radius`` bits or fewer, up to four.

    Only fingerprints of one kind are compared. Each list gives a spanning forest
    of its links, not all of them, so the rows stay below the index entries
    whatever the size of a group; components over them are those of all links.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the position triples are complete up to a radius of four bits")
    least, most = BYTES - radius, LIST
    at = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    keys = [
        F.lit(n << 24).bitwiseOR(F.shiftleft(at(p), 16)).bitwiseOR(F.shiftleft(at(q), 8)).bitwiseOR(at(r))
        for n, (p, q, r) in enumerate(position_triples())
    ]
    keys = [F.shiftleft(F.col("kind").cast("long"), 32).bitwiseOR(k) for k in keys]
    index = fps.select("kind", "fp").distinct().select("fp", F.explode(F.array(*keys)).alias("key"))
    listed = index.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed_on = np.zeros((0, 5), np.int64), None
        for batch in batches:
            rows = np.zeros((len(held) + batch.num_rows, 5), np.int64)
            rows[: len(held)] = held
            rows[len(held) :, 0] = batch.column(0).to_numpy()
            rows[len(held) :, 4] = batch.column(1).to_numpy()
            if not len(rows):
                continue
            bounds = [0, *(np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1).tolist()]
            if rows[0, 0] == passed_on:  # the rest of a list that is too long for one task
                stop = bounds[1] if len(bounds) > 1 else len(rows)
                yield _open(rows[:stop])
                bounds = bounds[1:]
            if not bounds:
                held = rows[:0]
                continue
            yield _edges(rows, bounds, least, radius)
            held = rows[bounds[-1] :]
            if len(held) > most:
                yield _open(held)
                passed_on, held = int(held[0, 0]), rows[:0]
        if len(held):
            yield _edges(held, [0, len(held)], least, radius)

    found = cut_lineage(bounded(listed).mapInArrow(lists, StructType.fromDDL(EDGES)))
    long = found.where("key is not null").select("key", F.col("a").alias("fp"))
    sizes = long.groupBy("key").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    shared = long.join(sizes, "key").select("key", "fp", "blocks")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = shared.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    ordered = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)], 1)
            if not len(rows):
                continue
            rows = np.concatenate([held, rows])
            bounds = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1).tolist()]
            yield _edges(rows, bounds, least, radius)
            held = rows[bounds[-1] :]
        if len(held):
            yield _edges(held, [0, len(held)], least, radius)

    pairs = ordered.mapInArrow(run, StructType.fromDDL(EDGES)).unionByName(found.where("key is null"))
    return pairs.select("kind", "a", "b").distinct()


def _open(rows: np.ndarray) -> pa.RecordBatch:
    """Entries of a list that is left to pairs of blocks."""
    nothing = pa.nulls(len(rows), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(rows), pa.int32()), pa.array(rows[:, 4]), nothing, pa.array(rows[:, 0])], names=["kind", "a", "b", "key"]
    )


def _edges(rows: np.ndarray, bounds: list[int], least: int, radius: int) -> pa.RecordBatch:
    made: list[tuple[int, int, int]] = []
    for start, stop in zip(bounds, bounds[1:]):
        group = rows[start:stop]
        if len(group) > 1:
            kind = int(group[0, 0] >> 32)
            made += [(kind, a, b) for a, b in _forest(group[:, 4], group[:, 3], group[0, 1], group[0, 2], least, radius)]
    return pa.RecordBatch.from_arrays(
        [pa.array([m[0] for m in made], pa.int32()), *(pa.array([m[n] for m in made], pa.int64()) for n in (1, 2)), pa.nulls(len(made), pa.int64())],
        names=["kind", "a", "b", "key"],
    )


def _forest(fps: np.ndarray, own: np.ndarray, i: int, j: int, least: int, radius: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one list (between blocks i and j) into their groups."""
    bits = fps.view(np.uint64)
    label, made = np.arange(len(fps)), []
    left = np.flatnonzero(own == i)
    right = np.flatnonzero(own == j)
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        apart = bits[part][:, None] ^ bits[right][None, :]
        shared = (apart.view(np.uint8).reshape(*apart.shape, BYTES) == 0).sum(2)
        near = (shared >= least) & (np.bitwise_count(apart) <= radius)
        for row in np.flatnonzero(near.sum(1) > (i == j)):
            found = right[near[row]]
            groups, first = np.unique(label[found], return_index=True)
            mine = label[part[row]]
            others = groups != mine
            if others.any():
                made += [(int(fps[part[row]]), int(fps[found[f]])) for f in first[others]]
                label[np.isin(label, groups)] = mine
    return made


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = 4) -> DataFrame:
    """``id_col``, ``fp``, ``component_id``: the smallest id that a document reaches over links."""
    fps = cut_lineage(fingerprints(df, id_col, text_col, words))
    firsts = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    groups = components(links(fps.withColumn("kind", F.lit(0)), radius)).withColumnRenamed("node", "fp")
    known = cut_lineage(firsts.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def band_keys(text: str | None, words: int, bands: int, rows: int) -> list[int]:
    """``bands`` keys of a text, each over ``rows`` least hashes of its shingles.

    Two texts agree in a least hash with a chance equal to the Jaccard similarity
    of their shingle sets, whatever edit lies between them.
    """
    parts = text.encode().lower().split() if text else []
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in parts], np.uint64)
    size = max(1, len(hashes) - words + 1)
    shingles = np.zeros(size, np.uint64)
    for n in range(min(words, len(hashes))):
        shingles = shingles * np.uint64(BASE) + hashes[n : n + size]
    shingles = mixed(shingles)
    turns = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, size, 1024):
        np.minimum(least, (turns[:, None] * shingles[at : at + 1024]).min(1), out=least)
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = mixed(keys * np.uint64(BASE) + column)
    return keys.view(np.int64).tolist()


def text_key(text: str) -> Column:
    """Sixteen bytes that stand for a text; a null text counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def key_lists(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``anchor``, ``sig``, ``first``, ``part``, ``blocks``: the texts (h) under each key, where they lie in more than one group.

    Keys with the same members are one list.
    """
    named = members.withColumn("part", F.lit(-1).cast("long"))
    if groups is not None:
        named = members.join(groups.withColumnRenamed("node", "h"), "h", "left")
        # The hash of a null is not null.
        part = F.when(F.col("component").isNotNull(), F.xxhash64("component")).otherwise(F.lit(-1).cast("long"))
        named = named.select("h", "first", "key", part.alias("part"))
    own = F.when(F.col("part") == -1, F.xxhash64("h")).otherwise(F.col("part"))
    sums = [F.sum(F.xxhash64("h") % 1_000_000_007).alias("s"), F.bit_xor(F.xxhash64("h")).alias("x")]
    named = named.repartition("key")  # one shuffle for the sums and for the rows
    lists = named.groupBy("key").agg(F.count("*").alias("n"), F.min(own).alias("low"), F.max(own).alias("high"), *sums)
    once = lists.where((F.col("n") > 1) & (F.col("low") != F.col("high"))).groupBy("n", "s", "x").agg(F.min("key").alias("key"))
    sized = once.select("key", F.ceil(F.col("n") / multimatch.BLOCK).cast("int").alias("blocks"))
    return cut_lineage(named.join(sized, "key").select(F.col("key").alias("anchor"), F.col("h").alias("sig"), "first", "part", "blocks"))


def near_copies(df: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 26, rows: int = 4, first: int = 4) -> DataFrame:
    """(doc_id, h, kept_id, kept_h): rows in groups of texts whose shingle sets have a Jaccard ``similarity`` or more.

    ``h`` is the ``text_key``; the kept row of a group has the smallest id, then
    the smallest key. Rows alone in their group and rows without an id are left
    out. Equal texts are one text here, whatever their number.

    Texts whose fingerprints link (``links``, four bits) are one list, and each of their pairs is verified on the
    shingles themselves. Fingerprints of texts at that similarity may lie further apart, where words were added or
    removed; so a pair that is not in one group by then is also looked at if one of its ``bands`` keys agrees. A pair
    of similarity s beyond the four bits is missed with a chance of (1 - s ** rows) ** bands: about one in a million at 0.8.

    The ``first`` keys join most of what is left; under the others only lists that still hold
    several groups are looked at. A list is joined inside a task, long ones in pairs of blocks, so
    that texts travel once per list and block and only links between groups come out.
    """
    known = df.where("doc_id is not null").select("doc_id", "text")
    kind_of_id = df.schema["doc_id"].dataType.simpleString()
    percent = round(100 * similarity)

    def named_by(text: str | None) -> bytes:
        return hashlib.sha256((text or "").encode()).digest()[:16]

    def work(batch: pa.RecordBatch) -> dict:
        texts = [t.as_py() for t in batch.column(1)]
        return {
            "doc_id": batch.column(0), "h": [named_by(t) for t in texts], "fp": [shingle_bits(t, SHINGLE, SEED) for t in texts],
            "keys": [band_keys(t, words, bands, rows) for t in texts],
        }

    every = cut_lineage(map_batches(known, work, f"doc_id {kind_of_id}, h binary, fp long, keys array<long>"))
    tops = [F.min("doc_id").alias("first"), F.count("*").alias("rows"), *[F.any_value(c).alias(c) for c in ("fp", "keys")]]
    named = cut_lineage(every.groupBy("h").agg(*tops))
    one = F.struct(F.col("first").alias("doc_id"), "h").alias("first")
    near = components(links(named.select(F.lit(0).alias("kind"), "fp"))).withColumnRenamed("node", "fp")
    members = named.select("h", one, "fp").join(near, "fp", "left").select("h", "first", F.coalesce("component", "fp").alias("key"))
    found = multimatch.linked_in_lists(known, key_lists(members, None), words, percent, named_by)
    groups = cut_lineage(components(found))

    members = named.select("h", one, F.posexplode("keys").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut_lineage(members.join(shared, "key").select("key", "h", "first", "band"))
    for turn in (F.col("band") < first, F.col("band") >= first):
        more = multimatch.linked_in_lists(known, key_lists(members.where(turn).drop("band"), groups), words, percent, named_by)
        if not more.isEmpty():
            found = found.unionByName(more)
            groups = cut_lineage(components(found))
    found = named.select("h", "first", "rows").join(groups.withColumnRenamed("node", "h"), "h", "left").where("rows > 1 or component is not null")
    found = cut_lineage(found.withColumn("component", F.coalesce("component", "h")))
    keep = found.groupBy("component").agg(F.min(F.struct("first", "h")).alias("k"))
    chosen = found.join(keep, "component").select("h", F.col("k.first").alias("kept_id"), F.col("k.h").alias("kept_h"))
    return every.select("doc_id", "h").join(chosen, "h").select("doc_id", "h", "kept_id", "kept_h")

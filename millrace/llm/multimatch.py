"""Documents whose word shingle sets are nearly equal, by adaptive multi-match prefixes.

A set of n shingles can only reach the similarity with another one if both share
at least ``t``, the ceiling of ``similarity * n``, of them. In any common order of the shingles the
first ``n - t + l`` of each then share ``l`` or more. Every set takes the ``l`` whose
estimated cost is least: a longer prefix meets more lists, but asks more matches
of a candidate before it is verified. Two sets with different ``l`` need the smaller
number. Shingles are ordered from rare to frequent by counts over all documents, kept in
a table of fixed size; counts only steer the order and ``l``, never the result.

Equal sets are one set throughout. The join then runs in two turns, so that a
large group of alike texts never becomes pairs:

* Sets that share one of their three least hashes meet in a list. There the
  multi-match join runs in memory, with counts of the list itself, and passes on only the
  links that join two groups. Long lists are cut into pairs of blocks.
* All prefixes are then joined, and matches of each pair are counted across lists; pairs
  that have met before, or lie in one group by now, are left out. What reaches its
  number of matches is verified on the sets.

A shingle is its 64-bit hash. Null and empty texts have the empty set and are
linked with nothing; a text of fewer words than a shingle is one shingle. Rows
without an id take part, a group of such rows alone has a null id. Repeated rows
and ids are separate rows of the result. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.batches import bounded, map_batches, release
from millrace.llm.graph import components
from millrace.llm.phrases import BASE, mixed
from millrace.session import cut_lineage

WORDS, PERCENT = 3, 90
#: Least hashes under which a set is first looked for.
ANCHORS = 3
#: The table of shingle counts has 2 ** TABLE_BITS numbers, kept in SLICES parts.
TABLE_BITS, SLICES = 18, 16
#: Prefixes ask for up to MOST_MATCHES matches; a verification costs about as much as VERIFY list entries.
MOST_MATCHES, VERIFY = 6, 20
#: Sets of a block, entries of a list that one task holds.
BLOCK, LIST = 1024, 16_384
SHUFFLED = "token long, node long, part long, x long, y long, z long, size long"
NAMES = ["token", "node", "part", "x", "y", "z", "size"]
#: Lists of up to so many entries are paired together, longer ones one by one.
SHORT = 64
#: Pairs of list entries that a task compares at once.
PAIRS = 250_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, parts), np.uint64, len(parts))
    size = max(1, len(parts) - words + 1)
    found = np.zeros(size, np.uint64)
    for n in range(min(words, len(parts))):
        found = found * np.uint64(BASE) + hashes[n : n + size]
    return np.unique(mixed(found))


def needed(size, percent: int):
    """Least number of shared shingles of a set of ``size`` with any that is similar."""
    return -(-percent * size // 100)


def alike(shared, one, two, percent: int):
    return 100 * shared >= percent * (one + two - shared)


def matches_for(frequencies: np.ndarray, percent: int) -> int:
    """The number of matches to ask for, from the estimated frequencies of a set in prefix order.

    Each candidate with l matches takes l of the entries that its prefix meets, so there
    are at most entries / l of them to verify.
    """
    size = len(frequencies)
    least = int(needed(size, percent))
    asked = np.arange(1, min(MOST_MATCHES, least) + 1)
    entries = np.cumsum(frequencies[: size - least + len(asked)])[size - least + asked - 1]
    return int(asked[np.argmin(entries * (1 + VERIFY / asked))])


def text_hash(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode())


class Groups:
    """The multi-match join of one list of sets, by groups.

    ``side`` tells the blocks apart: with two blocks only pairs across them count.
    ``met`` holds the anchors under which a set was listed before; pairs that share one are left out, and
    so are pairs of one ``part``, a group that is known already (-1: none).
    """

    def __init__(self, sets: list[np.ndarray], side: np.ndarray, met: list[list[int]], percent: int, part: np.ndarray | None = None):
        self.percent, self.side, self.label = percent, side, np.arange(len(sets))
        if part is not None:
            first = np.unique(part, return_index=True, return_inverse=True)[1:]
            self.label = np.where(part == -1, self.label, first[0][first[1]])
        self.across = side.min() != side.max()
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        flat = np.concatenate(sets)
        _, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((index, counts[index], owner))
        self.index, self.total = index[order], len(counts)
        self.asked = np.ones(len(sets), np.int64)
        keep = np.zeros(len(flat), bool)
        for n, (end, size) in enumerate(zip(self.ends.tolist(), self.sizes.tolist())):
            frequencies = counts[self.index[end - size : end]]
            self.asked[n] = matches_for(frequencies, percent)
            stop = end - size + (size - int(needed(size, percent)) + self.asked[n])
            keep[end - size : stop] = frequencies[: stop - end + size] > 1
        # Postings: the sets that have a shingle in their prefix, and where each shingle's run of them starts.
        shingle, holder = self.index[keep], owner[keep]
        self.prefix_ends = np.cumsum(np.bincount(holder, minlength=len(sets)))
        self.prefix = shingle
        by = np.argsort(shingle, kind="stable")
        self.posted = holder[by]
        self.starts = np.searchsorted(shingle[by], np.arange(self.total + 1))
        width = max((len(m) for m in met), default=0)
        self.met = np.array([[*m, *[0] * (width - len(m))] for m in met], np.int64).reshape(len(sets), width)
        self.known = np.array([[True] * len(m) + [False] * (width - len(m)) for m in met], bool).reshape(len(sets), width)

    def _candidates(self, n: int, label: np.ndarray) -> np.ndarray:
        start = self.prefix_ends[n - 1] if n else 0
        runs = [self.posted[self.starts[s] : self.starts[s + 1]] for s in self.prefix[start : self.prefix_ends[n]].tolist()]
        if not runs:
            return np.zeros(0, np.int64)
        found = np.concatenate(runs)
        matches = np.bincount(found[found < n], minlength=n)[:n]
        few, many = np.minimum(self.sizes[:n], self.sizes[n]), np.maximum(self.sizes[:n], self.sizes[n])
        good = (matches >= np.minimum(self.asked[:n], self.asked[n])) & (100 * few >= self.percent * many) & (label[:n] != label[n])
        if self.across:
            good &= self.side[:n] != self.side[n]
        for a in range(self.met.shape[1]):
            for b in range(self.met.shape[1]):
                if self.known[n, b]:
                    good &= ~(self.known[:n, a] & (self.met[:n, a] == self.met[n, b]))
        found = np.flatnonzero(good)
        return found[np.argsort(-matches[found], kind="stable")]

    def links(self) -> list[tuple[int, int]]:
        label, made = self.label.copy(), []
        mark = np.zeros(self.total, bool)
        for n in range(1, len(self.sizes)):
            left, step = self._candidates(n, label), 1
            if not len(left):
                continue
            own = self.index[self.ends[n] - self.sizes[n] : self.ends[n]]
            mark[own] = True
            while len(left):
                part, left = left[:step], left[step:]
                held = [self.index[self.ends[p] - self.sizes[p] : self.ends[p]] for p in part.tolist()]
                edges = np.cumsum([0, *map(len, held[:-1])])
                shared = np.add.reduceat(mark[np.concatenate(held)].astype(np.int64), edges)
                for p in part[alike(shared, self.sizes[part], self.sizes[n], self.percent)].tolist():
                    if label[p] != label[n]:
                        made.append((p, n))
                        label[label == label[p]] = label[n]
                left, step = left[label[left] != label[n]], min(4 * step, 256)
            mark[own] = False
        return made


def described(docs: DataFrame, words: int) -> DataFrame:
    """Per row ``doc_id``, ``h`` (of the text), ``sig`` (of the set), ``n``, ``anchors``; and the tasks' count tables by ``slice``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {kind}, h binary, sig binary, n long, anchors array<long>, slice int, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        table = np.zeros(1 << TABLE_BITS, np.uint32)
        for batch in batches:
            h, sig, n, anchors = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                found = shingles(text, words)
                np.add.at(table, (found >> np.uint64(64 - TABLE_BITS)).astype(np.int64), 1)
                h.append(text_hash(text))
                sig.append(xxhash.xxh3_128_digest(found.tobytes()))
                n.append(len(found))
                anchors.append(found[:ANCHORS].view(np.int64).tolist())
            none = pa.nulls(len(h))
            columns = [batch.column(0), h, sig, n, anchors, none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, target)], schema=target)
        if table.any():
            press = zstandard.ZstdCompressor(level=1).compress
            parts = [press(part.tobytes()) for part in table.reshape(SLICES, -1)]
            columns = [*[pa.nulls(SLICES, f.type) for f in list(target)[:5]], pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return cut_lineage(bounded(docs.select("doc_id", "text")).mapInArrow(run, schema))


def count_table(tables: DataFrame) -> np.ndarray:
    """All tasks' tables added up; the table has a fixed size, whatever the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(part.as_py()), np.uint32).astype(np.int64)
                held[number] = held[number] + counts if number in held else counts
        rows = [pa.array(held.keys(), pa.int32()), pa.array([c.tobytes() for c in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, names=["slice", "counts"])

    added = tables.select("slice", "counts").repartition(SLICES, "slice").mapInArrow(run, "slice int, counts binary")
    table = np.zeros((SLICES, (1 << TABLE_BITS) // SLICES), np.int64)
    for row in added.collect():
        table[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return table.reshape(-1)


def compressed(docs: DataFrame, asked: DataFrame, named: Callable[[str | None], bytes] = text_hash) -> DataFrame:
    """The rows of ``asked`` with ``text`` (zstandard), the text that their ``first`` (doc_id and h) names.

    ``named`` gives the ``h`` of a text. The texts are shuffled once for it, at every size alike.
    Rows of ``docs`` that repeat id and text give repeated rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        press = zstandard.ZstdCompressor(level=3).compress
        texts = [t.as_py() for t in batch.column(1)]
        return {"id": batch.column(0), "t": [named(t) for t in texts], "text": [press((t or "").encode()) for t in texts]}

    texts = map_batches(docs.select("doc_id", "text"), work, f"id {kind}, t binary, text binary")
    found = texts.join(asked.hint("merge"), F.col("id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.h")))
    return found.drop("id", "t", "first")


def _read(text: bytes, words: int) -> np.ndarray:
    found = shingles(zstandard.ZstdDecompressor().decompress(text).decode(), words)
    return found if len(found) else np.zeros(1, np.uint64)  # texts without words are alike where they are listed


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with equal leading columns out of a sorted stream, one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(keys)], 1)
        bounds = [0, *(np.flatnonzero((rows[1:] != rows[:-1]).any(1)) + 1).tolist(), len(rows)]
        for start, stop in zip(bounds, bounds[1:]):
            key = tuple(rows[start])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def anchored(sets: DataFrame, percent: int) -> DataFrame:
    """``anchor``, ``sig``, ``first``, ``earlier``, ``blocks``: lists of two sets and more under a common anchor.

    A set is listed only if another one under the anchor has about its size, as others cannot be
    similar. A list whose sets all share their first anchor holds no pair that was not met there.
    """
    # Sets of similar size lie in one class or in neighbouring ones; a percent is left for rounding.
    size_class = F.floor(F.log("n") / math.log(100 / (percent - 1))).cast("int")
    listed = sets.select("sig", "first", "anchors", size_class.alias("class"), F.posexplode("anchors").alias("at", "anchor"))
    listed = listed.select(
        "anchor", "class", "sig", "first", F.slice("anchors", 1, F.col("at")).alias("earlier"), F.element_at("anchors", 1).alias("lead")
    )
    counted = listed.groupBy("anchor", "class").agg(F.count("*").alias("n"))
    beside = counted.select("anchor", "n", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    near = beside.groupBy("anchor", "class").agg(F.sum("n").alias("n")).where("n > 1")
    listed = cut_lineage(listed.join(near, ["anchor", "class"], "left_semi"))
    lists = listed.groupBy("anchor").agg(F.count("*").alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high"))
    lists = lists.where((F.col("n") > 1) & ((F.col("low") != F.col("high")) | (F.col("low") == F.col("anchor"))))
    sized = lists.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return cut_lineage(listed.drop("lead", "class").join(sized, "anchor"))


def in_blocks(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (with ``blocks``, and ``by`` to deal them out) for every pair of blocks i <= j they take part in."""
    own = F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def linked_in_lists(
    docs: DataFrame, lists: DataFrame, words: int, percent: int, named: Callable[[str | None], bytes] = text_hash
) -> DataFrame:
    """``a``, ``b``: links that join the sets of each list (anchor, sig, first, blocks) into groups.

    ``lists`` may have ``earlier``, the anchors under which a set was met before, and ``part``, its group so far.
    """
    extra = {"earlier": F.array().cast("array<long>"), "part": F.lit(-1).cast("long")}
    lists = lists.withColumns({c: v for c, v in extra.items() if c not in lists.columns})
    tasks = compressed(docs, in_blocks(lists, "sig"), named)
    ordered = tasks.select("anchor", "i", "j", "own", "earlier", "sig", "text", "part")
    ordered = ordered.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            if rows.num_rows < 2:
                continue
            # Rows that repeat id and text are one set here.
            sigs = rows.column(5).to_pylist()
            once = list({sig: n for n, sig in enumerate(sigs)}.values())
            if len(once) < 2:
                continue
            rows, sigs = rows.take(once), [sigs[n] for n in once]
            side, part = rows.column(3).to_numpy(), rows.column(7).to_numpy()
            groups = Groups([_read(t, words) for t in rows.column(6).to_pylist()], side, rows.column(4).to_pylist(), percent, part)
            found = groups.links()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([sigs[p[n]] for p in found], pa.binary()) for n in (0, 1)], names=["a", "b"])
        release()

    return cut_lineage(bounded(ordered).mapInArrow(run, "a binary, b binary"))


def prefixes(docs: DataFrame, table: np.ndarray, words: int, percent: int) -> DataFrame:
    """``id``, ``t``, ``prefix``, ``size`` of every row; ``size`` packs the set's size and the matches it asks for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    common = max(1, int(table.mean()))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(batch: pa.RecordBatch) -> dict:
        counts = shared.value
        made: dict[str, list] = {"t": [], "prefix": [], "size": []}
        for text in batch.column(1):
            text = text.as_py()
            found = shingles(text, words)
            total = counts[(found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            found, total = (x[np.lexsort((found, total))] for x in (found, total))
            size = len(found)
            asked = matches_for(np.maximum(total - common, 0) + 1, percent) if size else 0
            made["t"].append(text_hash(text))
            made["prefix"].append(found[: size - int(needed(size, percent)) + asked].view(np.int64).tolist())
            made["size"].append(size * 256 + asked)
        return {"id": batch.column(0), **made}

    return map_batches(docs.select("doc_id", "text"), work, f"id {kind}, t binary, prefix array<long>, size long")


def _told(rows: np.ndarray, valid: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int, own: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Of the pairs of rows (one, two) those that have not met yet: their nodes and the matches that they need."""
    good = rows[one, 1] != rows[two, 1]
    if own is not None:
        good &= own[one] != own[two]
    one, two = one[good], two[good]
    size, asked = rows[:, 5] // 256, rows[:, 5] % 256
    good = 100 * np.minimum(size[one], size[two]) >= percent * np.maximum(size[one], size[two])
    one, two = one[good], two[good]
    good = np.ones(len(one), bool)
    for x in (2, 3, 4):
        for y in (2, 3, 4):
            good &= ~(valid[one, x] & valid[two, y] & (rows[one, x] == rows[two, y]))
    one, two = one[good], two[good]
    if len(one):
        ends = np.sort(np.stack([rows[one, 0], rows[two, 0]]), 0)
        need, nothing = np.minimum(asked[one], asked[two]), pa.nulls(len(one), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(need), *[nothing] * 4], names=NAMES)


def _long_list(rows: np.ndarray, valid: np.ndarray, percent: int, own: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The pairs of one shingle's list, a stripe at a time; every one has an end outside the list's largest group."""
    _, inverse, counts = np.unique(rows[:, 1], return_inverse=True, return_counts=True)
    outside = inverse != counts.argmax()
    rank = np.where(outside, np.arange(len(rows)), -1)
    stripe = max(1, PAIRS // len(rows))
    left = np.flatnonzero(outside)
    for at in range(0, len(left), stripe):
        part = left[at : at + stripe]
        one, two = np.nonzero(rank[None, :] < rank[part][:, None])
        yield from _told(rows, valid, part[one], two, percent, own)


def _lists(rows: np.ndarray, valid: np.ndarray, starts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of all lists that start at ``starts``; lists of one group have none."""
    sizes = np.diff(np.append(starts, len(rows)))
    mixed = np.minimum.reduceat(rows[:, 1], starts) != np.maximum.reduceat(rows[:, 1], starts)
    for n in np.flatnonzero(mixed & (sizes > SHORT)).tolist():
        where = slice(starts[n], starts[n] + sizes[n])
        yield from _long_list(rows[where], valid[where], percent)
    first, size = starts[mixed & (sizes <= SHORT)], sizes[mixed & (sizes <= SHORT)]
    pairs = np.cumsum(size * (size - 1) // 2)
    cuts = np.searchsorted(pairs, np.arange(PAIRS, pairs[-1], PAIRS)) if len(pairs) else []
    for f, m in zip(np.split(first, cuts), np.split(size, cuts)):
        # Every row with all rows before it in its list.
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        one = np.repeat(np.repeat(f, m) + place, place)
        before = np.arange(place.sum()) - np.repeat(np.cumsum(place) - place, place)
        yield from _told(rows, valid, one, np.repeat(np.repeat(f, m), place) + before, percent)


def _list_rows(rows: pa.Table, first: int) -> tuple[np.ndarray, np.ndarray]:
    columns = [rows.column(c) for c in range(first, first + 6)]
    valid = np.stack([c.is_valid().to_numpy() for c in columns], 1)
    values = np.stack([c.fill_null(0).to_numpy().astype(np.int64) for c in columns], 1)
    values[~valid[:, 1], 1] = values[~valid[:, 1], 0]  # a set alone is its own group
    return values, valid


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """The rows in larger pieces."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _entries(token: int, rows: np.ndarray, valid: np.ndarray) -> pa.RecordBatch:
    """Rows of a list that is left to pairs of blocks."""
    columns = [pa.array(rows[:, c], mask=~valid[:, c] if c != 1 else None) for c in range(6)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), token)), *columns], names=NAMES)


def matched(entries: DataFrame, percent: int) -> DataFrame:
    """``x``, ``y``: nodes that share as many prefix shingles as they need; ``entries`` has the columns of ``SHUFFLED``."""
    ordered = entries.select(*NAMES).repartition("token").sortWithinPartitions("token")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros((0, 6), np.int64), np.zeros((0, 6), bool)
        last, passed_on = None, False
        for batch in _larger(batches):
            tokens = np.append(np.full(len(held), last or 0), batch.column(0).to_numpy())
            rows, valid = _list_rows(batch, 1)
            if passed_on:  # the rest of a list that is too long for one task
                stop = int((tokens == last).sum()) if tokens[0] == last else 0
                if stop:
                    yield _entries(last, rows[:stop], valid[:stop])
                tokens, rows, valid = tokens[stop:], rows[stop:], valid[stop:]
                if not len(tokens):
                    continue
                passed_on = False
            rows, valid = np.concatenate([held, rows]), np.concatenate([known, valid])
            starts = np.append(0, np.flatnonzero(tokens[1:] != tokens[:-1]) + 1)
            # The last list may go on in the next batch.
            stop, last = int(starts[-1]), int(tokens[-1])
            if stop:
                yield from _lists(rows[:stop], valid[:stop], starts[:-1], percent)
            held, known = rows[stop:], valid[stop:]
            if len(held) > LIST:
                yield _entries(last, held, known)
                held, known, passed_on = held[:0], known[:0], True
        if len(held):
            yield from _lists(held, known, np.zeros(1, np.int64), percent)
        release()

    # Pairs have no size; entries of lists that are too long for one task come out as they are.
    found = cut_lineage(ordered.mapInArrow(whole, StructType.fromDDL(SHUFFLED)))
    pair = [F.col("token").alias("x"), F.col("node").alias("y"), F.col("part").alias("need")]
    long = found.where("size is not null")
    sized = long.groupBy("token").agg(F.ceil(F.count("*") / LIST).cast("int").alias("blocks"))
    blocked = in_blocks(long.join(sized, "token"), "node").select("token", "i", "j", *NAMES[1:], "own")
    blocked = blocked.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def in_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            values, valid = _list_rows(rows, 3)
            across = rows.column(1)[0].as_py() != rows.column(2)[0].as_py()
            yield from _long_list(values, valid, percent, rows.column(9).to_numpy() if across else None)

    late = blocked.mapInArrow(in_pairs, StructType.fromDDL(SHUFFLED))
    every = found.where("size is null").select(*pair).unionByName(late.select(*pair))
    return every.groupBy("x", "y").agg(F.count("*").alias("matches"), F.min("need").alias("need")).where("matches >= need").select("x", "y")


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set signatures that are similar."""
    asked = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(sets.select("sig", "first"), "sig")
    texts = compressed(docs, asked).dropDuplicates(["sig"])
    one, two = (texts.select(F.col("sig").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[_read(t, words) for t in batch.column(c).to_pylist()] for c in (2, 3)]
            good = [alike(len(np.intersect1d(x, y, True)), len(x), len(y), percent) for x, y in zip(*found)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return cut_lineage(bounded(joined).mapInArrow(run, "a binary, b binary"))


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: the smallest id that a document reaches over links."""
    made = described(docs, words)
    every = made.where("slice is null").drop("slice", "counts")
    table = count_table(made.where("slice is not null"))
    sets = cut_lineage(every.where("n > 0").groupBy("sig").agg(
        F.min(F.struct("doc_id", "h")).alias("first"), F.min("doc_id").alias("least"), F.any_value("n").alias("n"),
        F.any_value("anchors").alias("anchors"),
    ))
    lists = anchored(sets, percent)
    links = linked_in_lists(docs, lists, words, percent)
    groups = cut_lineage(components(links))

    node: Column = F.xxhash64("sig")
    anchors = lists.groupBy("sig").agg(F.collect_set("anchor").alias("kept"))
    known = sets.select("sig", "first").join(anchors, "sig", "left").join(groups.withColumnRenamed("node", "sig"), "sig", "left")
    known = known.select("sig", "first", node.alias("node"), F.xxhash64("component").alias("hashed"), "component", *[F.get("kept", F.lit(n)).alias(c) for n, c in enumerate("xyz")])
    known = cut_lineage(known.withColumn("part", F.when(F.col("component").isNotNull(), F.col("hashed"))))
    held = prefixes(docs, table, words, percent)
    same = F.col("id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.h"))
    entries = held.join(known, same).dropDuplicates(["sig"]).select(F.explode("prefix").alias("token"), "node", "part", "x", "y", "z", "size")
    pairs = matched(entries, percent)
    named = known.select("sig", "node")
    pairs = pairs.join(named.toDF("a", "x"), "x").join(named.toDF("b", "y"), "y").select("a", "b")
    pairs = cut_lineage(pairs)
    if not pairs.isEmpty():
        more = verified(docs, pairs, sets, words, percent)
        if not more.isEmpty():
            groups = components(more.unionByName(links))
    joined = cut_lineage(sets.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least", F.coalesce("component", "sig").alias("component")))
    best = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(best, "component").select("sig", "component_id")
    result = every.join(named, "sig", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

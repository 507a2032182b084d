"""Removal of passages that occur earlier, by automata over recurring phrases.

A window of ``size`` words goes if its words also start earlier: in a document
with a smaller id, or before it in the same document. Windows are dealt out over
anchors (see ``phrases``), which meet in the shuffle instead of the windows:

1. anchors that occur once are dropped; of the others, an occurrence whose whole
   context (all windows of that anchor there) is an exact repeat is covered;
2. the first occurrence of each context, where an anchor has several contexts,
   is sent on with its words. In shards of anchors, phrases that recur between
   contexts are confirmed word by word and compiled into an Aho-Corasick
   automaton, and all contexts of the shard stream through it, which locates
   every occurrence. An anchor with very many contexts is spread over several
   shards; the first places of its phrases are aggregated beforehand;
3. located windows that are not the first of their phrase are covered, and each
   document drops its covered words.

Contexts are compared by two 64-bit hashes, phrases by their words. A null text
has no words. A null id sorts before all others. Rows that share an id are one
document in the order of word numbers: a window there goes if one of them has it
at an earlier number. Rows equal in id and text are treated alike. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.batches import bounded, map_batches
from millrace.llm.phrases import Windows, mixed, split
from millrace.session import scratch_path

SIZE = 20
ANCHOR = 4
#: Contexts of one anchor that go to one shard.
BLOCK = 16_000
#: Contexts whose phrases share an automaton.
SHARD = 4000


#: The same in both forms: 31 bits of the text's hash.
TAG_BITS = 31
MASK = (1 << TAG_BITS) - 1
TAG = f"cast(xxhash64(coalesce(text, '')) & {MASK} as int)"


def tag_of(text: str | None) -> int:
    """Tells rows of one id with different texts apart."""
    return xxhash.xxh64_intdigest(text or "", 42) & MASK


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def occurrences(df: DataFrame, size: int, anchor: int) -> DataFrame:
    """(repeat, a, c, doc_id, place): each anchor of each text, its context, and word number and text tag in one long.

    Of the occurrences of a context within a batch all but the first are marked
    as repeats already, with a scattered key in place of the anchor, so that a
    very frequent passage sends one row per batch to the task of its anchor.
    """

    def work(batch: pa.RecordBatch) -> dict:
        rows, anchors, contexts, places = [], [], [], []
        for at, text in enumerate(batch.column(1)):
            text = text.as_py()
            found = Windows(split(text), size, anchor)
            if len(found.at):
                rows.append(np.full(len(found.at), at))
                anchors.append(found.anchors)
                contexts.append(found.contexts)
                places.append((found.at << TAG_BITS) + tag_of(text))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        row, a, c, place = map(join, (rows, anchors, contexts, places))
        ids = batch.column(0)
        rank = np.empty(len(ids), np.int64)
        sorted_ids = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        again = pc.equal(ids.take(pa.array(sorted_ids[1:])), ids.take(pa.array(sorted_ids[:-1]))).fill_null(True)
        rank[sorted_ids] = np.concatenate([[0], np.cumsum(~again.to_numpy(zero_copy_only=False))])
        order = np.lexsort((place, rank[row], c, a))
        row, a, c, place = row[order], a[order], c[order], place[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        repeat = (rank[row] != rank[row[first]]) | (place >> TAG_BITS != place[first] >> TAG_BITS)
        a = np.where(repeat, mixed((place ^ c).view(np.uint64)).view(np.int64), a)
        return {"repeat": repeat, "a": a, "c": c, "doc_id": ids.take(pa.array(row)), "place": place}

    return map_batches(df, work, f"repeat boolean, a long, c long, doc_id {_kind(df)}, place long")


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def marks(df: DataFrame, size: int, anchor: int) -> DataFrame:
    """Per id and text: anchors whose windows are covered, and those whose windows must be compared.

    The occurrences pass a task in the order of anchor, context, document and
    word; it remembers one row of them, however many there are.
    """
    found = occurrences(df, size, anchor)
    order = ["repeat", "a", "c", "doc_id", "place"]
    schema = StructType.fromDDL(f"doc_id {_kind(df)}, place long, compare boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first occurrence of the last context, and whether it is the only one of its anchor so far
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            repeat, a, c, place = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("repeat", "a", "c", "place"))
            ids = batch.column("doc_id")
            new_a = np.ones(len(a), bool)
            new_a[1:] = (a[1:] != a[:-1]) | (repeat[1:] != repeat[:-1])
            new_c = new_a.copy()
            new_c[1:] |= c[1:] != c[:-1]
            if held is not None:
                new_a[0] = held[1]
            first = np.maximum.accumulate(np.where(new_c, np.arange(len(a)), 0))
            same_id = pc.equal(ids, ids.take(pa.array(first)))
            same_id = pc.if_else(same_id.is_null(), pc.and_(ids.is_null(), ids.take(pa.array(first)).is_null()), same_id)
            is_first = same_id.to_numpy(zero_copy_only=False) & (place >> TAG_BITS == place[first] >> TAG_BITS) & ~repeat
            heads = np.flatnonzero(new_c & ~repeat)
            several = ~new_a[heads]
            several[:-1] |= ~new_a[heads[1:]]
            compare = np.zeros(len(a), bool)
            compare[heads[several]] = True
            compare |= is_first & ~new_c  # a second row of the same id and number
            if held is not None and not held[1]:
                compare[0] = False  # marked with the batch before
            keep = compare | ~is_first
            if len(heads):
                held = (batch.slice(int(heads[-1]), 1), not several[-1])
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(keep)), pa.array(place[keep]), pa.array(compare[keep])], names=schema.names
            )

    dealt = found.repartition("a").sortWithinPartitions(*order)
    marked = dealt.mapInArrow(run, schema)
    number, tag = F.shiftright("place", TAG_BITS).cast("int"), F.col("place").bitwiseAND(MASK).cast("int")
    split_ = lambda wanted: F.collect_list(F.when(wanted, number))
    return marked.groupBy("doc_id", tag.alias("tag")).agg(
        split_(~F.col("compare")).alias("repeats"), split_(F.col("compare")).alias("compare")
    )


def covered_words(count: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``count`` words lie in a window that begins at one of ``starts``."""
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + size, -1)
    return np.cumsum(steps)[:-1] > 0


def packed(df: DataFrame, extra: list[str]) -> DataFrame:
    """(doc_id, tag, z, extra): texts compressed for the way through the shuffle; a null text is empty."""

    def work(batch: pa.RecordBatch) -> dict:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        texts = [(t.as_py() or "").encode() for t in batch.column(1)]
        kept = {c: batch.column(c) for c in extra}
        return {"doc_id": batch.column(0), "tag": batch.column(2), "z": [squeeze(t) for t in texts], **kept}

    rows = df.select("doc_id", "text", F.expr(TAG).alias("tag"), *extra)
    return map_batches(rows, work, f"doc_id {_kind(df)}, tag int, z binary" + _types(df, extra))


def _types(df: DataFrame, columns: list[str]) -> str:
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def with_lists(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """``texts`` with the columns of ``lists`` for the same id and text, null where there are none."""
    m = lists.withColumnsRenamed({"doc_id": "m_id", "tag": "m_tag"})
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tag") == F.col("m_tag"))
    return texts.join(m, same, "left").drop("m_id", "m_tag")


def _result(text: bytes, words: list[bytes], starts: np.ndarray, size: int, digest: bool) -> tuple[int, int, bytes]:
    """Word count, number removed, and the kept words or their SHA-256; without a digest an untouched text stays as it is."""
    if not len(starts) and not digest:
        return len(words), 0, text
    if len(starts):
        gone = covered_words(len(words), starts, size)
        left = [w for w, g in zip(words, gone.tolist()) if not g]
    else:
        left = words
    kept = b" ".join(left)
    return len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest().encode() if digest else kept


def first_pass(df: DataFrame, marked: DataFrame, size: int, anchor: int, digest: bool, extra: list[str]) -> DataFrame:
    """The result of documents whose covered windows are all known; of others their contexts to be compared.

    ``z`` holds the result (plain for a digest, else compressed) or the text of a document that waits.
    """
    joined = with_lists(packed(df, extra), marked).select("doc_id", "tag", "z", "repeats", "compare", *extra)
    context = "array<struct<a: long, start: int, words: string>>"
    schema = f"doc_id {_kind(df)}, tag int, n_words long, n_removed long, z binary, covered binary, open {context}" + _types(df, extra)

    def work(batch: pa.RecordBatch) -> dict:
        read, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        out = {n: [] for n in ("n_words", "n_removed", "z", "covered", "open")}
        for z, repeats, compare in zip(*(batch.column(i) for i in (2, 3, 4))):
            z, repeats, compare = z.as_py(), repeats.as_py(), compare.as_py()
            text = read(z)
            words, starts, more = text.split(), np.zeros(0, np.int64), []
            if repeats or compare:
                found = Windows(words, size, anchor)
                runs = np.searchsorted(found.at, np.array(repeats, np.int64))
                if len(runs):
                    starts = np.concatenate([np.arange(found.first[r], found.last[r] + 1) for r in runs])
                for run in np.searchsorted(found.at, np.array(compare, np.int64)).tolist():
                    first, last = int(found.first[run]), int(found.last[run])
                    line = b" ".join(words[first : last + size]).decode()
                    more.append({"a": int(found.anchors[run]), "start": first, "words": line})
            if more:
                made = (None, None, z)
            else:
                *made, kept = _result(text, words, starts, size, digest)
                made.append(kept if digest else squeeze(kept))
            for name, value in zip(("n_words", "n_removed", "z"), made):
                out[name].append(value)
            out["covered"].append(zstandard.compress(starts.astype("<i4").tobytes()) if more else None)
            out["open"].append(more)
        return {"doc_id": batch.column(0), "tag": batch.column(1), **out, **{c: batch.column(c) for c in extra}}

    return map_batches(joined, work, schema)


def located(contexts: DataFrame, size: int) -> DataFrame:
    """(doc_id, tag, starts): windows of the contexts that are not the first of their phrase.

    ``known`` of a context lists the first places of its recurring phrases, where
    the anchor is spread over shards; elsewhere the shard holds all contexts.
    """
    columns = ["a", "salt", "doc_id", "tag", "start", "words", "known"]
    rows = contexts.select(*columns).repartition("a", "salt").sortWithinPartitions("a", "salt", "doc_id", "start")
    schema = StructType.fromDDL(f"doc_id {_kind(contexts)}, tag int, starts array<int>")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            if len(held) >= SHARD:  # whole shards only: the last anchor may go on
                key = (held[-1]["a"], held[-1]["salt"])
                whole = [r for r in held if (r["a"], r["salt"]) != key]
                yield pa.RecordBatch.from_pylist(list(_locate(whole, size)), target)
                held = held[len(whole) :]
        yield pa.RecordBatch.from_pylist(list(_locate(held, size)), target)

    return bounded(rows).mapInArrow(run, schema)


def _locate(rows: list[dict], size: int) -> Iterator[dict]:
    """Confirm the recurring phrases of these contexts, compile them, and stream the contexts through."""
    firsts: dict[str, tuple] = {}
    often: dict[str, tuple] = {}
    bounds = []
    for row in rows:
        words = row["words"].split(" ")
        ends = np.cumsum([len(w) + 1 for w in words])  # of each word in " w w w "
        starts = [0, *ends.tolist()]
        bounds.append(starts)
        line = f" {row['words']} "
        if row["known"] is None:
            for n in range(len(words) - size + 1):
                phrase, place = line[starts[n] : starts[n + size] + 1], (row["doc_id"], row["start"] + n)
                if firsts.setdefault(phrase, place) != place:
                    often[phrase] = firsts[phrase]
        else:
            for hit in row["known"]:
                n = hit["n"]
                often[line[starts[n] : starts[n + size] + 1]] = (hit["doc_id"], hit["at"])
    if not often:
        return
    automaton = ahocorasick.Automaton()
    for phrase, place in often.items():
        automaton.add_word(phrase, (len(phrase), place))
    automaton.make_automaton()
    for row, starts in zip(rows, bounds):
        number = {at: n for n, at in enumerate(starts)}
        places = []
        for end, (length, first) in automaton.iter(f" {row['words']} "):
            start = row["start"] + number[end + 1 - length]
            if first != (row["doc_id"], start):
                places.append(start)
        if places:
            yield {"doc_id": row["doc_id"], "tag": row["tag"], "starts": places}


def phrase_hashes(contexts: DataFrame, size: int) -> DataFrame:
    """(a, doc_id, tag, start, n, h): the hash of each window of each context."""

    def work(batch: pa.RecordBatch) -> dict:
        rows, numbers, found = [], [], []
        for at, line in enumerate(batch.column(4).to_pylist()):
            words = line.encode().split(b" ")
            count = len(words) - size + 1
            rows.append(np.full(count, at))
            numbers.append(np.arange(count))
            found.append(Windows(words, size, size).hashes(np.arange(count)))
        taken = pa.array(np.concatenate(rows))
        kept = {n: batch.column(n).take(taken) for n in ("a", "doc_id", "tag", "start")}
        return {**kept, "n": np.concatenate(numbers).astype(np.int32), "h": np.concatenate(found)}

    schema = f"a long, doc_id {_kind(contexts)}, tag int, start int, n int, h long"
    return map_batches(contexts.select("a", "doc_id", "tag", "start", "words"), work, schema)


def compared(passed: DataFrame, size: int) -> DataFrame:
    """(doc_id, tag, starts) over all contexts that ``first_pass`` left open."""
    contexts = passed.select("doc_id", "tag", F.explode("open").alias("o")).select("doc_id", "tag", "o.*")
    sizes = contexts.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shards"))
    sizes = sizes.where("shards > 1").withColumnRenamed("a", "hot_a")
    contexts = contexts.join(sizes, F.col("a") == F.col("hot_a"), "left")
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.coalesce("shards", F.lit(1))).cast("int")
    contexts = contexts.withColumn("salt", salt)
    hot = contexts.where("shards is not null")
    windows = phrase_hashes(hot, size)
    place = F.struct("doc_id", (F.col("start") + F.col("n")).alias("at"))
    firsts = windows.groupBy("a", "h").agg(F.min(place).alias("f"), F.count("*").alias("times")).where("times > 1")
    known = windows.join(firsts.select("a", "h", "f"), ["a", "h"])
    hits = F.collect_list(F.struct("n", F.col("f.doc_id").alias("doc_id"), F.col("f.at").alias("at")))
    keys = ("a", "doc_id", "tag", "start")
    known = known.groupBy(*keys).agg(hits.alias("known")).withColumnsRenamed({k: f"k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    hot = hot.join(known, same[0] & same[1] & same[2] & same[3])
    nothing = F.lit(None).cast(hot.schema["known"].dataType)
    columns = ["a", "salt", "doc_id", "tag", "start", "words", "known"]
    rare = contexts.where("shards is null").withColumn("known", nothing)
    return located(rare.select(*columns).unionByName(hot.select(*columns)), size)


def deduplicate(df: DataFrame, size: int = SIZE, anchor: int = ANCHOR, digest: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, extra): ``kept`` is the text, or where words went the others, joined by single spaces.

    With ``digest`` it is the SHA-256 of the words that stay, so joined, and no texts are written.
    ``extra`` names columns of ``df`` that are carried along.
    """
    extra = list(extra)
    documents = df.select("doc_id", "text", *extra)
    passed = staged(first_pass(documents, marks(documents.select("doc_id", "text"), size, anchor), size, anchor, digest, extra), "passages")
    more = compared(passed, size).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    columns = ["doc_id", "n_words", "n_removed", "z", "covered", "starts", *extra]
    waiting = with_lists(passed.where("covered is not null"), more).select(*columns)
    done = passed.where("covered is null").withColumn("starts", F.lit(None).cast("array<int>")).select(*columns)
    schema = f"doc_id {_kind(df)}, n_words long, n_removed long, kept string" + _types(df, extra)

    def work(batch: pa.RecordBatch) -> dict:
        read = zstandard.ZstdDecompressor().decompress
        rows = []
        for number, removed, z, covered, starts in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
            if covered is None:
                rows.append((number, removed, (z if digest else read(z)).decode()))
                continue
            places = np.concatenate([np.frombuffer(read(covered), "<i4"), np.array(starts or [], np.int32)]).astype(np.int64)
            text = read(z)
            *counts, kept = _result(text, text.split(), places, size, digest)
            rows.append((*counts, kept.decode()))
        columns = dict(zip(("n_words", "n_removed", "kept"), map(list, zip(*rows))))
        return {"doc_id": batch.column(0), **columns, **{c: batch.column(c) for c in extra}}

    return map_batches(done.unionByName(waiting), work, schema)

"""Language model scores by a hierarchical Pitman-Yor model over the bytes of words.

A text is its lower-cased words, each followed by a space, and one end sign.
Every context of up to five preceding bytes is a restaurant whose dishes are the
next byte; a restaurant shares its parent with all contexts that end alike. Each
Gibbs sweep takes the customers of a dish away and seats them again, given the
tables of the other dishes and the parent's current probabilities; the tables
are the parent's customers. Probabilities are averaged over the sweeps after a
burn-in. A token's probability is the product over its bytes, so those of all
words sum to one.

Counts cover all learned texts and meet in the shuffle, after each task has
summed its own. Restaurants with two bytes or more of context form subtrees that
never look into each other and are seated in parallel; the two levels above have
at most 65,536 dishes and are seated on the driver. Texts are scored in chunks
by a hash of the row, and each chunk fetches only the entries it needs.

A null text counts as empty and scores its end sign. Repeated rows score alike.
Where nothing is learned the model is uniform over bytes. Rows without a flag
are not learned. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.batches import bounded, map_batches, pieces, release
from millrace.llm.substrings import staged

ORDER = 5  # bytes of context
DISCOUNTS = (0.3, 0.3, 0.6, 0.65, 0.7, 0.75)  # by length of the context
STRENGTH = 1.0
SWEEPS, BURN_IN = 5, 2
SEED = 7
#: Entries that are seated together in a task; a subtree is never cut.
BLOCK_ROWS = 200_000
#: Characters of text per scoring chunk, on average.
CHUNK_CHARS = 20_000_000
#: Characters whose places are held in work arrays at a time.
STEP = 500_000
#: Probabilities travel as whole numbers of this part of a decimal digit, which pack well.
PARTS = 10_000_000
PAD = b"\n" * ORDER
GRAM, WORD, UNLEARNED = 0, 1, 2
#: Distinct entries that a task holds before it sends them.
MOST_HELD = 4_000_000


def tokens(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode()).lower().split()


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of each place of each text as one number, and where each text begins among them."""
    streams = [b" ".join([*words, b"\n"]) if words else b"\n" for words in texts]
    sizes = np.array([len(s) for s in streams], np.int64)
    data = np.frombuffer(b"".join([x for s in streams for x in (PAD, s)]), np.uint8).astype(np.int64)
    keys = np.zeros(len(data) - ORDER, np.int64)
    for back in range(ORDER + 1):
        keys |= data[ORDER - back : len(data) - back] << (8 * back)
    ends = np.cumsum(sizes + ORDER)
    own = np.ones(len(data), bool)
    begin = ends - sizes - ORDER
    for n in range(ORDER):  # the padding before each text
        own[begin + n] = False
    return keys[own[ORDER:]], np.cumsum(sizes) - sizes


def places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each of ``keys`` in the ascending ``table``; each distinct one is looked up once, in order."""
    distinct, at = np.unique(keys, return_inverse=True)
    return np.searchsorted(table, distinct)[at]


def hashes(words: Collection[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words)).view(np.int64)


def counts(df: DataFrame) -> DataFrame:
    """(kind, key, n): bytes in context of all texts, with their learned number, and learned words."""

    names, kinds = ["kind", "key", "n"], (GRAM, WORD, UNLEARNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Tally() for _ in kinds]
        for batch in batches:
            for flag in (True, False):
                some = [t.as_py() for t, f in zip(batch.column(0), batch.column(1)) if bool(f.as_py()) == flag]
                for a, b in pieces(some, STEP):
                    split = [tokens(t) for t in some[a:b]]
                    tallies[0 if flag else 2].add(grams(split)[0])
                    if flag:
                        tallies[1].add(hashes([w for s in split for w in s]))
            if sum(map(len, tallies)) > MOST_HELD:
                yield from flush(tallies)
                tallies = [Tally() for _ in kinds]
        yield from flush(tallies)

    def flush(tallies: list[Tally]) -> Iterator[pa.RecordBatch]:
        for kind, tally in zip(kinds, tallies):
            keys, counts = tally.total()
            if kind == UNLEARNED:
                kind, counts = GRAM, np.zeros_like(counts)
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                columns = [np.full(len(part), kind, np.int32), part, counts[at : at + 100_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    rows = bounded(df.select("text", "learn")).mapInArrow(run, StructType.fromDDL("kind int, key long, n long"))
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Tally:
    """Distinct numbers and how often they came; merged whenever ``STEP`` have gathered."""

    def __init__(self):
        self.keys, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        if sum(map(len, self.keys[1:])) >= STEP:
            self.total()

    def __len__(self) -> int:
        return sum(map(len, self.keys))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            self.keys = [keys[first]]
            self.counts = [np.add.reduceat(counts, first) if len(first) else counts]
        return self.keys[0], self.counts[0]


def reseat(rng, customers, others, parent, discount) -> np.ndarray:
    """Tables of each dish after its customers were seated anew.

    ``others`` are the tables of the other dishes there. Customers come one by
    one at first, later in groups of an eighth of those already seated.
    """
    tables = (customers > 0).astype(np.float64)
    seated = tables.copy()
    active = np.flatnonzero(customers > 1)
    while len(active):
        t, s = tables[active], seated[active]
        step = np.minimum(np.maximum(1, s // 8), customers[active] - s)
        new = (STRENGTH + discount * (others[active] + t)) * parent[active]
        tables[active] = t + rng.binomial(step.astype(np.int64), new / (new + np.maximum(s - discount * t, 1e-9)))
        seated[active] = s + step
        active = active[s + step < customers[active]]
    return tables


class Restaurants:
    """The levels ``top`` to ``bottom`` (length of context) of some subtrees."""

    def __init__(self, keys: np.ndarray, learned: np.ndarray, top: int, bottom: int):
        self.levels = []
        for depth in range(bottom, top - 1, -1):
            contexts, context = np.unique(keys >> 8, return_inverse=True)
            level = {"depth": depth, "keys": keys, "context": context, "contexts": len(contexts)}
            if depth > top:
                keys, level["parent"] = np.unique(keys & ((1 << (8 * depth)) - 1), return_inverse=True)
            self.levels.append(level)
        self.customers(0, learned.astype(np.float64))
        for n, level in enumerate(self.levels):
            level["tables"] = np.minimum(level["customers"], 1)
            if n + 1 < len(self.levels):
                self.customers(n + 1, np.bincount(level["parent"], level["tables"], len(self.levels[n + 1]["keys"])))

    def customers(self, n: int, found: np.ndarray) -> None:
        level = self.levels[n]
        level["customers"] = found
        level["held"] = np.bincount(level["context"], found, level["contexts"])

    def _tables_there(self, level: dict) -> np.ndarray:
        return np.bincount(level["context"], level["tables"], level["contexts"])[level["context"]]

    def predict(self, base: np.ndarray) -> None:
        """Probability of each dish in each restaurant, from ``base`` at the top downwards."""
        for level in reversed(self.levels):
            level["base"] = base
            discount = DISCOUNTS[level["depth"]]
            fresh = (STRENGTH + discount * self._tables_there(level)) * base
            known = np.maximum(level["customers"] - discount * level["tables"], 0)
            level["p"] = (known + fresh) / (STRENGTH + level["held"][level["context"]])
            at = self.levels.index(level)
            base = level["p"][self.levels[at - 1]["parent"]] if at else None

    def sweep(self, rng, base: np.ndarray) -> None:
        self.predict(base)
        for n, level in enumerate(self.levels):
            others = self._tables_there(level) - level["tables"]
            level["tables"] = reseat(rng, level["customers"], others, level["base"], DISCOUNTS[level["depth"]])
            if n + 1 < len(self.levels):
                self.customers(n + 1, np.bincount(level["parent"], level["tables"], len(self.levels[n + 1]["keys"])))

    def sample(self, rng, base: np.ndarray) -> np.ndarray:
        """Probabilities of the longest contexts, averaged over the sweeps after the burn-in."""
        total = np.zeros(len(self.levels[0]["keys"]))
        for number in range(SWEEPS):
            self.sweep(rng, base)
            if number >= BURN_IN:
                self.predict(base)
                total += self.levels[0]["p"]
        return total / (SWEEPS - BURN_IN)


def _subtrees(rows: DataFrame, schema: str, work) -> DataFrame:
    """Apply ``work(keys, learned)`` to whole subtrees; rows of one lie together in a sorted partition."""
    subtree = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    dealt = rows.select(subtree.alias("subtree"), "key", "n").repartition("subtree").sortWithinPartitions("subtree", "key")
    made = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, 3), np.int64)]
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1))
            if sum(map(len, held)) >= BLOCK_ROWS:
                rows = np.concatenate(held)
                cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                if cut:
                    yield from batch_of(rows[:cut])
                held = [rows[cut:]]
        rows = np.concatenate(held)
        if len(rows):
            yield from batch_of(rows)

    def batch_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = work(rows[:, 1], rows[:, 2])
        for at in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=made.names)

    return dealt.mapInArrow(run, made)


@dataclass
class Model:
    """``entries``: (kind, key, value), the log of a byte's probability in its context (in ``PARTS``) or a word's count."""

    entries: DataFrame
    learned_tokens: int
    learned_types: int
    learned_texts: int


def train(df: DataFrame) -> Model:
    """Learn from rows of ``df`` (text, learn); its other texts only say which probabilities will be asked for."""
    found = staged(counts(df), "counts")
    ends = df.where("learn").count()
    words = found.where(F.col("kind") == WORD)
    row = words.agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).first()
    bytes_ = found.where(F.col("kind") == GRAM)
    low = 1 << 16

    def tables(keys: np.ndarray, learned: np.ndarray) -> list[np.ndarray]:
        rooms = Restaurants(keys, learned, 2, ORDER)
        rng, base = np.random.default_rng([SEED, 0, int(keys[0] >> 8 & 0xFFFF)]), None
        base = np.full(len(rooms.levels[-1]["keys"]), 1 / 256)
        for _ in range(BURN_IN):
            rooms.sweep(rng, base)
        top = rooms.levels[-1]
        return [top["keys"] & (low - 1), top["tables"].astype(np.int64)]

    # At most 65,536 rows: one for each pair of bytes.
    upper = _subtrees(bytes_, "key long, n long", tables).groupBy("key").agg(F.sum("n").alias("n")).collect()
    guess = np.full(low, 1 / 256)
    if upper:
        pairs = np.array(sorted((r["key"], r["n"]) for r in upper), np.int64)
        rooms = Restaurants(pairs[:, 0], pairs[:, 1], 0, 1)
        guess[pairs[:, 0]] = rooms.sample(np.random.default_rng([SEED, 1]), np.full(len(rooms.levels[-1]["keys"]), 1 / 256))

    def probabilities(keys: np.ndarray, learned: np.ndarray) -> list[np.ndarray]:
        rooms = Restaurants(keys, learned, 2, ORDER)
        rng = np.random.default_rng([SEED, 2, int(keys[0] >> 8 & 0xFFFF)])
        found = rooms.sample(rng, guess[rooms.levels[-1]["keys"] & (low - 1)])
        return [keys, np.rint(-PARTS * np.log10(found)).astype(np.int64)]

    model = _subtrees(bytes_, "key long, value long", probabilities).select(F.lit(GRAM).alias("kind"), "key", "value")
    entries = staged(model, "model").unionByName(words.select("kind", "key", F.col("n").alias("value")))
    return Model(entries, (row["tokens"] or 0) + ends, row["types"] + (ends > 0), ends)


def score(df: DataFrame, model: Model) -> DataFrame:
    """``df`` (doc_id, text, held_out) with n_tokens, n_known, train_tokens, base_score and score in place of the text.

    All its texts must have been in the table that ``train`` saw.
    """
    total = df.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, total // CHUNK_CHARS)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    # As many partitions as a shuffle has at least, so that the second side is dealt to them too.
    dealt = max(chunks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind_of_id = df.schema["doc_id"].dataType.simpleString()

    def squeezed(batch: pa.RecordBatch) -> dict:
        press = zstandard.ZstdCompressor(level=1).compress
        return {
            "doc_id": batch.column(0), "held_out": batch.column(1), "chunk": batch.column(2),
            "z": [press((t.as_py() or "").encode()) for t in batch.column(3)],
        }

    small = map_batches(
        df.select("doc_id", "held_out", chunk.alias("chunk"), "text"), squeezed,
        f"doc_id {kind_of_id}, held_out boolean, chunk int, z binary",
    )
    texts = small.repartition(dealt, "chunk")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor().decompress
        held: dict[int, tuple[Tally, Tally]] = {}
        for batch in batches:
            chunk_of = batch.column(2).to_numpy()
            for number in np.unique(chunk_of).tolist():
                some = [read(batch.column(3)[i].as_py()) for i in np.flatnonzero(chunk_of == number).tolist()]
                found, words = held.setdefault(number, (Tally(), Tally()))
                for a, b in pieces(some, STEP):
                    split = [tokens(t) for t in some[a:b]]
                    found.add(grams(split)[0])
                    words.add(hashes({w for s in split for w in s}))
            if sum(len(t) for both in held.values() for t in both) > MOST_HELD:
                yield from ask(held)
                held = {}
        yield from ask(held)

    def ask(held: dict[int, tuple[Tally, Tally]]) -> Iterator[pa.RecordBatch]:
        for number, both in held.items():
            for kind, tally in zip((GRAM, WORD), both):
                keys = tally.total()[0]
                for at in range(0, len(keys), 100_000):
                    part = keys[at : at + 100_000]
                    columns = [np.full(len(part), number, np.int32), np.full(len(part), kind, np.int32), part]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "kind", "key"])

    # All columns of texts, so that one shuffle of them serves both sides.
    asked = texts.mapInArrow(wanted, StructType.fromDDL("chunk int, kind int, key long"))
    fetched = asked.join(model.entries, ["kind", "key"]).select("chunk", "kind", "key", "value")
    size, learned = model.learned_tokens, model.learned_texts
    floor = size + model.learned_types + 1
    schema = (
        f"doc_id {kind_of_id}, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double"
    )

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        kind = right.column("kind").to_numpy()
        for n in (GRAM, WORD):
            keys, values = right.column("key").to_numpy()[kind == n], right.column("value").to_numpy()[kind == n]
            keys, first = np.unique(keys, return_index=True)
            tables.append((keys, values[first]))
        (keys, chances), (words_known, word_counts) = tables
        logs, words_known = chances / -PARTS, pd.Index(words_known)
        read = zstandard.ZstdDecompressor().decompress
        rows = [read(z.as_py()) for z in left.column("z")]
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for a, b in pieces(rows, STEP):
            split = [tokens(t) for t in rows[a:b]]
            found, begin = grams(split)
            out["score"] += np.add.reduceat(logs[places(keys, found)], begin).tolist()
            sizes = np.array([len(s) for s in split])
            asked_words = hashes([w for s in split for w in s])
            at = words_known.get_indexer(asked_words)
            seen = np.where(at >= 0, word_counts[at], 0.0) if len(words_known) else np.zeros(len(at))
            of = np.repeat(np.arange(len(split)), sizes)
            base = np.bincount(of, np.log10((seen + 1) / floor), len(split)) + np.log10((learned + 1) / floor)
            out["base_score"] += base.tolist()
            out["n_known"] += (np.bincount(of, seen > 0, len(split)).astype(np.int64) + (learned > 0)).tolist()
            out["n_tokens"] += (sizes + 1).tolist()
        columns = [left.column("doc_id"), left.column("held_out"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64())]
        columns += [pa.array([size] * len(rows), pa.int64()), pa.array(out["base_score"]), pa.array(out["score"])]
        release()
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.groupBy("chunk").cogroup(fetched.groupBy("chunk")).applyInArrow(judge, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens and perplexity per token of scored texts."""
    per_token = -F.sum("score") / F.sum("n_tokens")
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.pow(F.lit(10.0), per_token).alias("perplexity"))

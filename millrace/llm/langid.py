"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled sample reads a text from left to
right and cuts it into phrases, each the longest match that the sample holds (a
symbol that it lacks joins the phrase after it).
Phrases times the bits that one of them costs, over the symbols read, estimates
the cross entropy; the language with the least wins. Texts are read whole, in
stretches of ``STRETCH`` symbols that run through the automata side by side.

A null text, or one without letters, is ``und`` with score 0. Ties go to the
language that sorts first. Case is folded; all but letters count as one space.
Repeated rows are judged alike. With nothing to learn from every text is
``und``. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from millrace.llm.batches import bounded, kept, pieces, release

UNKNOWN = "und"
#: Symbols of a text that are parsed in one go; every text is cut alike.
STRETCH = 512


@dataclass(frozen=True)
class Samples:
    """The labelled sample per language: (language, text), sorted by language."""

    texts: tuple[tuple[str, str], ...]


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = 64, chars: int = 800) -> Samples:
    """A sample of at most ``rows`` labelled rows per language, ``chars`` characters from the middle of each.

    The bound is what keeps the automata small enough for every worker. Rows are
    chosen by the hash of their text, so the sample follows from the rows alone;
    copies of a text count once. Rows without text or label are left out.
    """
    return _samples({k: v[:rows] for k, v in _drawn(df, text_col, lang_col, rows, chars).items()})


def learn_with_bits(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = 64, chars: int = 800
) -> tuple[Samples, dict[str, float]]:
    """``learn``, and the bits a symbol of each language's texts: the median over texts that its sample lacks.

    Those are the texts drawn beyond ``rows``. A language with fewer than eight of
    them judges each quarter of its sample by the rest of it; one with a single
    text is left out.
    """
    drawn = _drawn(df, text_col, lang_col, rows, chars)
    samples = _samples({k: v[:rows] for k, v in drawn.items()})
    typical = {}
    for lang, texts in drawn.items():
        sides = [(texts[:rows], texts[rows:])]
        if len(texts) < rows + 8:
            own = texts[:rows]
            sides = [([t for i, t in enumerate(own) if i % 4 != n], own[n::4]) for n in range(4)]
        costs = [c for known, held in sides if known and held for c in Automata(_samples({lang: known})).judge(held)[2] if c is not None]
        if costs:
            typical[lang] = float(np.median(costs))
    return samples, typical


def _samples(texts: dict[str, list[str]]) -> Samples:
    return Samples(tuple((k, " ".join(v)) for k, v in sorted(texts.items())))


def _drawn(df: DataFrame, text_col: str, lang_col: str, rows: int, chars: int) -> dict[str, list[str]]:
    """About twice ``rows`` distinct texts per language, or all of fewer, by the hash of the text."""
    labelled = df.where(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    labelled = labelled.withColumn("at", F.xxhash64("text").bitwiseAND((1 << 62) - 1))
    texts = labelled.select("lang", "at").distinct()
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # Twice the rows wanted pass on average; a language with few texts passes whole.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 62) * min(1.0, 2 * rows / n)))])
    middle = F.greatest(F.lit(1), (F.length("text") - chars) / 2).cast("int")
    some = labelled.where(F.col("at") <= share[F.col("lang")]).select("lang", "at", F.substring("text", middle, F.lit(chars)).alias("text"))
    found: dict[str, dict[int, str]] = {}
    for row in some.distinct().collect():
        found.setdefault(row["lang"], {})[row["at"]] = row["text"]
    return {k: [t for _, t in sorted(v.items())] for k, v in found.items()}


class Automata:
    """Dense transition tables of the suffix automata; bit 0 of an entry tells that a phrase ended."""

    def __init__(self, samples: Samples):
        self.langs = [k for k, _ in samples.texts]
        letters = sorted({c for _, text in samples.texts for c in text.lower() if c.isalpha()})
        self.width = len(letters) + 2  # 0 is the space, the last a letter never seen
        strange = self.width - 1
        self.symbols = np.zeros(0x110000, np.uint8 if self.width < 256 else np.int32)
        lower = {c: i + 1 for i, c in enumerate(letters)}
        for point in range(0x110000):
            letter = chr(point)
            if letter.isalpha():
                self.symbols[point] = lower.get(letter.lower(), strange)
        self.tables, self.bits = [], []
        for _, text in samples.texts:
            symbols = self.read([text])[0].tolist()
            self.tables.append(self._table(symbols))
            self.bits.append(log2(len(symbols) + 1))

    def _table(self, symbols: list[int]) -> np.ndarray:
        steps, link, length, last = [{}], [-1], [0], 0
        for c in symbols:
            if c == self.width - 1:
                last = 0
                continue
            new, at = len(steps), last
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            while at >= 0 and c not in steps[at]:
                steps[at][c] = new
                at = link[at]
            if at >= 0:
                old = steps[at][c]
                if length[at] + 1 == length[old]:
                    link[new] = old
                else:
                    twin = len(steps)
                    steps.append(dict(steps[old]))
                    length.append(length[at] + 1)
                    link.append(link[old])
                    link[old] = link[new] = twin
                    while at >= 0 and steps[at].get(c) == old:
                        steps[at][c] = twin
                        at = link[at]
            last = new
        width, first = self.width, steps[0]
        restart = np.array([(first.get(c, 0) * width) << 1 | 1 for c in range(width)], np.int32)
        table = np.tile(restart, len(steps))
        for at, step in enumerate(steps):
            for c, to in step.items():
                table[at * width + c] = (to * width) << 1
        return table

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, with runs of spaces as one, and the number of each text's."""
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        points = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4")
        made = self.symbols[points]
        space = made == 0
        keep = ~space
        keep[1:] |= ~space[:-1]
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[sizes > 0]
        keep[starts] = ~space[starts]  # no text begins with a space
        kept = np.concatenate([[0], np.cumsum(keep)])
        return made[keep], kept[ends] - kept[ends - sizes]

    def phrases(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Phrases per language and text."""
        lanes = -(-counts // STRETCH)
        owner = np.repeat(np.arange(len(counts)), lanes)
        if not len(owner) or not self.langs:
            return np.zeros((len(self.langs), len(counts)))
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(np.cumsum(counts) - counts, lanes) + nth * STRETCH
        size = np.minimum(counts[owner] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        active = np.searchsorted(-size, -np.arange(STRETCH), side="left")
        state = np.zeros((len(self.langs), len(owner)), np.int32)
        ended = np.ones((len(self.langs), len(owner)), np.int32)
        for i in range(int(size[0])):
            k = active[i]
            read = symbols[start[:k] + i]
            for n, table in enumerate(self.tables):
                found = table[state[n, :k] + read]
                ended[n, :k] += found & 1
                state[n, :k] = found >> 1
        return np.stack([np.bincount(owner, weights=row, minlength=len(counts)) for row in ended])

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and bits a symbol of each text."""
        langs, scores, costs = [], [], []
        for a, b in pieces(texts):
            symbols, counts = self.read(texts[a:b])
            spent = self.phrases(symbols, counts) * np.array(self.bits)[:, None]
            for n, count in enumerate(counts.tolist()):
                if not count or not self.langs:
                    langs.append(UNKNOWN), scores.append(0.0), costs.append(None)
                    continue
                best = int(np.argmin(spent[:, n]))
                others = np.delete(spent[:, n], best)
                langs.append(self.langs[best])
                scores.append(float(1 - spent[best, n] / others.min()) if len(others) else 1.0)
                costs.append(float(spent[best, n] / count))
        return langs, scores, costs


def automata(samples: Samples) -> Automata:
    """One set of automata per worker."""
    return kept(samples, lambda: Automata(samples))


def predict(df: DataFrame, samples: Samples, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (0 to 1: how far the runner-up is behind) and bits (a symbol, null for ``und``).

    Columns of ``df`` with one of these names are replaced.
    """
    added = [("lang_pred", StringType()), ("score", DoubleType()), ("bits", DoubleType())]
    stays = [c for c in df.columns if c not in dict(added)]
    source = df if text_col in stays else df.withColumn("__text", F.col(text_col))
    text_at = text_col if text_col in stays else "__text"
    schema = StructType([df.schema[c] for c in stays])
    for name, kind in added:
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            tool = automata(samples)
            made = tool.judge(batch.column(text_at).to_pylist())
            columns = [batch.column(c) for c in stays]
            columns += [pa.array(made[0], pa.string()), pa.array(made[1], pa.float64()), pa.array(made[2], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*stays, *dict(added)])
        release()

    return bounded(source).mapInArrow(run, schema)

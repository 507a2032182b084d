"""Byte-pair encoding and decoding with the merges of a byte-level tokenizer file.

Encoding follows the backtracking scheme: an Aho-Corasick automaton proposes the
longest token at a place, a pair table says whether two neighbours could both
survive the merges, and a refused token gives way to its next shorter prefix.
Every place and token is tried at most once, so the work is linear in the text.
Decoding gathers bytes through an offset table.

A null text counts as empty and gives no tokens. Repeated rows are encoded each
on its own, other columns are left alone, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.batches import kept, map_batches

#: Below this code point the split pattern means the same in every Unicode version.
STABLE = 0x530
#: Words and pairs remembered by a worker. Only speed depends on it.
REMEMBERED = 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.splitter = regex.compile(PATTERN)
        self.library_splitter = Tokenizer.from_file(path).pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, at in vocab.items():
            spelled[at] = bytes(letters[c] for c in token)
        for token, at in self.special.items():
            spelled[at] = token.encode()
        lengths = np.array([len(s) for s in spelled], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.decimals = [str(i) for i in range(size)]

        self.joined: dict[tuple[int, int], int] = {}
        self.split = {at: None for token, at in vocab.items() if len(token) == 1}
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[left + right]
            self.joined[vocab[left], vocab[right]] = made
            self.split.setdefault(made, (vocab[left], vocab[right]))
        self.size, self.lengths, self.prefixes = size, lengths.tolist(), [None] * size
        self.pairs: dict[int, bool] = {}
        usable = [at for at in self.split if self.split[at] is None or self._survives(*self.split[at], made=at)]
        self.tokens = ahocorasick.Automaton()
        self.by_text = {}
        for at in usable:
            word = spelled[at].decode("latin-1")
            self.by_text[word] = at
            self.tokens.add_word(word, at)
        self.tokens.make_automaton()
        self.spelled = spelled
        self.longest = max(map(len, self.by_text))
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.words: dict[str, bytes | None] = {}
        self.chunks: dict[str, bytes | None] = {}

    def _survives(self, left: int, right: int, made: int | None = None) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side (or join them last, as ``made``)."""
        limit = 1 << 60 if made is None else made
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < limit:
                return False
            if left > right:
                limit = left
                if self.split[left] is None:
                    limit = right + 1
                    if self.split[right] is None:
                        return True
                    right = self.split[right][0]
                else:
                    left = self.split[left][1]
            else:
                limit = right + 1
                if self.split[right] is None:
                    limit = left
                    if self.split[left] is None:
                        return True
                    left = self.split[left][1]
                else:
                    right = self.split[right][0]

    def fits(self, left: int, right: int) -> bool:
        known = self.pairs.get(left * self.size + right)
        if known is None:
            known = self._survives(left, right)
            if len(self.pairs) < REMEMBERED:
                self.pairs[left * self.size + right] = known
        return known

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 for none."""
        found = self.prefixes[token]
        if found is None:
            text, found = self.spelled[token].decode("latin-1"), -1
            for n in range(len(text) - 1, 0, -1):
                if (at := self.by_text.get(text[:n])) is not None:
                    found = at
                    break
            self.prefixes[token] = found
        return found

    def _merge(self, text: str) -> list[int]:
        """Tokens of one split piece, given as one character per byte."""
        fits, known, size, lengths = self.fits, self.pairs.get, self.size, self.lengths
        greedy = [token for _, token in self.tokens.iter_long(text)]
        made, last = [], -1
        for token in greedy:
            if last >= 0 and not (known(last * size + token) or fits(last, token)):
                break
            made.append(token)
            last = token
        else:
            return made
        at, end, dead = sum([lengths[t] for t in made]), len(text), set()
        while at < end:
            stop = at + lengths[token]
            if stop not in dead and (not made or known(made[-1] * size + token) or fits(made[-1], token)):
                made.append(token)
                at = stop
                if at < end:
                    token = next(self.tokens.iter_long(text[at : at + self.longest]))[1]
                continue
            token = self._shorter(token)
            while token < 0:
                dead.add(at)
                token = made.pop()
                at -= lengths[token]
                token = self._shorter(token)
        return made

    def _bytes(self, word: str) -> bytes:
        return b"".join([self.packed[t] for t in self._merge(word.encode().decode("latin-1"))])

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            known = self._bytes(word)
            if len(self.words) < REMEMBERED and len(word) <= 64:
                self.words[word] = known
        return known

    def _pieces(self, text: str) -> list[str]:
        if not text or text.isascii() or ord(max(text)) < STABLE:
            return self.splitter.findall(text)
        return [text[a:b] for _, (a, b) in self.library_splitter.pre_tokenize_str(text)]

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a space and ``chunk``; None where white space around it makes the split depend on the rest."""
        if chunk.isalpha():  # letters alone are one piece
            made = self._bytes(" " + chunk)
        elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        elif "\n" in chunk:  # one break between two words is a piece of its own
            left, _, right = chunk.partition("\n")
            if left[-1].isspace() or right[0].isspace():
                return b"".join(map(self._word, self._pieces(" " + chunk)))
            before = self.chunks.get(left) or self._chunk(left)
            return before + self._word("\n") + b"".join(map(self._word, [right] if right.isalpha() else self._pieces(right)))
        elif chunk[-1] in ",." and chunk[:-1].isalpha():
            made = (self.chunks.get(chunk[:-1]) or self._chunk(chunk[:-1])) + self._word(chunk[-1])
            if len(chunk) > 12:  # long words with a stop after them seldom return
                return made
        else:
            made = b"".join(map(self._word, self._pieces(" " + chunk)))
        if len(self.chunks) < REMEMBERED and len(chunk) <= 64:
            self.chunks[chunk] = made
        return made

    def _plain(self, text: str) -> bytes:
        # A single space between two other characters always starts a new piece.
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            made = list(map(self.chunks.get, rest))
            if None in made:
                slow = self._chunk
                made = [slow(c) if m is None else m for m, c in zip(made, rest)]
            if None not in made:
                return b"".join([*map(self._word, self._pieces(first)), *made])
        return b"".join(map(self._word, self._pieces(text))) if text else b""

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.special_re is None or not self.special_re.search(text):
            return self._plain(text)
        made, at = [], 0
        for hit in self.special_re.finditer(text):
            made += [self._plain(text[at : hit.start()]), self.special[hit.group()].to_bytes(4, "little")]
            at = hit.end()
        return b"".join([*made, self._plain(text[at:])])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ``ids`` gathered through the offset table."""
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        return self.blob[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


def codec(path: str) -> Codec:
    """One codec per worker and file."""
    return kept(path, lambda: Codec(path))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of ints) for each row; a null text has an empty array."""

    def work(batch: pa.RecordBatch) -> dict:
        tool = codec(path)
        made = [np.frombuffer(tool.encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "ids": made}

    return map_batches(df.select(id_col, text_col), work, f"{_typed(df, id_col)}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``text`` for each row of ids; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""

    def work(batch: pa.RecordBatch) -> dict:
        tool = codec(path)
        texts = [tool.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "text": texts}

    return map_batches(df.select(id_col, ids_col), work, f"{_typed(df, id_col)}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the text decoded from them, without moving either between stages."""

    def work(batch: pa.RecordBatch) -> dict:
        tool, counts, of_ids, of_text = codec(path), [], [], []
        for text in batch.column(1):
            ids = np.frombuffer(tool.encode(text.as_py()), "<u4").astype(np.int64)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join([tool.decimals[i] for i in ids.tolist()]).encode()).hexdigest())
            of_text.append(hashlib.sha256(tool.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
        return {id_col: batch.column(0), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text}

    schema = f"{_typed(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(df.select(id_col, text_col), work, schema)


def _typed(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"

"""Problem 6: the corpus as token ids of a byte-level BPE, and a streaming decoder.

The merges are compiled into a finite-state transducer over bytes that is determinised lazily: a transition is worked out the
first time it is taken and kept. After each byte the encoding of the text read so far ends in exactly one token, namely the
one that fits its predecessor: two tokens may stand side by side if encoding their joined bytes gives those two back. A state
therefore needs the longest suffix that some token starts with and, for each place in it, the tokens that lead there; tokens
that all places share are emitted. The lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans import spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split of the text that the vocabulary was made for.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and transitions kept by a worker before it starts afresh; they bound memory and change no result.
KEPT_WORDS, KEPT_STATES = 400_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one token in base64 and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes of one word in, token ids out; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.starts = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self._fresh()

    def _fresh(self) -> None:
        #: A state is (suffix, last token emitted, tokens that lead to each of the suffix's places since then).
        self.states = [(b"", -1, ((),))]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, word: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fit(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if left < 0:
                known = self.merge(self.bytes_of[right]) == [right]
            else:
                known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.fits[key] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        suffix, emitted, paths = self.states[state]
        grown = suffix + bytes((byte,))
        path = None
        for n in range(len(grown), 0, -1):
            token = self.ranks.get(grown[-n:])
            if token is not None:
                before = paths[len(grown) - n]
                if self._fit(before[-1] if before else emitted, token):
                    path = (*before, token)
                    break
        if path is None:
            raise ValueError("a byte has no token")
        rest = grown
        while rest and rest not in self.starts:
            rest = rest[1:]
        paths = (*paths, path)[len(grown) - len(rest) :]
        shared = 0
        while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
            shared += 1
        out = paths[0][:shared]
        to = (rest, out[-1] if out else emitted, tuple(p[shared:] for p in paths))
        if to not in self.number:
            self.number[to] = len(self.states)
            self.states.append(to)
            self.moves.append({})
        found = self.moves[state][byte] = (self.number[to], out)
        return found

    def encode(self, word: bytes) -> list[int]:
        if len(self.states) > KEPT_STATES:
            self._fresh()
        state, ids, moves = 0, [], self.moves
        for byte in word:
            to = moves[state].get(byte) or self._move(state, byte)
            state = to[0]
            if to[1]:
                ids += to[1]
        ids += self.states[state][2][-1]
        return ids


class Encoder:
    """Whole texts to ids: null and empty texts give no ids, blank texts are encoded as they stand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN):
        import regex

        self.words = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        kept, ids = self.kept, []
        for word in self.words(text):
            got = kept.get(word)
            if got is None:
                got = self.transducer.encode(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = got
            ids += got
        return ids


class Utf8Stream:
    """An incremental UTF-8 state machine: feed bytes in any cuts, get characters as soon as they are whole.

    Bytes that cannot continue a character give U+FFFD, one for each longest valid start; ``close`` ends an unfinished one.
    """

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.low, self.high, self.need = self.code << 6 | b & 0x3F, 0x80, 0xBF, self.need - 1
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need = 0
            self.low, self.high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Characters as the ids come in; an id may end inside a character."""
    machine = Utf8Stream()
    for i in ids:
        if got := machine.feed(bytes_of[i]):
            yield got
    if got := machine.close():
        yield got


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(read_ranks(path))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[int, bytes]:
    return {i: b for b, i in read_ranks(path).items()}


def token_ids(text: Column, ranks: str = DEFAULT_RANKS) -> Column:
    """Token ids of a text column as an array of integers; null and empty texts give an empty array."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([encoder(ranks).encode(t) for t in texts], dtype=object)

    return encode(text)


def decoded(ids: Column, ranks: str = DEFAULT_RANKS) -> Column:
    """The text of an array of ids; null gives null."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else "".join(decode_stream(r, vocabulary(ranks))) for r in rows], dtype=object)

    return decode(ids)


def corpus_ids(documents: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, ids) for every document: one scan of two columns, no shuffle."""
    return spread(documents.select("doc_id", "text")).select("doc_id", token_ids(F.col("text"), ranks).alias("ids"))


def tokens_by_source(documents: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(source, n_docs, n_tokens, n_roundtrip): ids counted and decoded again; n_roundtrip counts texts that come back unchanged."""
    ids = spread(documents.select("source", "text")).select("source", "text", token_ids(F.col("text"), ranks).alias("ids"))
    back = ids.select("source", F.size("ids").alias("n"), (decoded(F.col("ids"), ranks) == F.coalesce("text", F.lit(""))).cast("bigint").alias("same"))
    return back.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").cast("bigint").alias("n_tokens"), F.sum("same").alias("n_roundtrip"))

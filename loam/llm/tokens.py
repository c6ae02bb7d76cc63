"""Byte-level BPE of a public vocabulary over a whole corpus.

Method: speculate and verify. A text is cut into words; for each new word a greedy longest match proposes tokens;
all adjacent pairs of all proposals of a batch are tested at once against a table of pair compatibilities (a pair
is compatible if merging its own bytes gives that pair back; a sequence of tokens is the BPE result exactly if all
its neighbours are compatible); only the words that fail are merged step by step. Words and pairs already decided
are remembered per Python worker, up to fixed numbers.

Defined results
- a null text has null ids, an empty text an empty list; blank texts are encoded like any other;
- names of special tokens in a text are ordinary text: only ordinary tokens come out;
- texts of any length are encoded whole; repeated rows each get their ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import spread

#: Where the public vocabulary lies; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_WORDS_KEPT, _CHARS_KEPT = 400_000, 8_000_000  # of words remembered, and of their characters together
#: The white space of the public pattern, and the pattern.
_WS = r"\t-\r \x85\xa0  -     　"
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = re.compile(rf"{_CONTRACTIONS}| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_PLAIN = re.compile(rf"{_CONTRACTIONS}| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_WS}]|_)+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def _odd_numbers() -> frozenset[str]:
    """Numbers that are no decimal digits: the standard library counts them as word characters."""
    return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("No", "Nl"))


_ODD: list[frozenset[str]] = []
_EXACT: list = []


def words_of(text: str) -> list[str]:
    """The words that the public pattern cuts a text into."""
    if text.isascii():
        return _ASCII.findall(text)
    if not _ODD:
        _ODD.append(_odd_numbers())
    if _ODD[0].isdisjoint(text):
        return _PLAIN.findall(text)
    if not _EXACT:
        import regex

        _EXACT.append(regex.compile(rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"))
    return _EXACT[0].findall(text)


class Encoder:
    """Words to ids, with everything decided so far."""

    def __init__(self, vocabulary: bytes) -> None:
        lines = (line.split() for line in vocabulary.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.prefixes = {token[:k] for token in self.ranks for k in range(1, len(token) + 1)}
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.chars = 0
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def merged(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first, leftmost first; a heap keeps long words from costing their square."""
        ranks = self.ranks
        n = len(word)
        if n == 1:
            return [ranks[word]]
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], nxt[i], alive[j] = stop, nxt[j], False
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = nxt[i]
        return out

    def greedy(self, word: bytes) -> list[int]:
        """The longest vocabulary entry again and again."""
        out, at, n = [], 0, len(word)
        ranks, prefixes = self.ranks, self.prefixes
        while at < n:
            stop, best = at + 1, at + 1
            while stop <= n and word[at:stop] in prefixes:
                if word[at:stop] in ranks:
                    best = stop
                stop += 1
            out.append(ranks[word[at:best]])
            at = best
        return out

    def _compatible(self, pair: int) -> bool:
        known = self.pairs.get(pair)
        if known is None:
            a, b = pair >> 32, pair & 0xFFFFFFFF
            known = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self.pairs) < 2_000_000:
                self.pairs[pair] = known
        return known

    def decided(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ranks = self.ranks
        out = [[ranks[w]] if w in ranks else self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ids in out for t in ids), np.int64, int(sizes.sum()))
        if len(flat) > len(out):
            owner = np.repeat(np.arange(len(out)), sizes)
            inside = owner[1:] == owner[:-1]
            pairs = (flat[:-1][inside] << 32) | flat[1:][inside]
            distinct, back = np.unique(pairs, return_inverse=True)
            good = np.fromiter((self._compatible(p) for p in distinct.tolist()), bool, len(distinct))
            for k in np.unique(owner[1:][inside][~good[back]]).tolist():
                out[k] = self.merged(raw[k])
        return out

    def _learn(self, words: list[str]) -> None:
        found = self.decided(words)
        self.chars += sum(map(len, words))
        first, total = len(self.code), sum(map(len, found))
        while first + len(words) > len(self.starts):
            self.starts, self.sizes = np.concatenate((self.starts, np.zeros_like(self.starts))), np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        for k, (word, ids) in enumerate(zip(words, found), first):
            self.code[word] = k
            self.starts[k], self.sizes[k] = self.used, len(ids)
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The code of every word of the texts, one after the other, and the number of words of each text."""
        if len(self.code) > _WORDS_KEPT or self.chars > _CHARS_KEPT:
            self._reset()
        cut = [words_of(t) for t in texts]
        fresh = {w for words in cut for w in words if w not in self.code}
        if fresh:
            self._learn(list(fresh))
        code = self.code
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        return np.fromiter((code[w] for words in cut for w in words), np.int64, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)``: the ids of all texts, one after the other, and the number of each."""
        codes, counts = self._codes(texts)
        sizes = self.sizes[codes]
        total = int(sizes.sum())
        begin = np.cumsum(sizes) - sizes
        places = np.arange(total, dtype=np.int64) + np.repeat(self.starts[codes] - begin, sizes)
        ids = self.flat[places]
        edges = np.concatenate(([0], np.cumsum(sizes)))
        words = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(edges[words])

    def count(self, texts: list[str]) -> np.ndarray:
        codes, counts = self._codes(texts)
        edges = np.concatenate(([0], np.cumsum(self.sizes[codes])))
        return np.diff(edges[np.concatenate(([0], np.cumsum(counts)))])


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """The encoder of a vocabulary; one per Python worker."""
    key = hashlib.md5(vocabulary).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _chunks(texts: list[str | None], most: int = 2_000_000) -> Iterable[list[str]]:
    """Runs of texts of about ``most`` characters, so that a batch of very long texts stays small in memory."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id_col, ids)``: every row's ids. A map over the scan: no shuffle."""
    held = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))  # one file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [own.encode(c) for c in _chunks(texts)]
            ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int32)
            sizes = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            missing = pa.array([t is None for t in texts], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()), mask=missing)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(ids: DataFrame, id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id_col, text)`` of ``(id_col, ids)``: null ids give null. A map over the rows."""
    held = ids.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(held.value).tokens
        for batch in batches:
            texts = [None if row is None else b"".join(map(tokens.__getitem__, row)).decode("utf-8") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = ids.schema[id_col].dataType.simpleString()
    return ids.select(F.col(id_col), F.col("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id_col, tokens)``: every row's number of ids; 0 for null and empty texts."""
    held = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        for batch in batches:
            parts = [own.count(c) for c in _chunks(batch.column(1).to_pylist())]
            sizes = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_col, "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, tokens long")

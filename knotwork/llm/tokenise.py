"""Byte-pair encoding of a whole corpus by an index of pair occurrences.

Each task numbers the different words of its rows, lays their bytes out in one
array of symbols, and maps every adjacent pair with a rank to all its positions.
Ranks are applied in ascending order: one step merges all occurrences of a pair
in all words at once and updates only the lists of the pairs beside them. Rows
are then put together from the words' ids by array look-ups.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import cut

from knotwork.functions.text import WIDE_WHITE

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: Characters of text whose words are encoded together; a longer text is a group of its own.
GROUP_CHARS = 1 << 24
#: Words whose ids a task keeps for its next groups.
KEEP_WORDS = 400_000

_NONE = np.int32(2**31 - 1)
#: Fixed value: how the byte-level vocabulary cuts text into words.
_WHITE = r"\t-\r " + "".join(map(chr, WIDE_WHITE))
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Merges of a byte-level vocabulary file as arrays: ids of bytes, and pair keys in order with rank and new id."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    ids = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
    right = np.array([ids[b] for _, b in merges], dtype=np.int64)
    made = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
    keys = left << 32 | right
    order = np.argsort(keys)
    return {
        "bytes": np.array([ids[c] for c in _byte_characters()], dtype=np.int32),
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "made": made,
        "left": left.astype(np.int32),
        "right": right.astype(np.int32),
    }


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of words, kept from group to group."""

    def __init__(self, vocabulary: dict) -> None:
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def words(self, text: str) -> list[str]:
        return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)

    def number(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words; new words are encoded."""
        if len(self.numbers) > KEEP_WORDS:
            self.clear()
        known = len(self.numbers)
        lookup = self.numbers.__getitem__
        out = []
        for t in texts:
            words = self.words(t)
            out.append(np.fromiter(map(lookup, words), dtype=np.int64, count=len(words)))
        if len(self.numbers) > known:
            new = [w.encode("utf-8", "replace") for w in list(self.numbers)[known:]]
            ids, lengths = self.merge(new)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        return out

    def lengths(self, numbers: np.ndarray) -> int:
        return int((self.starts[numbers + 1] - self.starts[numbers]).sum())

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        starts = self.starts[numbers]
        sizes = self.starts[numbers + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        return self.ids[at]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        i = np.minimum(np.searchsorted(self.v["keys"], keys), len(self.v["keys"]) - 1)
        return np.where(self.v["keys"][i] == keys, self.v["ranks"][i], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        n = len(data)
        if n == 0:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        symbol = self.v["bytes"][data]
        # one place more on either side, so that the neighbours of the ends exist
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes) - 1
        last = np.zeros(n, dtype=bool)
        last[ends[sizes > 0]] = True
        rank = np.full(n + 1, _NONE, dtype=np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        after[last] = n
        before[0] = n
        before[np.flatnonzero(last)[:-1] + 1] = n
        after = np.append(after, n)
        before = np.append(before, n).astype(np.int32)
        symbol = np.append(symbol, -1).astype(np.int32)
        alive = np.ones(n, dtype=bool)

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            if len(places) == 1:
                r = int(ranks[0])
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(heap, r)
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        some = np.flatnonzero(rank[:n] < _NONE).astype(np.int32)
        if len(some):
            enter(some, rank[some])
        left, right, made = self.v["left"], self.v["right"], self.v["made"]
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[rank[p] == r]
            if not len(p):
                continue
            if left[r] == right[r]:  # of a run of equal symbols the first two, the next two ...
                chosen, taken = [], -1
                for x, y in zip(p.tolist(), after[p].tolist()):
                    if x != taken:
                        chosen.append(x)
                        taken = y
                p = np.array(chosen, dtype=np.int32)
            q = after[p]
            symbol[p] = made[r]
            alive[q] = False
            rank[q] = _NONE
            z = after[q]
            after[p] = z
            before[z] = p
            before[n] = n
            o = before[p]
            touched = np.concatenate([p[z < n], o[o < n]])
            rank[p] = _NONE
            if len(touched):
                new = self.rank(symbol[touched], symbol[after[touched]])
                rank[touched] = new
                some = new < _NONE
                if some.any():
                    enter(touched[some], new[some])
            symbol[n] = -1
        counts = np.add.reduceat(alive.astype(np.int64), np.minimum(np.concatenate([[0], ends[:-1] + 1]), n - 1))
        counts[sizes == 0] = 0
        return symbol[:n][alive], counts


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One for each worker process and vocabulary."""
    if shared.value is not None and id(shared.value) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(shared.value)] = Encoder(shared.value)
    return _ENCODERS[id(shared.value)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, chars = [], 0
    for b in batches:
        held.append(b)
        chars += b.column("text").nbytes
        if chars >= GROUP_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _ids(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for group in _groups(batches):
            numbered = encoder.number([t or "" for b in group for t in b.column("text").to_pylist()])
            at = 0
            for b in group:
                rows = numbered[at : at + b.num_rows]
                at += b.num_rows
                sizes = [encoder.lengths(x) for x in rows]
                flat = encoder.gather(np.concatenate(rows)) if rows else np.zeros(0, dtype=np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], ["key", "ids"])

    return run


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for group in _groups(batches):
            numbered = encoder.number([t or "" for b in group for t in b.column("text").to_pylist()])
            keys = pa.chunked_array([b.column("key") for b in group]).combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, pa.array([encoder.lengths(x) for x in numbered], pa.int64())], ["key", "tokens"])

    return run


def _prepared(df: DataFrame, key: str, text: str, tokenizers: str):
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(f"{tokenizers}/byte_bpe_50k.json"))  # as large as the vocabulary
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows, shared, rows.schema["key"].dataType.simpleString()


def encode(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """key and ids of every row: the ids of the unchanged text by byte_bpe_50k, no special tokens, in order.

    An empty and a null text have an empty list. Strings of special tokens in a
    text are ordinary text. Repeated rows stay; a null key stays null.
    """
    rows, shared, kind = _prepared(df, key, text, tokenizers)
    return rows.mapInArrow(_ids(shared), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


#: Repeated keys that are sent to all tasks, at most; more meet their rows by a shuffle.
BROADCAST_KEYS = 200_000


def encode_once(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """encode of the distinct (key, text).

    Keys are counted without their texts; only rows of keys that occur more
    than once are compared, and ids are never shuffled.
    """
    rows = df.select(key, text)
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("k"))
    again = cut(counted)
    if again.count() <= BROADCAST_KEYS:
        again = F.broadcast(again)
    same = F.col(key).eqNullSafe(F.col("k"))
    single, several = rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi").dropDuplicates()
    return encode(single.unionByName(several), key, text, tokenizers)


def token_counts(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """key and tokens: how many ids encode would give; 0 for empty and null texts."""
    rows, shared, kind = _prepared(df, key, text, tokenizers)
    return rows.mapInArrow(_counts(shared), f"key {kind}, tokens long").withColumnRenamed("key", key)

"""An interpolated modified Kneser-Ney model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; each text ends with an end mark, which is scored, and
begins with start marks, which are not.

Counting.  A task reads its texts as bytes and hashes all words of a batch at once (a polynomial of the bytes over 2^64 by
running sums, then mixed).  It adds up equal n-grams of many batches and gives each shard of the hash space a block: its n-grams in
order, as byte planes, compressed; what is shuffled is a few bytes for each distinct n-gram of a task.  A task of the
next stage merges the blocks of its shard and writes them as a sorted array of hashes with the counts beside it, under a
name of its own that is then renamed: a lost executor's shards are written again, by any other.

A k-gram is named by the numbers of its first and its last k - 1 words, a number being the place in the arrays of the level below; so
the same steps make every level.  A level has: the count of each n-gram (below the highest level: how many different words
stand before it), and of each as a context the total, and how many n-grams after it have count 1, 2, and 3 or more.  Counts take a
byte; larger ones stand in a list of their own.

Scoring.  Workers map the arrays from the shared folder, so that all workers of a machine share one copy and read only
what they look up; a batch looks up its distinct n-grams in order.  p_k(w | h) = max(a(hw) - D(a), 0) / A(h) + gamma(h) p_{k-1}(w | h'),
with the three discounts of each level from its counts of counts; below unigrams there is an equal share for each known word and one
for all unknown ones.

The number of shards follows the input: a shard of n-grams holds at most `SHARD` of the training tokens on average.  The
shared folder must be one that workers can map (a local or mounted path); another kind is an error that says so.

Defined results: a null text is the empty text, which has the end mark alone; a null id is the empty text in the
rule that holds out, and stays null; repeated rows count and are scored each; without training rows each token has
the probability 1; an empty table returns no rows; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import mapped_folder, pieces, trim
from quillgraph.llm.folds import fold

ORDER = 2
#: Training tokens for each shard of n-grams; n-grams that a task gathers before it hands blocks on; shards of words at most.
SHARD, GATHER, WORD_SHARDS = 4_000_000, 2_000_000, 4096
#: Bytes whose words are hashed at once.
WINDOW = 1 << 20
_BLOCK = "shard int, a binary, b binary, n binary"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
START, END = np.uint64(1), np.uint64(2)
#: What an n-gram has as a context.
CONTEXT = ("total", "n1", "n2", "n3")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Hasher:
    """Hashes of the words of a batch of texts; `WINDOW` bytes at a time, cut between words."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def room(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, WINDOW + 1)
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of the words of one window."""
        self.room(len(data))
        raw = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], raw != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.inverse[start] + np.uint64(0x632BE59BD9B4E019)), start

    def tokens(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of all words of the texts, in order."""
        size = np.array([len(t or b"") + 1 for t in texts], np.int64)
        data = b"".join((t or b"") + b" " for t in texts).translate(_LOWER)
        hashes, starts, at = [], [], 0
        while at < len(data):
            end = min(at + WINDOW, len(data))
            end = len(data) if end == len(data) else data.find(b" ", end - 1) + 1  # the data ends with a blank
            h, s = self.words(data[at:end])
            hashes.append(h)
            starts.append(s + at)
            at = end
        where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(np.cumsum(size), where, side="right")


def marked(hashes: np.ndarray, text: np.ndarray, texts: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in the text) with `order - 1` start marks before and an end mark after each text."""
    pad = order - 1
    counts = np.bincount(text, minlength=texts)
    size = counts + pad + 1
    first = np.cumsum(size) - size
    out = np.full(int(size.sum()), START, np.uint64)
    out[first + size - 1] = END
    own = np.cumsum(counts) - counts
    out[first[text] + pad + np.arange(len(text)) - own[text]] = hashes
    owner = np.repeat(np.arange(texts), size)
    return out, owner, np.arange(len(out)) - first[owner]


def key_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of an n-gram named by two numbers."""
    return mixed(mixed(a.astype(np.uint64)) + b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash space, so that shards in order are keys in order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Differences of neighbouring numbers, byte by byte, compressed."""
    steps = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplaned(data: bytes) -> np.ndarray:
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(rows.T).view(np.uint64).ravel(), dtype=np.uint64)


def summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) in order with the sums of n."""
    wide = int(b.max(initial=0)).bit_length()
    if int(a.max(initial=0)).bit_length() + wide <= 64:
        joined = a << np.uint64(wide) | b if wide < 64 else b
        order = np.argsort(joined)
    else:
        order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], np.add.reduceat(n[order], new) if len(new) else n[:0]


class Gathered:
    """Adds up n-grams (a, b) of a task and hands on blocks of each shard when there are many."""

    def __init__(self, shards: int):
        self.shards, self.parts, self.held = shards, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.parts.append(summed(a, b, np.ones(len(a), np.int64) if n is None else n))
        self.held += len(self.parts[-1][0])
        if self.held > GATHER:
            self.parts = [summed(*map(np.concatenate, zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])
            if 2 * self.held > GATHER:
                yield from self.blocks()

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        a, b, n = summed(*map(np.concatenate, zip(*self.parts, strict=True)))
        self.parts, self.held = [], 0
        shard = shard_of(key_of(a, b), self.shards)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            mine = order[cut[s] : cut[s + 1]]
            if len(mine):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([_planes(x[mine])], pa.binary()) for x in (a, b, n))], names=["shard", "a", "b", "n"])


def _merged_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, a, b, sums) for each shard of a partition."""
    held: dict[int, list] = {}
    for rows in batches:
        for s, *cols in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            part = held.setdefault(s, [])
            part.append(tuple(map(_unplaned, cols)))
            if len(part) > 64:
                held[s] = [summed(*map(np.concatenate, zip(*part, strict=True)))]
    for s in sorted(held):
        yield s, *summed(*map(np.concatenate, zip(*held.pop(s), strict=True)))
    trim()


def _save(path: str, **arrays: np.ndarray) -> None:
    """Each array as a file; a file appears whole or not at all."""
    os.makedirs(path, exist_ok=True)
    for name, x in arrays.items():
        with open(own := f"{path}/.{name}-{uuid.uuid4().hex}", "wb") as f:
            np.save(f, x)
        os.replace(own, f"{path}/{name}.npy")


def _bytes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each value, and (place, value) of those that need more."""
    large = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype(np.uint8), np.stack([large, values[large].astype(np.int64)])


@dataclass
class Level:
    """The arrays of one level: a folder for each shard, opened when first asked."""

    path: str
    offsets: np.ndarray
    shards: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"path": self.path, "offsets": self.offsets, "shards": {}}

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def array(self, shard: int, name: str) -> np.ndarray:
        if (shard, name) not in self.shards:
            self.shards[shard, name] = np.load(f"{self.path}/{shard}/{name}.npy", mmap_mode="r").view(np.ndarray)
        return self.shards[shard, name]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of sorted keys; -1 for those that aren't there."""
        out = np.full(len(keys), -1, np.int64)
        cut = np.searchsorted(shard_of(keys, self.n), np.arange(self.n + 1))
        for s in np.flatnonzero((np.diff(cut) > 0) & (np.diff(self.offsets) > 0)).tolist():
            there, asked = self.array(s, "key"), keys[cut[s] : cut[s + 1]]
            at = np.minimum(np.searchsorted(there, asked), len(there) - 1)
            out[cut[s] : cut[s + 1]] = np.where(there[at] == asked, at + self.offsets[s], -1)
        return out

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys in any order."""
        known, back = np.unique(keys, return_inverse=True)
        return self.find(known)[back]

    def values(self, ids: np.ndarray, *names: str) -> list[np.ndarray]:
        """Values of n-grams by their numbers; 0 for -1."""
        order = np.argsort(ids, kind="stable")
        asked = ids[order]
        cut = np.searchsorted(asked, self.offsets)
        out = []
        for name in names:
            found = np.zeros(len(ids), np.int64)
            for s in np.flatnonzero(np.diff(cut) > 0).tolist():
                at = asked[cut[s] : cut[s + 1]] - self.offsets[s]
                value = self.array(s, name)[at].astype(np.int64)
                if len(full := np.flatnonzero(value == 255)):
                    place, large = self.array(s, f"{name}-large")
                    value[full] = large[np.searchsorted(place, at[full])]
                found[order[cut[s] : cut[s + 1]]] = value
            out.append(found)
        return out


def discounts(t: list[int]) -> tuple[float, float, float]:
    """For counts of 1, 2, and 3 or more, from how many n-grams have the counts 1 to 4; usual values where those say nothing."""
    if min(t[:3]) <= 0:
        return 0.5, 1.0, 1.5
    y = t[0] / (t[0] + 2 * t[1])
    return tuple(min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def discounted(a: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(a - np.array([0.0, *d])[np.minimum(a, 3)], 0.0)


@dataclass
class Model:
    """`tokens` and `words` are N and V of the training texts; `unigram` is the sum of the lowest level's counts and how many are 1, 2, and 3 or more."""

    order: int
    tokens: int
    words: int
    levels: list[Level]
    cuts: list[tuple[float, float, float]]
    unigram: tuple[int, int, int, int] = (0, 0, 0, 0)

    def numbers(self, hashes: np.ndarray, place: np.ndarray, most: int) -> list[np.ndarray]:
        """For each level to `most`, the number of the n-gram that ends at each place; -1 where there is none."""
        if not self.levels:
            return [np.full(len(hashes), -1, np.int64)] * most
        out = [self.levels[0].numbers(key_of(hashes, np.zeros(len(hashes), np.uint64)))]
        for k in range(2, most + 1):
            out.append(np.full(len(hashes), -1, np.int64))
            at = following(out[-2], place, k)
            out[-1][at] = self.levels[k - 1].numbers(key_of(out[-2][at - 1], out[-2][at]))
        return out

    def probabilities(self, numbers: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """The probability of the token at each of the places `at`."""
        if not self.tokens:
            return np.ones(len(at))
        a = self.levels[0].values(numbers[0][at], "n" if self.order == 1 else "before")[0]
        total, n1, n2, n3 = self.unigram
        d = self.cuts[0]
        p = discounted(a, d) / total + (d[0] * n1 + d[1] * n2 + d[2] * n3) / total / (self.words + 1)
        for k in range(2, self.order + 1):
            d = self.cuts[k - 1]
            a = self.levels[k - 1].values(numbers[k - 1][at], "n" if k == self.order else "before")[0]
            total, n1, n2, n3 = self.levels[k - 2].values(numbers[k - 2][at - 1], *CONTEXT)
            whole = np.maximum(total, 1)
            p = np.where(total > 0, discounted(a, d) / whole + (d[0] * n1 + d[1] * n2 + d[2] * n3) / whole * p, p)
        return p


def following(below: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Where a k-gram ends whose two (k - 1)-grams are known."""
    fits = place >= k - 1
    fits[1:] &= below[:-1] >= 0
    return np.flatnonzero(fits & (below >= 0))


def _texts(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    held = fold(F.col(id_col), parts) == 2
    return docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.encode(F.col(text_col), "UTF-8").alias("t"))


def _stats_of(values: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(context, its total and its n-grams of count 1, 2, 3 or more), contexts in order."""
    order = np.argsort(a, kind="stable")
    a, values = a[order], values[order]
    live = values > 0
    a, values = a[live], values[live]
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(x.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    return a[new], {"total": add(values), "n1": add(values == 1), "n2": add(values == 2), "n3": add(values >= 3)}


_STATS = "shard int, id binary, total binary, n1 binary, n2 binary, n3 binary, before binary, told array<long>"
_NAMES = [x.split()[0] for x in _STATS.split(", ")]
#: What a told row is about: the size of a shard, the counts of the highest level, the counts of what stands before.
SIZE, HIGHEST, BEFORE = 0, 1, 2


def _told(*numbers: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(6)), pa.array([[int(x) for x in numbers]], pa.list_(pa.int64()))], names=_NAMES)


def counts_of(values: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4, how many are more than 0, and their sum."""
    return [*(int((values == k).sum()) for k in (1, 2, 3, 4)), int((values > 0).sum()), int(values.sum())]


def _stat_rows(below: Level, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each shard of the level below, what n-grams (a, b) with these counts say of their contexts and of what they end with."""
    live = values > 0
    a, b, values = a[live].astype(np.int64), b[live].astype(np.int64), values[live]
    every = np.union1d(a, b)
    at = np.searchsorted(every, a)
    size = len(every)
    stats = [np.bincount(at, values, size), *(np.bincount(at[x], minlength=size) for x in (values == 1, values == 2, values >= 3)), np.bincount(np.searchsorted(every, b), minlength=size)]
    cut = np.searchsorted(every, below.offsets)
    for s in np.flatnonzero(np.diff(cut) > 0).tolist():
        part = slice(cut[s], cut[s + 1])
        packed = [_planes(every[part]), *(zlib.compress(x[part].astype(np.int64).tobytes(), 1) for x in stats)]
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in packed), pa.nulls(1, pa.list_(pa.int64()))], names=_NAMES)


def _stats_written(below: Level, rows: DataFrame) -> list[list[int]]:
    """Adds up the rows of `_stat_rows`, writes the sums beside the arrays of the level below, and returns what was told: a few rows for each shard."""
    names = _NAMES[2:7]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        told = []
        for part in batches:
            for row in part.to_pylist():
                if row["told"] is not None:
                    told.append(row["told"])
                    continue
                s = row["shard"]
                if s not in sums:
                    sums[s] = np.zeros((len(names), int(below.offsets[s + 1] - below.offsets[s])), np.int64)
                at = _unplaned(row["id"]).astype(np.int64) - below.offsets[s]
                for k, name in enumerate(names):
                    sums[s][k, at] += np.frombuffer(zlib.decompress(row[name]), np.int64)
        for s, x in sums.items():
            for k, name in enumerate(names):
                small, large = _bytes_of(x[k])
                _save(f"{below.path}/{s}", **{name: small, f"{name}-large": large})
            told.append([BEFORE, *counts_of(x[-1])])
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.list_(pa.int64()))], names=["told"])
        trim()

    return [r["told"] for r in rows.repartitionById(below.n, "shard").mapInArrow(make, "told array<long>").collect()]


def _added(told: list[list[int]], kind: int) -> list[int]:
    return [sum(x) for x in zip(*(t[1:] for t in told if t[0] == kind), strict=True)]


def _offsets(told: list[list[int]], shards: int) -> np.ndarray:
    sizes = np.zeros(shards, np.int64)
    for t in told:
        if t[0] == SIZE:
            sizes[t[1]] = t[2]
    return np.concatenate([[0], np.cumsum(sizes)])


def _blocks(texts: DataFrame, model: Model, k: int, shards: int) -> DataFrame:
    """Blocks of the k-grams of the texts, dealt to their shards; `model` has the levels below."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, gathered = Hasher(), Gathered(shards)
        for rows in pieces(batches, 2_000_000):
            hashes, _, place = marked(*hasher.tokens(rows.column(0).to_pylist()), rows.num_rows, model.order)
            if k == 1:
                yield from gathered.add(hashes, np.zeros(len(hashes), np.uint64), (hashes != START).astype(np.int64))
            else:
                below = model.numbers(hashes, place, k - 1)[-1].view(np.uint64)
                at = following(below.view(np.int64), place, k)
                yield from gathered.add(below[at - 1], below[at])
        yield from gathered.blocks()
        trim()

    return texts.mapInArrow(make, _BLOCK).repartitionById(shards, "shard")


def _words(texts: DataFrame, order: int, path: str) -> tuple[Level, list[int]]:
    """The lowest level and the counts of its words; the start mark is in it with count 0."""
    shards = max(1, min(texts.rdd.getNumPartitions(), WORD_SHARDS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = []
        for s, hashes, zero, n in _merged_blocks(batches):
            keys = key_of(hashes, zero)
            by = np.argsort(keys)
            small, large = _bytes_of(n[by])
            _save(f"{path}/{s}", key=keys[by], n=small, **{"n-large": large})
            told += [[SIZE, s, len(n)], [HIGHEST, *counts_of(n)]]
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.list_(pa.int64()))], names=["told"])

    told = [r["told"] for r in _blocks(texts, Model(order, 0, 0, [], []), 1, shards).mapInArrow(write, "told array<long>").collect()]
    return Level(path, _offsets(told, shards)), _added(told, HIGHEST)


def fit(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", parts: int = 7) -> Model:
    """The model of the rows that crc32 of the id as text, mod `parts`, does not hold out."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col, parts).filter("not held_out").select("t")
    words, counts = _words(texts, order, mapped_folder(spark, "words"))
    if not counts:
        return Model(order, 0, 0, [], [])
    model = Model(order, counts[5], counts[4], [words], [])
    of_level = [counts]
    shards = -(-model.tokens // SHARD)
    for k in range(2, order + 1):
        path, below, top = mapped_folder(spark, f"grams{k}"), model.levels[-1], k == order

        def write(batches: Iterator[pa.RecordBatch], path=path, below=below, top=top) -> Iterator[pa.RecordBatch]:
            for s, a, b, n in _merged_blocks(batches):
                keys = key_of(a, b)
                by = np.argsort(keys)
                small, large = _bytes_of(n[by])
                _save(f"{path}/{s}", key=keys[by], **({"n": small, "n-large": large} if top else {"a": a[by], "b": b[by]}))
                yield _told(SIZE, s, len(n))
                if top:
                    yield from _stat_rows(below, n, a, b)
                    yield _told(HIGHEST, *counts_of(n))

        told = _stats_written(below, _blocks(texts, model, k, shards).mapInArrow(write, _STATS))
        model.levels.append(Level(path, _offsets(told, shards)))
        of_level.append(_added(told, HIGHEST))
        if top:
            of_level[k - 2] = _added(told, BEFORE)
    for k in range(order - 1, 1, -1):  # what stands before the n-grams of a level between is known now

        def passed(batches: Iterator[pa.RecordBatch], here=model.levels[k - 1], below=model.levels[k - 2]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for s in rows.column(0).to_pylist():
                    ids = np.arange(here.offsets[s], here.offsets[s + 1])
                    if len(ids):
                        yield from _stat_rows(below, here.values(ids, "before")[0], here.array(s, "a"), here.array(s, "b"))

        of_level[k - 2] = _added(_stats_written(model.levels[k - 2], spark.range(model.levels[k - 1].n, numPartitions=model.levels[k - 1].n).mapInArrow(passed, _STATS)), BEFORE)
    model.cuts = [discounts(c[:4]) for c in of_level]
    one, two, _, _, alive, total = of_level[0]
    model.unigram = (total, one, two, alive - one - two)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", parts: int = 7) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for rows in pieces(batches, 2_000_000):
            hashes, owner, place = marked(*hasher.tokens(rows.column(2).to_pylist()), rows.num_rows, model.order)
            numbers = model.numbers(hashes, place, model.order)
            at = np.flatnonzero(place >= model.order - 1)
            n = model.levels[0].values(numbers[0][at], "n")[0] if model.levels else np.zeros(len(at), np.int64)
            add = lambda x, own=owner[at], size=rows.num_rows: np.bincount(own, x, size)
            tokens, total = add(None), add(np.log10(model.probabilities(numbers, at)))
            base = add(np.log10((n + 1) / (model.tokens + model.words + 1)))
            cols = [rows.column(0), rows.column(1), pa.array(tokens, pa.int64()), pa.array(add(n > 0).astype(np.int64)), pa.array(np.full(len(tokens), model.tokens)), pa.array(base), pa.array(total), pa.array(10 ** (-total / tokens))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return _texts(docs, id_col, text_col, parts).mapInArrow(make, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared as lower-case letters and digits with single spaces.  An item
is cut into overlapping windows of `WINDOW` characters (a shorter item is one window), and again
into windows of `PASSAGE` characters, one every `STEP`, so that each passage of PASSAGE + STEP - 1
characters (about a dozen words) holds a whole window wherever it starts; a document is
contaminated by an item if some stretch of it is within the window's edit
budget, e = BUDGET x window, of a window.

Two strings at distance e share at least m - Q + 1 - e * Q of the m - Q + 1 q-grams of the
window, on diagonals (text position - window position) that differ by at most e.  So
shared q-grams are counted per window in bands of 2(e + 1) diagonals that overlap by
half, which leaves no match between two bands; bands that reach the lemma's count
are retained and verified by an alignment that stays in the band.  The filter loses no window;
quotes shorter than PASSAGE + STEP - 1 characters are found only where they hold a window.

Shared q-grams are added up slice by slice, `SLICE` of them at a time, and of a text that is
done only the bands that reach the count are kept, so a benchmark whose items share a template
doesn't fill the memory.  An item of fewer than Q characters holds no q-gram; it is found
exactly, as whole words in a row.

The items are cut into blocks of about `BLOCK_GRAMS` q-grams, files in the shared folder.  A task passes over its
texts once, and takes them through one block after another, many texts at a time, with the index of one block in
memory: a benchmark of any size runs, and a usual one is one block.

Defined results: null texts are empty and match nothing; null items, and items without a letter or
digit, match nothing; items with less
room than the budget get the largest budget at which the lemma still filters; repeated rows
give their pairs once; a null document id is kept, null item ids too; empty tables
return no rows; other columns are not read.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_map, kept_rows, mapped_folder, pieces, text_of

Q = 10
WINDOW = 100
PASSAGE, STEP = 56, 5
BUDGET = 0.08
BLOCK_GRAMS = 4_000_000
#: Bytes of text that are searched at once, and that are taken through the blocks together where there are several.
PIECE, MANY = 2_000_000, 32_000_000
#: Shared q-grams (text position, window) that are held at once.
SLICE = 2_000_000
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_HIT = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("start", pa.int64()), ("window", pa.int64()), ("distance", pa.int64())])


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").translate(_ASCII).split())


def budget(length: int, share: float = BUDGET) -> int:
    """The edits allowed in a window, with at least one shared q-gram left by the lemma."""
    return max(0, min(int(share * length), (length - Q) // Q))


def gram_codes(text: bytes) -> np.ndarray:
    """A 64-bit code for the q-gram at each position."""
    raw, n = np.frombuffer(text, np.uint8), len(text) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = np.empty(len(text) - 7, np.uint64)
    for o in range(8):
        k = (len(text) - o) // 8
        eight[o::8][:k] = raw[o : o + 8 * k].view("<u8")
    return eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[Q - 8 : Q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)


class Windows:
    """The windows of a block of items, with an index of their q-grams."""

    def __init__(self, items: list[tuple[int | None, bytes]], share: float = BUDGET, passages: bool = False):
        self.item, self.text, self.edits = [], [], []
        short = [(key, text) for key, text in items if 0 < len(text) < Q]
        for key, text in items:
            for most, step in ((WINDOW, WINDOW // 2), (PASSAGE, STEP))[: 1 + (passages and len(text) > PASSAGE)]:
                size = min(most, len(text))
                starts = sorted({*range(0, len(text) - size + 1, step), len(text) - size}) if size >= Q else []
                for s in starts:
                    self.item.append(key)
                    self.text.append(text[s : s + size])
                    self.edits.append(budget(size, share))
        length = np.array([len(t) for t in self.text], np.int64)
        self.length, self.allowed = length, np.array(self.edits, np.int64)
        self.least = np.maximum(1, length - Q + 1 - self.allowed * Q)
        self.band = int(self.allowed.max(initial=0)) + 1
        codes = [gram_codes(t) for t in self.text]
        window = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        at = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.window, self.at = window[order], at[order]
        self.code, self.first = np.unique(code[order], return_index=True)
        self.next = np.append(self.first[1:], len(order)) if len(order) else self.first
        self.bits = max(16, int(len(self.code)).bit_length() + 6)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.code)] = True
        self.words = {text: [] for _, text in short}
        for n, (key, text) in enumerate(short, len(self.text)):  # numbered after the windows
            self.words[text].append(n)
            self.item.append(key)
        self.finder = None
        if short:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for text in self.words:
                self.finder.add_word(f" {text.decode('latin-1')} ", text)
            self.finder.make_automaton()

    def exact(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, start) of the first place of each item that is too short for a q-gram."""
        for d, text in enumerate(texts if self.finder else ()):
            seen: set[bytes] = set()
            for last, word in self.finder.iter(f" {text.decode('latin-1')} "):
                if word not in seen:
                    seen.add(word)
                    yield from ((d, n, last - 1 - len(word)) for n in self.words[word])

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return code * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)

    def shared(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text position, window, window position) of all shared q-grams by text position, about `SLICE` at a time."""
        code = gram_codes(text)
        pos = np.flatnonzero(self.maybe[self._slot(code)])
        row = np.minimum(np.searchsorted(self.code, code[pos]), max(len(self.code) - 1, 0))
        same = self.code[row] == code[pos] if len(self.code) else np.zeros(len(pos), bool)
        pos, row = pos[same], row[same]
        n = self.next[row] - self.first[row]
        total = np.cumsum(n)
        at = 0
        while at < len(pos):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, side="right")))
            k = n[at:end]
            entry = np.repeat(self.first[row[at:end]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            yield np.repeat(pos[at:end], k), self.window[entry], self.at[entry]
            at = end


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def retained(windows: Windows, joined: bytes, ends: np.ndarray) -> np.ndarray:
    """(text number, window, first diagonal) of the bands of two steps, at each step, whose shared q-grams reach the lemma's count."""
    found: list[np.ndarray] = []
    many, steps = max(1, len(windows.text)), (len(joined) + WINDOW) // windows.band + 2
    held, sums = np.empty(0, np.int64), np.empty(0, np.int64)

    def done(held: np.ndarray, sums: np.ndarray) -> None:
        for shift in (0, 1):
            pair, step = held // steps, held % steps
            key, n = added(pair * steps + (step + shift >> 1), sums)
            pair, step = key // steps, key % steps
            keep = n >= windows.least[pair % many]
            found.append(np.stack([pair[keep] // many, pair[keep] % many, (2 * step[keep] - shift) * windows.band - WINDOW]))

    for pos, window, at in windows.shared(joined):
        doc = np.searchsorted(ends, pos, side="right")
        key = (doc * many + window) * steps + (pos - at + WINDOW) // windows.band  # a diagonal is at least -WINDOW
        key, n = added(key, np.ones(len(key), np.int64))
        held, sums = added(np.concatenate([held, key]), np.concatenate([sums, n]))
        cut = int(np.searchsorted(held, int(doc[-1]) * many * steps))  # the last text may go on
        done(held[:cut], sums[:cut])
        held, sums = held[cut:], sums[cut:]
    done(held, sums)
    return np.concatenate(found, axis=1)


def banded(text: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray, pattern: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern (rows of equal length) in its text, on diagonals [diagonal, diagonal + width); and the last text position.

    low and high bound the text of each row; the alignment starts and ends anywhere.
    """
    size = pattern.shape[1]
    step = np.arange(width)
    cost = np.zeros((len(pattern), width), np.int32)
    for i in range(size):
        at = diagonal[:, None] + i + step
        inside = (at >= low[:, None]) & (at < high[:, None])
        char = np.where(inside, text[np.clip(at, 0, len(text) - 1)], 0)
        new = cost + (char != pattern[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a window character is missing in the text
        cost = np.minimum.accumulate(new - step, axis=1) + step  # the text has characters more
    best = cost.argmin(1)
    return cost[np.arange(len(cost)), best], diagonal + size - 1 + best


def search(windows: Windows, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, window, start, edits) of the verified matches, the best of each text and window."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]
    joined = b"\n".join(texts)
    d, w, diagonal = retained(windows, joined, ends)
    raw, edits, start = np.frombuffer(joined, np.uint8), np.full(len(d), 1 << 30), np.zeros(len(d), np.int64)
    for size in np.unique(windows.length[w]):
        rows = np.flatnonzero(windows.length[w] == size)
        for part in np.array_split(rows, -(-len(rows) // 4096)):
            pattern = np.stack([np.frombuffer(windows.text[x], np.uint8) for x in w[part]])
            edits[part], last = banded(raw, starts[d[part]], ends[d[part]] - 1, diagonal[part], pattern, 2 * windows.band)
            start[part] = last - size + 1 - starts[d[part]]
    good = edits <= windows.allowed[w]
    d, w, start, edits = d[good], w[good], start[good], edits[good]
    order = np.lexsort((start, edits, w, d))
    d, w, start, edits = d[order], w[order], start[order], edits[order]
    one = np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])) if len(d) else np.empty(0, bool)
    short = np.array(list(windows.exact(texts)), np.int64).reshape(-1, 3).T
    return np.append(d[one], short[0]), np.append(w[one], short[1]), np.append(np.maximum(start[one], 0), short[2]), np.append(edits[one], np.zeros_like(short[0]))


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    block, size = [], 0
    for x in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        text = plain(x["t"])
        block.append((x["i"], text))
        size += (2 + (PASSAGE - Q) // STEP) * len(text)
        if size >= BLOCK_GRAMS:
            yield block
            block, size = [], 0
    yield block


def stored_blocks(items: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Files of the blocks of items in the shared folder; the driver holds one block at a time."""
    folder, paths = mapped_folder(items.sparkSession, "benchmark"), []
    os.makedirs(folder)
    for block in blocks(items, id_col, text_col):
        paths.append(f"{folder}/{len(paths)}")
        with open(paths[-1], "wb") as f:
            pickle.dump(block, f)
    return paths


class Searcher:
    """Searches texts for the windows of all blocks; it holds those of one block at a time.

    Every other call goes through the blocks backwards and so starts with the block that it holds.
    """

    def __init__(self, paths: list[str], share: float):
        self.paths, self.share, self.held, self.windows = paths, share, -1, None

    def _hold(self, block: int) -> Windows:
        if block != self.held:
            self.windows = None
            with open(self.paths[block], "rb") as f:
                self.windows = Windows(pickle.load(f), self.share, passages=True)
            self.held = block
        return self.windows

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[Windows, tuple[np.ndarray, ...]]]:
        """(windows of a block, what `search` finds of it), in parts of about `PIECE` bytes of text."""
        if not texts:
            return
        part = np.cumsum([0, *(len(t) for t in texts)])[:-1] // PIECE
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        order = range(len(self.paths))
        for block in reversed(order) if self.held > 0 else order:
            windows = self._hold(block)
            for start, end in zip(starts, [*starts[1:], len(texts)], strict=True):
                d, *rest = search(windows, texts[start:end])
                yield windows, (d + start, *rest)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = BUDGET) -> DataFrame:
    """(id, item, windows, distance, start): each contaminated (document, item) with the number of windows found, and the
    least edits and first place (in bytes of the compared form) of a window."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("t"))
    paths = stored_blocks(items, item_id, item_text)
    chars = PIECE if len(paths) == 1 else MANY

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(paths, share)
        for rows in pieces(batches, chars):
            keys = rows.column(0).to_pylist()
            for windows, (d, w, start, edits) in searcher([plain(t) for t in rows.column(1).to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in d], pa.int64()), pa.array([windows.item[i] for i in w], pa.int64()), pa.array(start, pa.int64()), pa.array(w, pa.int64()), pa.array(edits, pa.int64())], schema=_HIT)

    found = arrow_map(source, make, "id long, item long, start long, window long, distance long")
    return found.groupBy("id", "item").agg(F.count_distinct("window").alias("windows"), F.min("distance").alias("distance"), F.min("start").alias("start"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = BUDGET) -> DataFrame:
    """The documents without those that a window of an item matches, with their columns; one pass, nothing is shuffled."""
    at = docs.columns.index(text_col)
    paths = stored_blocks(items, item_id, item_text)
    made: list[Searcher] = []

    def verdict(rows: pa.RecordBatch) -> np.ndarray:
        searcher = made[0] if made else made.append(Searcher(paths, share)) or made[0]
        stay = np.ones(rows.num_rows, bool)
        for _, (d, *_) in searcher([plain(t) for t in rows.column(at).to_pylist()]):
            stay[d] = False
        return stay

    return kept_rows(docs, verdict, PIECE // 2 if len(paths) == 1 else MANY)

"""Packing token ids into sequences: bounded-space online, and best-fit-decreasing.

`pack_online` reads each partition once.  It keeps a fixed number of open windows,
places what is left of a document after its full windows where it fits best, and,
when none fits, fills the fullest window with the head of the document, emits it and
goes on with the rest.  What is still open at the end of a partition (at most
`windows` windows) is written to the shared folder with its ids and packed again by
fewer tasks, until one task holds what is left.

`pack_decreasing` packs blocks of a partition by best-fit-decreasing: the
shortest free capacity that holds a segment is found in a segment tree over
capacities.  Its rows carry the ids of a whole sequence, the cumulative segment
lengths and the positions, which restart at each segment.

Defined results: a null text counts as the empty text, whose only id is the end
mark; a document of any length is cut without loss; repeated rows are packed each;
a null id stays null; an empty table returns no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_map, batch, pieces, text_of, written
from quillgraph.llm.tokens import END, encoder

LENGTH = 1024
#: Tokens of leftovers for each task that merges them.
MERGE_TOKENS = 4_000_000
_PIECE = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_())])
_PIECE_DDL = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"


class OpenWindows:
    """At most `limit` open windows of `length` ids; a piece is (id, start, doc_tokens, ids as bytes)."""

    def __init__(self, length: int, limit: int, first: int):
        self.length, self.limit, self.next = length, limit, first
        self.gaps: list[tuple[int, int]] = []  # (free ids, window), sorted: the best fit is a bisection away
        self.held: dict[int, list] = {}

    def _open(self) -> int:
        self.next += 1
        self.held[self.next - 1] = []
        return self.next - 1

    def _close(self, window: int) -> Iterator[tuple]:
        offset = 0
        for key, start, tokens, ids in self.held.pop(window):
            n = len(ids) // 4
            yield key, start, n, tokens, window, offset, ids
            offset += n

    def add(self, key: int | None, start: int, tokens: int, ids: bytes) -> Iterator[tuple]:
        """Place one piece; yields the rows of the windows that this fills."""
        length, at = self.length, 0  # `at` walks over the ids, so that a long text isn't copied for each window
        while len(ids) - at >= 4 * length:
            window = self._open()
            self.held[window].append((key, start + at // 4, tokens, ids[at : at + 4 * length]))
            yield from self._close(window)
            at += 4 * length
        while at < len(ids):
            n = (len(ids) - at) // 4
            fit = bisect_left(self.gaps, (n, -1))
            if fit < len(self.gaps):  # the smallest gap that holds it
                gap, window = self.gaps.pop(fit)
            elif len(self.held) < self.limit:
                gap, window = length, self._open()
            else:  # none fits: the fullest window takes the head and goes
                gap, window = self.gaps.pop(0)
            self.held[window].append((key, start + at // 4, tokens, ids[at : at + 4 * gap]))
            if gap > n:
                insort(self.gaps, (gap - n, window))
            else:
                yield from self._close(window)
            at += 4 * gap

    def rest(self, merge: bool = False) -> Iterator[tuple]:
        """The rows of the windows that are still open; `merge` first fills them up from each other, which leaves one at most."""
        self.gaps = []
        if merge:
            left, self.held, self.limit = self.held, {}, 1
            for held in left.values():
                for item in held:
                    yield from self.add(*item)
        self.gaps = []
        for window in list(self.held):
            yield from self._close(window)


def _rows(out: list[tuple], left: bool, with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 7
    crc = [zlib.crc32(x) for x in cols[6]]
    return batch(_PIECE, id=cols[0], start=cols[1], length=cols[2], ids_crc32=crc, doc_tokens=cols[3], sequence_id=cols[4], offset=cols[5], ids=cols[6] if left or with_ids else [None] * len(out), open=[left] * len(out))


def _packer(level: int, length: int, windows: int, with_ids: bool, last: bool, items):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = OpenWindows(length, windows, (level << 56) | (TaskContext.get().partitionId() << 32))
        for rows in batches:
            out = [row for item in items(rows) for row in packer.add(*item)]
            yield _rows(out, False, with_ids)
        yield _rows(list(packer.rest(last)), not last, with_ids)

    return make


def _documents(path: str | None):
    def items(rows: pa.RecordBatch) -> Iterator[tuple]:
        code = encoder(path).encode
        for part in pieces([rows]):
            for key, ids in zip(part.column(0).to_pylist(), code(part.column(1).to_pylist()), strict=True):
                yield key, 0, len(ids) // 4 + 1, ids + END

    return items


def _left(rows: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True)


def pack_online(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = 32, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row for each piece; ids is null unless `with_ids`."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("t"))
    done = written(arrow_map(source, _packer(0, length, windows, with_ids, False, _documents(path)), _PIECE_DDL), "packed")
    result, left, level = done.filter("not open"), done.filter("open"), 0
    while True:
        level += 1
        tasks = max(1, -(-(left.agg(F.sum("length")).first()[0] or 0) // MERGE_TOKENS))
        dealt = left.select("id", "start", "doc_tokens", "ids", F.col("sequence_id").alias("w"), "offset").repartition(tasks, "w").sortWithinPartitions("w", "offset")
        merged = arrow_map(dealt, _packer(level, length, windows, with_ids, tasks == 1, _left), _PIECE_DDL)
        if tasks == 1:
            return result.unionByName(merged).drop("open")
        merged = written(merged, "packed")
        result, left = result.unionByName(merged.filter("not open")), merged.filter("open")


class Capacities:
    """Bins by free capacity, with a segment tree that finds the smallest capacity of at least n."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = np.zeros(2 * self.leaves, np.int64).tolist()
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _count(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        self._count(capacity, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, bin) with the smallest capacity >= n, taken out; None if there is none."""
        at = self.leaves + n
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):  # up until a right neighbour holds a bin
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        which = self.bins[capacity].pop()
        self._count(capacity, -1)
        return capacity, which


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """The items of each bin: items by decreasing length (then by position), each into the fullest bin that holds it."""
    free, bins = Capacities(length), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        capacity, which = free.take(lengths[item]) or (length, len(bins))
        if which == len(bins):
            bins.append([])
        bins[which].append(item)
        if capacity > lengths[item]:
            free.put(capacity - lengths[item], which)
    return bins


_SEQ = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
_SEQ_DDL = "sequence_id long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"


def pack_decreasing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, pad: int = 0, block_tokens: int = 8_000_000, path: str | None = None) -> DataFrame:
    """One row for each sequence of `length` ids.

    `ids` is a row of the id matrix (little-endian unsigned 32-bit, `pad` after the
    last segment), `cu_seqlens` runs from 0 over the segment ends, `position_ids` (the same
    format) restarts at 0 with each segment and in the padding; `doc_ids` and
    `starts` say which ids of which document a segment holds.  A block of about
    `block_tokens` ids is packed at a time.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("t"))
    items = _documents(path)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        full = np.arange(length, dtype="<u4")
        block: list[tuple] = []
        size = 0

        def out(block: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
            rows = []
            for members in best_fit_decreasing([len(x[2]) // 4 for x in block], length):
                ends = np.cumsum([0, *(len(block[i][2]) // 4 for i in members)])
                ids, places = np.full(length, pad, "<u4"), full.copy()
                ids[: ends[-1]] = np.frombuffer(b"".join(block[i][2] for i in members), "<u4")
                for a in ends[1:]:
                    places[a:] = full[: length - a]
                rows.append((number, ids.tobytes(), ends.tolist(), places.tobytes(), [block[i][0] for i in members], [block[i][1] for i in members]))
                number += 1
                if len(rows) == 2048:
                    yield batch(_SEQ, **dict(zip(_SEQ.names, zip(*rows, strict=True), strict=True)))
                    rows = []
            if rows:
                yield batch(_SEQ, **dict(zip(_SEQ.names, zip(*rows, strict=True), strict=True)))

        for rows in batches:
            for key, _, _, ids in items(rows):
                block += [(key, at // 4, ids[at : at + 4 * length]) for at in range(0, len(ids), 4 * length)]
                size += len(ids) // 4
                if size >= block_tokens:
                    for x in out(block, number):
                        number += x.num_rows
                        yield x
                    block, size = [], 0
        if block:
            yield from out(block, number)

    return arrow_map(source, make, _SEQ_DDL)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the rows of `pack_decreasing` (id matrix, cumulative lengths, positions) as Parquet files of binary rows."""
    packed.write.option("parquet.enable.dictionary", "false").option("compression", "zstd").parquet(path)


def read_matrix(rows: list[bytes], length: int = LENGTH) -> np.ndarray:
    """The id matrix (or the matrix of positions) of the `ids` values of some rows."""
    return np.frombuffer(b"".join(bytes(r) for r in rows), "<u4").reshape(-1, length)

"""SimHash near-duplicates with a bit-sliced comparison of fingerprints.

A fingerprint has 64 bits; fingerprints that differ in at most `radius` bits are
linked, and a component is what links connect.  `near_duplicates` takes 64 bits and
finds every link.  `similar_documents` links texts by the exact Jaccard similarity of
their word shingles; see there.

How it runs:

1. Each text gives one fingerprint (one pass over the texts, nothing shuffled).
2. Equal fingerprints are one node, so copies cost nothing from here on.
3. Pigeonhole tables: 64 bits are cut into m blocks; two fingerprints within the
   radius agree on at least m - radius blocks, so each choice of m - radius blocks
   is a table, and linked fingerprints share a bucket in at least one of them.
   m grows with the number of nodes, which keeps buckets short at every size; no
   choice of m loses a link.
4. In a bucket the fingerprints are stored as vertical bit planes: one machine
   word holds the same bit of 64 fingerprints.  A query walks the planes and adds
   the differing bits into carry-save counters, 64 distances at a time; a block of
   64 is abandoned once all its distances exceed the radius.  A bucket with more than
   `TILE` nodes is cut into tiles, and pairs of tiles are dealt out as tasks; such buckets
   number at most (nodes x tables / TILE), so no bucket's nodes ever meet in one task.
5. A bucket returns a spanning star for each set of linked nodes in it, not
   all pairs, so a group of n near copies costs O(n) rows.
6. Components by alternating large-star and small-star steps, each written to the
   shared folder; no links are collected.  Sides of a join that a hub, a large component or a
   fingerprint of many copies could fill are written tables, which the adaptive skew join splits.

Defined results: a null text counts as the empty text; a text without words has
fingerprint zero and is linked like any other; repeated rows each return a row;
a null id takes part, and a component's id is its smallest non-null id (null if
it has none); an empty table returns no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import BROADCAST_IDS, arrow_map, note, pieces, place_for, scratch, stored, text_of, without, written

TILE = 8192
BITS = 64
#: Lanes of 64 bits of the wide fingerprints, and the standard deviations that their radius is beyond the mean of a pair at the similarity asked for.
LANES, SPREAD = 4, 6
#: Shingles of the texts that one task verifies against each other.
SHINGLES = 2_000_000
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of one text, repeats included; a shorter text is one shingle, one without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further independent hashes out of the first ones; lane 0 is the hash itself."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def signature(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """64 bits a lane: a bit is set if over half of the hashes have it."""
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            counts += np.unpackbits(_lane(hashes[at : at + 65536], lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of one text."""
    return signature(shingle_hashes(text, width))[0]


def _names(lanes: int) -> list[str]:
    return [f"f{k}" for k in range(lanes)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, lanes: int = 1) -> DataFrame:
    """(id, f0, ...): the lanes of the fingerprint as signed longs; with several lanes repeated shingles count once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            found = []
            for t in rows.column(1).to_pylist():
                hashes = shingle_hashes(t, width)
                found.append(signature(np.unique(hashes) if lanes > 1 else hashes, lanes))
            bits = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(bits[:, k].copy(), pa.int64()) for k in range(lanes))], names=["id", *_names(lanes)])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("t")), make, ", ".join(["id long", *(f"{n} long" for n in _names(lanes))]))


def tables(nodes: int, radius: int) -> list[int]:
    """Masks of the pigeonhole tables.

    The number of blocks grows with the nodes until a bucket of evenly spread
    fingerprints has about 1000 members; linked pairs share a bucket under every choice.
    """
    blocks = radius + 1
    while blocks < radius + 5 and nodes >> int(BITS * (blocks - radius) / blocks) > 1000:
        blocks += 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of (members, lanes): row k holds bit k of all fingerprints, 64 of them in a word."""
    padded = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def links(queries: np.ndarray, planes: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int, chunk: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (query, member) at a distance of at most `radius`; queries are (n, lanes).

    Query q is compared with the members first[q] to last[q] (exclusive).  The unit
    of work is one query against one word of each plane, 64 members at a time.
    """
    words = np.where(last > first, (last + 63) // 64 - first // 64, 0)
    levels = max(1, int(radius).bit_length())
    over = (1 << levels) - 1 - radius  # counters start here, so the carry out of the last one means "beyond the radius"
    all_set = np.uint64(0xFFFFFFFFFFFFFFFF)
    total = np.concatenate([[0], np.cumsum(words)])
    for at in range(0, int(total[-1]), chunk):
        unit = np.arange(at, min(at + chunk, int(total[-1])))
        q = np.searchsorted(total, unit, side="right") - 1
        w = first[q] // 64 + (unit - total[q])
        low, high = np.maximum(first[q] - w * 64, 0), np.minimum(last[q] - w * 64, 64)
        alive = np.left_shift(all_set, low.astype(np.uint64)) & np.right_shift(all_set, (64 - high).astype(np.uint64))
        counters = [np.full(len(unit), all_set if over >> k & 1 else 0, np.uint64) for k in range(levels)]
        for k in range(len(planes)):
            carry = planes[k, w] ^ (np.uint64(0) - (queries[q, k // 64] >> np.uint64(k % 64) & np.uint64(1)))
            for c in counters:  # carry-save: one half adder for each counter plane
                c ^= carry
                carry &= ~c
            alive &= ~carry
            if k % 8 == 7:  # abandon the blocks in which every member is beyond the radius
                left = np.flatnonzero(alive)
                if not len(left):
                    break
                if len(left) < len(alive):
                    q, w, alive, counters = q[left], w[left], alive[left], [c[left] for c in counters]
        else:
            hit, bit = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[hit], w[hit] * 64 + bit


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of n positions is connected with by the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            a, b = root[a], root[b]
            new = a != b
            a, b = a[new], b[new]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _bucket_edges(radius: int):
    """Batches of (group, side, node, lanes...) in the order of groups to the edges of a star over each linked set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            group, side, node = cols[:3]
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            sizes = np.diff(cut)
            start, end = np.repeat(cut[:-1], sizes), np.repeat(cut[1:], sizes)
            where = np.arange(len(group))
            twos = np.concatenate([[0], np.cumsum(side == 2)])
            # A tile against itself (side 0): later members only; side 1 against side 2.
            first = np.where(side == 0, where + 1, np.where(side == 1, end - (twos[end] - twos[start]), end))
            fps = np.stack(cols[3:], 1).view(np.uint64)
            root = roots(len(fps), links(fps, planes_of(fps), first, end, radius))
            linked = np.flatnonzero(root != where)
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], schema=_EDGE)

        for rows in batches:
            kept.append([c.to_numpy(zero_copy_only=False) for c in rows.columns])
            if sum(len(c[0]) for c in kept) < 4 * TILE:
                continue
            cols = [np.concatenate(c) for c in zip(*kept, strict=True)]
            end = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
            if end:
                yield out([c[:end] for c in cols])
            kept = [[c[end:] for c in cols]]
        if kept and sum(len(c[0]) for c in kept):
            yield out([np.concatenate(c) for c in zip(*kept, strict=True)])

    return make


def _signed(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def links_of(nodes: DataFrame, masks: list[list[int]], radius: int) -> DataFrame:
    """(a, b): for each bucket a star over each set of linked nodes; `nodes` has (node, f0, ...), each fingerprint once."""
    names = _names(len(masks[0]))
    keys = F.array(*[F.xxhash64(F.lit(n), *[F.col(c).bitwiseAND(_signed(m)) for c, m in zip(names, mask, strict=True) if m]) for n, mask in enumerate(masks)])
    return _star_links(nodes.select("node", *names, F.explode(keys).alias("bucket")), names, radius)


def _star_links(keyed: DataFrame, names: list[str], radius: int, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b) from (node, bucket, f0, ...); with `nodes` the fingerprints are only there, and joined to those that share a bucket."""
    given = [] if nodes is not None else names
    large = written(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > TILE), "large")  # at most one for each TILE rows
    large = large.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    side = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    tiled = keyed.join(side, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # Tile t meets itself and each other tile once: the lower one asks (side 1), the higher one answers (side 2).
    dealt = tiled.select("node", *given, "bucket", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select(
        F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other")).alias("grp"),
        F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).alias("side"),
        "node",
        *given,
    )
    alone = Window.partitionBy("grp").orderBy("side", "node")
    shared = dealt.withColumns({"last": F.lag("node").over(alone), "next": F.lead("node").over(alone)}).filter("last is not null or next is not null").select("grp", "side", "node", *given)
    if nodes is not None:
        shared = shared.join(nodes.select("node", *names), "node").select("grp", "side", "node", *names).repartition("grp").sortWithinPartitions("grp", "side", "node")
    return arrow_map(shared, _bucket_edges(radius), "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node that node is connected with; only nodes on an edge."""
    stars = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state, n = None, stars.count()

    def lowest(low: DataFrame) -> DataFrame:
        """A row for each node: broadcast, or a written table, so that a hub's rows on the other side can be split."""
        return F.broadcast(low) if n <= BROADCAST_IDS else written(low, "low")

    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return stars.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        state, n = now, now["n"]
    raise RuntimeError("components did not settle")


def _grouped(fps: DataFrame, lanes: int, node, masks_of, radius: int) -> DataFrame:
    """The rows of `fps` with `component`: the smallest id that links reach."""
    names = _names(lanes)
    nodes = written(fps.groupBy(*names).agg(F.min("id").alias("low")).withColumn("node", node), "nodes")
    return _named(fps, nodes, components(links_of(nodes.select("node", *names), masks_of(nodes.count()), radius)), names)


def _named(rows: DataFrame, nodes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the smallest id of the component of their node, which has the same `keys`, and with the component's root node.

    A component of one node is the node's smallest id; only linked nodes are joined by their root.
    """
    linked = written(found.join(nodes.select("node", "low"), "node"), "linked")
    linked = linked.unionByName(found.select(F.col("root").alias("node"), "root").distinct().join(nodes.select("node", "low"), "node"))
    least = written(linked.groupBy("root").agg(F.min("low").alias("least")), "least")
    placed = written(linked.select(F.col("node").alias("linked"), "root").distinct().join(least, "root").select("linked", "least", "root"), "placed")
    named = nodes.join(placed, nodes["node"] == placed["linked"], "left").select(*keys, F.when(F.col("linked").isNull(), F.col("low")).otherwise(F.col("least")).alias("component"), F.coalesce("root", "node").alias("root"))
    return rows.join(written(named, "named"), keys, "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component): the fingerprint as a signed long and the smallest id reachable."""
    fps = written(fingerprints(docs, id_col, text_col, width), "fp")
    found = _grouped(fps, 1, F.col("f0"), lambda n: [[m] for m in tables(n, radius)], radius)
    return found.select("id", F.col("f0").alias("fp"), "component")


def first_part(n: int, similarity: float) -> int:
    """So many of the n smallest hashes of a set that any set of the given similarity has one of them among its own first part."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64()))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(id, mark, f0, ..., whole, n, head, text): a hash of the text, the wide fingerprint, a hash of the whole set, its size, its smallest hashes, and the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for rows in pieces(batches):
            sets = [np.unique(shingle_hashes(t, width)) for t in rows.column(1).to_pylist()]
            bits = np.array([signature(x, LANES) for x in sets], np.uint64).view(np.int64)
            whole = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            cut = [first_part(len(x), similarity) for x in sets]
            cols = [rows.column(0), rows.column(2), *(pa.array(bits[:, k].copy()) for k in range(LANES)), pa.array(whole), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, _lists([x[:c] for x, c in zip(sets, cut, strict=True)]), rows.column(1)], names=["id", "mark", *_names(LANES), "whole", "n", "head", "text"])

    lanes = ", ".join(f"{n} long" for n in _names(LANES))
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("t"), F.xxhash64(text_of(docs, text_col)).alias("mark")), make, f"id long, mark long, {lanes}, whole long, n long, head array<long>, text string")


def similar_roots(sets: list[np.ndarray], heads: list[int], similarity: float) -> np.ndarray:
    """The smallest position that each set (sorted, distinct, not empty) is connected with by pairs of at least the similarity.

    Each set is compared with the later ones that share a hash of the first parts, but for those it is connected with already.
    """
    root, size = np.arange(len(sets)), np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate([x[:h] for x, h in zip(sets, heads, strict=True)]), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), heads)[np.argsort(code, kind="stable")]
    count = np.bincount(code)
    start = np.concatenate([[0], np.cumsum(count)])
    live, own = count > 1, np.concatenate([[0], np.cumsum(heads)])
    for i, mine in enumerate(sets):
        codes = code[own[i] : own[i + 1]]
        codes = codes[live[codes]]
        if not len(codes):
            continue
        holders = [holder[start[c] : start[c + 1]] for c in codes]
        near = np.unique(np.concatenate(holders))
        near = near[(near > i) & (root[near] != root[i])]
        near = near[np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i]) - 1e-9]
        if len(near):
            values = np.concatenate([sets[j] for j in near])
            same = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
            both = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
            joined = np.unique(np.append(root[near[both >= similarity * (size[i] + size[near] - both) - 1e-9]], root[i]))
            root[np.isin(root, joined)] = joined[0]
        for c, h in zip(codes, holders, strict=True):  # nothing is left to compare among connected sets
            live[c] = h[-1] > i and (root[h] != root[h[0]]).any()
    return root


def _verified(width: int, similarity: float):
    """Batches of (group, node, text) in the order of groups to the edges of a star over each connected set."""

    def edges(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        node, root = np.array(nodes), similar_roots(sets, [first_part(len(x), similarity) for x in sets], similarity)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], schema=_EDGE)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []
        for rows in pieces(batches):
            for g, node, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if g != group and nodes:
                    yield edges(nodes, sets)
                    nodes, sets = [], []
                group = g
                nodes.append(node)
                sets.append(np.unique(shingle_hashes(text, width)))
        if nodes:
            yield edges(nodes, sets)

    return make


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, mark, component, root): documents whose sets of word shingles have at least the given Jaccard similarity, linked through.
    `mark` is a hash of the text; a component is named by its root, as several may have the same smallest id.

    1. Equal sets are one node; a text without words has the empty set.
    2. Sets of similarity s share one of their n - ceil(s n) + 1 smallest hashes, so each such hash is a bucket.
    3. In a bucket the bit-sliced comparison of wide fingerprints links candidates: two sets of similarity s have cosine
       2s / (1 + s), hence differ in a share arccos(cosine) / pi of the bits on average; the radius is that share and
       `SPREAD` standard deviations, at which a binomial count loses one pair in a thousand million.
    4. Within each component of candidates, links are verified by the sets themselves, and the documents' components are those
       of verified links.  A component of more than `SHINGLES` shingles is cut into tiles, and pairs of tiles are dealt out.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits, names = 64 * LANES, _names(LANES)
    radius = int(share * bits + SPREAD * (bits * share * (1 - share)) ** 0.5)
    sets = written(shingle_sets(docs, id_col, text_col, width, similarity).withColumn("node", F.monotonically_increasing_id()), "sets", compression="zstd")
    nodes = written(sets.groupBy(*names, "whole").agg(F.min("id").alias("low"), F.min("node").alias("node"), F.first("n").alias("n")), "nodes")
    again = sets.select("node").join(nodes.select("node"), "node", "left_anti")
    few = sets.count() - nodes.count() <= BROADCAST_IDS
    own = without(sets.select("node", "head"), again, "node") if few else sets.select("node", "head").join(nodes.select("node"), "node", "left_semi")
    found = components(_star_links(own.select("node", F.explode("head").alias("bucket")), names, radius, nodes))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).distinct()
    members = written(members.join(nodes.select("node", "n"), "node"), "members")
    large = written(members.groupBy("root").agg(F.sum("n").alias("n")).filter(F.col("n") > SHINGLES), "large")  # at most one for each SHINGLES shingles
    large = large.select("root", F.ceil(F.col("n") / SHINGLES).cast("int").alias("tiles"))
    side = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    tiled = members.join(side, "root", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).filter("tiles = 1 or tile <> other")
    dealt = dealt.select("node", F.xxhash64("root", F.least("tile", "other"), F.greatest("tile", "other")).alias("grp"))
    spread = dealt.join(sets.select("node", "text"), "node").select("grp", "node", "text").repartition("grp").sortWithinPartitions("grp", "node")
    return _named(sets.select("id", "mark", *names, "whole"), nodes, components(arrow_map(spread, _verified(width, similarity), "a long, b long")), [*names, "whole"]).select("id", "mark", "component", "root")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each component of `similar_documents`, with its columns: of the one with the smallest id.

    Rows are told apart by id and text, so rows of one id with different texts go or stay by themselves; in a component
    the text with the smallest hash comes first under one id.  Of rows with the same id and text one stays; a row without an id
    can't be named as a copy, of such rows with equal texts one stays; a null text is as the empty text.
    """
    spark = docs.sparkSession
    with scratch(spark):
        found = stored(similar_documents(docs, id_col, text_col, width, similarity).select("id", "mark", "root"), path := place_for(spark, "components"))
    note(path)
    row = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    first = written(found.groupBy("root").agg(F.min(row).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first"), "first")
    side = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
    rest = found.join(side, "root").select("id", "mark", (F.col("id").isNotNull() & (F.col("first") != row)).alias("goes"))
    # What goes, and what stays in several rows: of those one is kept.
    told = written(rest.groupBy("id", "mark").agg(F.max("goes").alias("goes"), F.count("*").alias("n")).filter("goes or n > 1"), "told")
    gone = told.select(F.col("id").alias("quill_id"), F.col("mark").alias("quill_mark"), "goes")
    marked = docs.withColumn("quill_hash", F.xxhash64(text_of(docs, text_col)))

    def beside(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        others = F.broadcast(others) if others.count() <= BROADCAST_IDS else others
        return rows.join(others, F.col(id_col).cast("long").eqNullSafe(F.col("quill_id")) & (F.col("quill_hash") == F.col("quill_mark")), how)

    again = gone.filter("not goes")
    stay = beside(marked, gone, "left_anti")
    if not again.isEmpty():
        stay = stay.unionByName(beside(marked, again, "left_semi").dropDuplicates([id_col, "quill_hash"]))
    return stay.select(*docs.columns)

"""Searches from both ends, titles by shared grams and trees of any depth, against plain Python."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from quillgraph.operators import graph, listing, shelf, titles
from quillgraph.operators.graph import shared_folder
from quillgraph.operators.paths import between
from tests.test_graph import cites_of, works_of


def plain_path(near, source, target, most):
    """Level by level from the source, each frontier in id order."""
    came, front = {source: None}, [source]
    for _ in range(most):
        new = []
        for a in sorted(front):
            for b in near.get(a, {}):
                if b not in came:
                    came[b] = a
                    new.append(b)
        front = new
        if target in came:
            break
    if target not in came:
        return None
    path = [target]
    while came[path[-1]] is not None:
        path.append(came[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("direction", ["backward", "either"])
def test_paths_of_many_pairs(spark, direction):
    rng = random.Random(7)
    ids = [f"W{i:02}" for i in range(40)]
    links = sorted({(rng.choice(ids), rng.choice(ids[:30])) for _ in range(70)} | {(x, "W00") for x in ids[1:20]})  # a hub, loops, both ways
    near: dict = {}
    for a, b in links:
        near.setdefault(a, {})[b] = True
    if direction == "either":
        for a, b in links:
            near.setdefault(b, {}).setdefault(a, False)
    asked = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)] + [("W01", "W01"), ("W01", "gone"), (None, "W01")]
    asked.append(asked[0])
    works, cites = works_of(spark, {x: {} for x in ids}), cites_of(spark, links)
    got: dict = {}
    for r in between(works, cites, spark.createDataFrame(asked, "source string, target string"), 5, direction).collect():
        got.setdefault((r["source"], r["target"]), []).append((r["hop"], r["work_id"], r["cites"]))
    want = {}
    for a, b in set(asked):
        if a in ids and b in ids and (path := plain_path(near, a, b, 5)):
            want[a, b] = [(n, x, near[path[n - 1]][x] if n else None) for n, x in enumerate(path)]
    assert any(len(p) > 4 for p in want.values())
    assert {k: sorted(v) for k, v in got.items()} == want
    none = between(works, cites, spark.createDataFrame([], "source string, target string"), 5, direction)
    assert none.count() == 0


def test_paths_stop_at_the_last_step(spark):
    works, cites = works_of(spark, {f"W{i}": {} for i in range(6)}), cites_of(spark, [(f"W{i}", f"W{i + 1}") for i in range(5)])
    pairs = spark.createDataFrame([("W0", "W5"), ("W1", "W5")], "source string, target string")
    assert {r["source"] for r in between(works, cites, pairs, 4).collect()} == {"W1"}
    assert between(works, cites, pairs, 0).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_titles_equal_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcab") for _ in range(rng.randint(1, 7)))
    held = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["a", "A!", "ab", "新型材料研究", "...", "", None, "the the the the", "a" * 400]
    held += held[:10]

    def edited(t):
        t = list(t)
        for _ in range(rng.randint(0, 1 + len(t) // 7)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "b", "xc"])
        return "".join(t)

    asked = [(i, edited(t or "")) for i, t in enumerate(held)] + [(0, "A"), (900, None), (901, "新型材料研究")]
    key = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    groups: dict = {}
    for i, t in enumerate(held):
        groups.setdefault(key(t), []).append(f"P{i:03}")
    want = []
    for i, t in asked:
        for k, ids in groups.items():
            if (a := key(t)) and k and (s := 1 - distance(a, k) / max(len(a), len(k))) >= 0.85:
                want.append((i, a == k, s, len(ids), min(ids)))
    works = spark.createDataFrame([(f"P{i:03}", t) for i, t in enumerate(held)], "work_id string, title string")
    got = [tuple(r) for r in titles.similar(spark.createDataFrame(asked, "ask int, typed string"), works).collect()]
    assert sorted(got) == sorted(want) and sum(not w[1] for w in want) > 30
    with pytest.raises(ValueError):
        titles.similar(spark.createDataFrame(asked, "ask int, typed string"), works, 0.5)
    assert titles.similar(spark.createDataFrame(asked, "ask int, typed string"), works.limit(0)).count() == 0


def test_trees_have_any_depth(spark):
    rows = [(i, f"c{i}", i - 1 if i > 1 else None) for i in range(1, 131)] + [(200, "b", 201), (201, "a", 200), (202, "below", 200), (300, "lost", 999)]
    tree = spark.createDataFrame(rows, "id int, name string, parent_id int")
    found = {r["id"]: r["level"] for r in listing.tree(tree).collect()}
    assert found == {i: i - 1 for i in range(1, 131)}
    assert {r["id"] for r in listing.circles(tree).collect()} == {200, 201, 202, 300}
    assert {r["id"] for r in listing.subtree(tree, 100).collect()} == set(range(100, 131))
    assert {r["id"] for r in listing.subtree(tree, 201).collect()} == {200, 201, 202}
    pairs = [tuple(r) for r in listing.closure(tree).select("ancestor", "id").collect()]
    want = {(a, b) for b in range(1, 131) for a in range(1, b + 1)} | {(a, b) for a in (200, 201) for b in (200, 201, 202)} | {(202, 202), (300, 300)}
    assert len(pairs) == len(want) and set(pairs) == want
    empty = tree.limit(0)
    assert listing.tree(empty).count() == listing.closure(empty).count() == listing.subtree(empty, 1).count() == 0


def test_mirrored_collections_of_any_depth(spark):
    rows = [(f"k{i}", f"k{i - 1}" if i else "elsewhere", None if i == 3 else f"n{i}") for i in range(80)]
    kept = shelf.mirrored(spark.createDataFrame(rows, "key string, parent string, name string"), spark.createDataFrame([("k70",)], "key string"))
    found = {r["key"]: (r["level"], r["parent"], r["name"]) for r in kept.collect()}
    assert len(found) == 70 and found["k69"] == (69, "k68", "n69") and found["k3"][2] == "Untitled collection" and found["k0"][1] is None


def test_both_ways_agree(spark):
    works, cites = works_of(spark, {f"W{i}": {} for i in range(1, 8)}), cites_of(spark, [("W1", "W2"), ("W1", "W3"), ("W2", "W4"), ("W3", "W4"), ("W4", "W6")])
    one = graph.shortest_path(works, cites, "W1", "W6")
    rows = between(works, cites, spark.createDataFrame([("W1", "W6")], "source string, target string")).orderBy("hop").collect()
    assert [(r["work_id"], r["cites"]) for r in rows] == one


def test_pairs_of_one_target_share_its_levels(spark):
    """100 sources with 40 works each, of which one leads on; the target has 30 works before it."""
    edges = [(f"s{i}", f"w{i}.{j}") for i in range(100) for j in range(40)] + [(f"w{i}.0", f"m{i % 30}") for i in range(100)] + [(f"m{k}", "t") for k in range(30)]
    ids = sorted({x for e in edges for x in e})
    works = spark.createDataFrame([(i, i) for i in ids], "work_id string, index_id string")
    folder = f"{shared_folder(spark).removeprefix('file:')}/cut/*/*.parquet"
    earlier = set(glob.glob(folder))
    found = between(works, spark.createDataFrame(edges, "from_work string, to_work string"), spark.createDataFrame([(f"s{i}", "t") for i in range(100)], "source string, target string"))
    assert sorted(r["work_id"] for r in found.filter("hop = 2").collect()) == sorted(f"m{i % 30}" for i in range(100))
    at_target = lambda f: {"node", "d"} <= set(pq.ParquetFile(f).schema.names)
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in set(glob.glob(folder)) - earlier if at_target(f)) < 1000


def test_long_titles_of_few_words_are_not_taken_apart_into_rows(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeiourstln") for _ in range(5)) for _ in range(40)]
    held = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(200)]
    works = spark.createDataFrame([(f"w{i}", t) for i, t in enumerate(held)], "work_id string, title string")
    asked = spark.createDataFrame([(i, "x" + held[i][: -3 * i] + held[i][-2 * i :]) for i in range(1, 15)], "ask int, typed string")
    folder = f"{shared_folder(spark).removeprefix('file:')}/cut/*/*.parquet"
    earlier = set(glob.glob(folder))
    found = {(r["ask"], r["work_id"]) for r in titles.similar(asked, works).collect()}
    assert found == {(i, f"w{i}") for i in range(1, 15)}
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in set(glob.glob(folder)) - earlier) < 3 * len(held)


def test_typed_titles_are_broadcast_in_rounds_of_bounded_size(spark, monkeypatch):
    rng = random.Random(8)
    held = ["".join(rng.choice("abcdef") for _ in range(30)) for _ in range(40)]
    works = spark.createDataFrame([(f"w{i}", t) for i, t in enumerate(held)], "work_id string, title string")
    asked = spark.createDataFrame([(i, "x" + t) for i, t in enumerate(held) for _ in range(2)], "ask int, typed string")
    monkeypatch.setattr(titles, "LETTERS", 3000)  # three rows of 71 for each of 40 titles: 8,520 in three rounds
    sizes, broadcast = [], titles.F.broadcast
    monkeypatch.setattr(titles.F, "broadcast", lambda df: sizes.append(df.selectExpr("sum(typed_n + 40)").first()[0]) or broadcast(df))
    found = [(r["ask"], r["work_id"]) for r in titles.similar(asked, works).collect()]
    assert sorted(found) == sorted((i, f"w{i}") for i in range(40) for _ in range(2))
    assert len(sizes) == 3 and sum(sizes) == 40 * 3 * 71 and max(sizes) < 2 * 3000

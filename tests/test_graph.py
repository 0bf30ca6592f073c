"""Graph operators on small graphs, with ties, cycles and stubs."""

import random

import pytest

from quillgraph.operators import graph

WORK = "work_id string, index_id string, title string, year int, venue string, type string, cited_by_count long, hydrated boolean, is_seed boolean, depth int, unresolved boolean, arrival long"


def works_of(spark, rows):
    """rows: id -> overrides."""
    base = {"title": None, "year": None, "venue": None, "type": None, "cited_by_count": 0, "hydrated": False, "is_seed": False, "depth": None, "unresolved": False}
    return spark.createDataFrame([tuple((base | {"index_id": k, "arrival": n} | v | {"work_id": k})[c.split()[0]] for c in WORK.split(", ")) for n, (k, v) in enumerate(rows.items())], WORK)


def cites_of(spark, pairs):
    seen = {}
    rows = []
    for a, b in pairs:
        seen[a] = seen.get(a, 0) + 1
        rows.append((a, b, seen[a]))
    return spark.createDataFrame(rows, "from_work string, to_work string, ref_seq int")


LINEAGE = [("W1", "W2"), ("W1", "W3"), ("W2", "W4"), ("W3", "W4"), ("W3", "W5"), ("W4", "W6"), ("W7", "W1")]


@pytest.fixture(scope="module")
def lineage(spark):
    return works_of(spark, {f"W{i}": {} for i in range(1, 8)}), cites_of(spark, LINEAGE)


def test_paths(lineage):
    works, cites = lineage
    assert graph.shortest_path(works, cites, "W1", "W6") == [("W1", None), ("W2", True), ("W4", True), ("W6", True)]  # W2 before W3
    assert graph.shortest_path(works, cites, "W6", "W1", direction="forward")[-1] == ("W1", False)
    assert graph.shortest_path(works, cites, "W1", "W6", max_hops=2) is None
    assert graph.shortest_path(works, cites, "W5", "W2") is None
    assert [w for w, _ in graph.shortest_path(works, cites, "W5", "W2", direction="either")] == ["W5", "W3", "W1", "W2"]
    assert graph.shortest_path(works, cites, "W1", "W1") == [("W1", None)]
    assert graph.shortest_path(works, cites, "W1", "nothing") is None
    assert graph.lineage(works, cites, "W6", "W1") == [("W6", None), ("W4", False), ("W2", False), ("W1", False)]


def test_cycle_ends(spark):
    n = 60
    works = works_of(spark, {f"W{1000 + i}": {} for i in range(n)} | {"W9999": {}})
    cites = cites_of(spark, [(f"W{1000 + i}", f"W{1000 + (i + k) % n}") for i in range(n) for k in range(1, 6)])
    assert graph.shortest_path(works, cites, "W1000", "W9999", max_hops=50) is None
    assert len(graph.shortest_path(works, cites, "W1000", "W1030", max_hops=50)) == 7


def test_frontier(spark):
    seeds = {f"W{i}": {"hydrated": True, "is_seed": True, "depth": 0} for i in (1, 2, 3)}
    works = works_of(spark, seeds | {f"W{i}": {"depth": 1} for i in (20, 21, 30, 31, 32)})
    cites = cites_of(spark, [("W1", "W20"), ("W1", "W21"), ("W1", "W30"), ("W2", "W20"), ("W2", "W21"), ("W2", "W31"), ("W3", "W20"), ("W3", "W32")])
    rows = graph.frontier(works, cites, 10, 3).collect()
    assert [(r["work_id"], r["in_degree"]) for r in rows] == [("W20", 3), ("W21", 2), ("W30", 1), ("W31", 1), ("W32", 1)]
    out = spark.createDataFrame([("W20",)], "work_id string")
    assert [r["work_id"] for r in graph.frontier(works, cites, 1, 3, exclude=out).collect()] == ["W21"]
    assert graph.beyond(works, cites, 0).first()["n"] == 5


def test_reference_cap(spark):
    works = works_of(spark, {"W1": {"hydrated": True, "depth": 0}, "W2": {"hydrated": True, "depth": 0}} | {f"W{100 + i}": {"depth": 1} for i in range(20)})
    pairs = [("W1", f"W{100 + i}") for i in range(20)]
    assert [r["work_id"] for r in graph.frontier(works, cites_of(spark, pairs), 50, 3, 5).collect()] == [f"W{100 + i}" for i in range(5)]
    more = graph.frontier(works, cites_of(spark, [*pairs, ("W2", "W119")]), 50, 3, 5).collect()
    assert (more[0]["work_id"], more[0]["in_degree"], len(more)) == ("W119", 2, 6)
    assert graph.frontier(works, cites_of(spark, pairs), 50, 3, 0).count() == 20


@pytest.mark.parametrize("turned", [False, True])
def test_two_topics(spark, turned):
    clique = lambda x: [(f"{x}{i}", f"{x}{j}") for i in range(6) for j in range(i)]
    pairs = [*clique("A"), *clique("B"), ("B5", "A0"), ("A3", "LEAF"), ("A1", "A1")]
    rows = graph.groups(cites_of(spark, pairs[::-1] if turned else pairs)).collect()
    members = {a: {r["work_id"] for r in rows if r["anchor"] == a and not r["fringe"]} for a in {r["anchor"] for r in rows}}
    assert members == {"A0": {f"A{i}" for i in range(6)}, "B0": {f"B{i}" for i in range(6)}}
    assert [r["work_id"] for r in rows if r["fringe"]] == ["LEAF"]
    assert next(r["cited_within"] for r in rows if r["work_id"] == "A0") == 5


def test_small_clusters_are_left_out(spark):
    assert graph.groups(cites_of(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("D", "E")])).count() == 0


def test_orphans(spark):
    works = works_of(spark, {"W1": {"hydrated": True}, "W5": {"hydrated": True}, "W2": {}, "W3": {}, "W4": {}})
    cites = cites_of(spark, [("W1", "W2"), ("W1", "W3"), ("W1", "W4"), ("W5", "W3")])
    gone, files = spark.createDataFrame([("W1",)], "work_id string"), spark.createDataFrame([("W4",)], "work_id string")
    assert [r[0] for r in graph.orphans(works, cites, gone, files).collect()] == ["W2"]


def test_expansion_keeps_its_budget(spark):
    index = works_of(spark, {f"W{i}": {"title": f"t{i}"} for i in range(1, 12)})
    refs = cites_of(spark, [("W1", f"W{i}") for i in (2, 3, 4)] + [("W2", "W5"), ("W3", "W5"), ("W4", "W404"), ("W5", "W6")])
    works = works_of(spark, {"W1": {"hydrated": True, "is_seed": True, "depth": 0}, "W2": {"depth": 1}, "W3": {"depth": 1}, "W4": {"depth": 1}})
    cites = cites_of(spark, [("W1", "W2"), ("W1", "W3"), ("W1", "W4")])
    grown, edges, counts = graph.expand(works, cites, index, refs, budget=3, batch=2)
    assert (counts["tried"], counts["stop"]) == (3, "budget-exhausted")
    grown, edges, counts = graph.expand(works, cites, index, refs, budget=50, batch=2)
    assert counts["missing"] == 1 and counts["stop"] in ("frontier-empty", "max-depth")
    assert {r["work_id"] for r in grown.filter("unresolved").collect()} == {"W404"}
    assert edges.count() == edges.distinct().count()


def test_expansion_follows_a_plain_loop(spark):
    """Many small batches over a random index: what is tried, fetched, linked and how deep, as a loop over dicts finds it."""
    rng = random.Random(8)
    ids = [f"W{i:03}" for i in range(120)]
    lists = {w: rng.sample(ids, rng.randint(0, 9)) for w in ids[:110]}
    refs = spark.createDataFrame([(w, t, k + 1) for w, ts in lists.items() for k, t in enumerate(ts)], "from_work string, to_work string, ref_seq int")
    index = works_of(spark, {w: {"hydrated": True, "depth": 0} for w in lists})
    start = {"W000": 0, "W001": 0} | {t: 1 for w in ("W000", "W001") for t in lists[w] if t not in ("W000", "W001")}
    links = {(w, t): k + 1 for w in ("W000", "W001") for k, t in enumerate(lists[w]) if w != t}
    works = works_of(spark, {w: {"hydrated": d == 0, "is_seed": d == 0, "depth": d} for w, d in start.items()})
    cites = spark.createDataFrame([(*e, k) for e, k in links.items()], "from_work string, to_work string, ref_seq int")
    depth, fetched, gone, tried = dict(start), {"W000", "W001"}, set(), 0
    while tried < 40:
        rows = []
        for w, d in depth.items():
            ranks = [k for (_, t), k in links.items() if t == w]
            if w not in fetched and w not in gone and d <= 4 and ranks and min(ranks) <= 6:
                rows.append((-len(ranks), d, w))
        batch = [w for _, _, w in sorted(rows)[: min(7, 40 - tried)]]
        if not batch:
            break
        tried += len(batch)
        fetched |= {w for w in batch if w in lists}
        gone |= {w for w in batch if w not in lists}
        lower = {}
        for w in batch:
            for k, t in enumerate(lists.get(w, ())):
                if t != w:
                    links.setdefault((w, t), k + 1)
                    if t not in batch:
                        lower[t] = min(lower.get(t, 99), depth[w] + 1)
        for t, d in lower.items():
            depth[t] = min(depth.get(t, 99), d)
    grown, edges, counts = graph.expand(works, cites, index, refs, budget=40, max_depth=4, max_refs=6, batch=7)
    assert {tuple(r) for r in edges.select("from_work", "to_work", "ref_seq").collect()} == {(*e, k) for e, k in links.items()}
    assert {r["work_id"]: (r["depth"], r["hydrated"], r["unresolved"]) for r in grown.collect()} == {w: (d, w in fetched, w in gone) for w, d in depth.items()}
    assert (counts["tried"], counts["missing"]) == (tried, len(gone))


def test_ego_map(lineage):
    works, cites = lineage
    found = graph.ego_map(works.withColumn("hydrated", works.work_id != "W9"), cites, "W4")
    assert {w for _, w, step in found if step == 1} == {"W2", "W3", "W6"}
    assert len({w for _, w, _ in found}) == len(found)


def test_registered_communities_take_all_links(spark, data):
    from quillgraph.queries import QUERIES
    from quillgraph.views import view

    cites = view(spark, data, "cites")
    rows = QUERIES["gr9_groups"](spark, data).collect()
    assert {"C", "O"} <= {r["work_id"][0] for r in rows}
    assert {r["work_id"] for r in rows} == {r["work_id"] for r in graph.groups(cites).select("work_id").collect()}
    assert QUERIES["api7_group_names"](spark, data).count() == graph.groups(cites, least=3).select("anchor").distinct().count()

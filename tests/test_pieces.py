"""Queries whose tasks must not grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import graph
from quillgraph.queries import QUERIES


def test_pieces_are_small_and_stay_in_their_session(spark, data):
    path, before = f"{data}/lineitem.parquet", spark.conf.get("spark.sql.files.maxPartitionBytes")
    own = graph.in_pieces(spark, 20_000)
    assert own.read.parquet(path).rdd.getNumPartitions() >= 5 and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    back = graph.cut(own.range(10), spark)
    assert back.sparkSession is spark and back.count() == 10


def test_bylines_read_their_rows_once(spark, data):
    rows = QUERIES["dml9_bylines"](spark, data)
    assert rows.sparkSession is spark
    assert not [f for f in rows.inputFiles() if "lineitem" in f]
    moved = F.col("work_id").like("P1%")
    assert {tuple(r) for r in rows.groupBy(moved).agg(F.min("position")).collect()} == {(True, 5), (False, 0)}


def test_ranges_look_at_a_part_once(spark):
    """The column against the plain function, and each part of a marker neither matched nor split by an expression more than once."""
    import random

    from quillgraph.functions import identity

    rng = random.Random(5)
    texts = ["", " ", "3", " 3-5 , 9 ", "5-3", "1-30", "1-31", "1--2", "1-2-3", "-1", "1-", "1,,2", "1,", ",1", "1 2", "1000", "999", "3\n", "\t4", "2 – 4; 7—8", "1,2,x", "1" + ", 2-3" * 20_000, "1" + " " * 20_000 + "x"]
    texts += ["".join(rng.choice(["1", "2", "7", "12", "-", "–", "—", ",", ";", " ", "\n", "x"] if rng.random() < 0.3 else ["1", "-", "3", ",", " 5 ", "; 2"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    found = rows.select("i", identity.ranges_of(F.col("t")).alias("n"))
    assert {r["i"]: r["n"] for r in found.collect()} == {i: identity.expand_ranges(t) for i, t in enumerate(texts)} | {len(texts): None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "regexp_extract" not in plan


def test_citing_with_hubs_and_repeats(spark):
    """Both ways, by one shuffle and by parts, against plain Python: repeats count once, unknown works not at all, ties go by id."""
    import random

    rng = random.Random(3)
    works = {f"W{i}": rng.randint(0, 3) for i in range(60)}
    pairs = [(f"W{rng.randrange(70)}", rng.choice(["hub", "hub", f"T{rng.randrange(8)}", None])) for _ in range(600)] + [(None, "T1"), ("W1", "lone"), ("W1", "lone")]
    rows, links = spark.createDataFrame(list(works.items()), "work_id string, cited_by_count long"), spark.createDataFrame(pairs, "from_work string, to_work string").repartition(5)
    want = set()
    for origin in {o for _, o in pairs}:
        by = sorted({w for w, o in pairs if o == origin and w in works}, key=lambda w: (-works[w], w))
        want |= {(origin, w, k + 1, len(by)) for k, w in enumerate(by[:4])}
    for crowd in (0, 100, 10_000):
        got = [tuple(r) for r in graph.citing(rows, links, 4, crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_citing_shuffles_links_once(spark, data):
    from quillgraph.views import view

    both = [{tuple(r) for r in view(spark, data, name).select("from_work", "to_work").distinct().collect()} for name in ("links", "edges")]
    assert both[0] == both[1]
    plan = QUERIES["src5_citing"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan

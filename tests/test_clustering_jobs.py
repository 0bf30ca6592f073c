"""Clustering: a step is one job, not one for each shuffle, and the caller's settings stay as they are."""

from quillgraph.operators import graph


def test_a_step_of_clustering_is_few_jobs(spark):
    ring = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    pairs = spark.createDataFrame([*ring("a"), *ring("b"), ("a0", "b0")], "a string, b string")
    adaptive, jobs = spark.conf.get("spark.sql.adaptive.enabled"), spark._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    found = {r["work_id"]: r["cluster"] for r in graph.clustered(pairs).collect()}
    assert jobs() - before < 150  # 216 when each shuffle was a job
    assert found == {f"{p}{i}": f"{p}0" for p in "ab" for i in range(4)}
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive


def test_mapped_moves_are_the_moves_of_the_joins(spark, monkeypatch):
    import random

    from quillgraph.operators import moves

    monkeypatch.setattr(moves, "FEW", 100)  # many parts
    rng = random.Random(5)
    pairs = {tuple(sorted((f"n{rng.randrange(150)}", f"n{rng.randrange(150)}"))) for _ in range(500)}
    pairs |= {tuple(sorted((f"n{i}", f"n{i - i % 10 + rng.randrange(10)}"))) for i in range(150) for _ in range(4)}
    table = spark.createDataFrame(sorted(p for p in pairs if p[0] != p[1]), "a string, b string")
    rows = lambda mapped: {r["work_id"]: r["cluster"] for r in graph.clustered(table, mapped=mapped).collect()}
    assert rows(True) == rows(False)
    assert moves.folder_of("hdfs://store/a") is None and moves.folder_of("file:///tmp/a") == moves.folder_of("file:/tmp/a") == "/tmp/a"

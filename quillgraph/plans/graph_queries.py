"""Queries over the citation graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import graph
from quillgraph.operators.paths import between
from quillgraph.queries import query
from quillgraph.views import view

_ID = "w.index_id NULLS LAST, w.work_id"


def _neighbours(forward: bool):
    def run(spark, d):
        works, cites = view(spark, d, "works"), view(spark, d, "cites")
        return graph.neighbours(works, cites, works.select("work_id"), forward).select("origin", "rank", "work_id")

    return run


for _name, _near, _far, _fwd in (("gr1_cited", "from_work", "to_work", True), ("gr1_citing", "to_work", "from_work", False)):
    query(_name, f"SELECT c.{_near} AS origin, CAST(row_number() OVER (PARTITION BY c.{_near} ORDER BY w.hydrated DESC, w.year DESC NULLS LAST, {_ID}) AS INT) AS rank, w.work_id FROM {{cites}} c JOIN {{works}} w ON w.work_id = c.{_far}")(_neighbours(_fwd))


@query(
    "gr3_frontier",
    """WITH r AS (SELECT to_work, count(*) AS in_degree, min(ref_seq) AS best FROM {cites} GROUP BY to_work)
    SELECT w.work_id, w.index_id, w.depth, r.in_degree FROM {works} w JOIN r ON r.to_work = w.work_id
    WHERE NOT w.hydrated AND NOT w.unresolved AND w.index_id IS NOT NULL AND w.depth <= 3 AND r.best <= 2 ORDER BY in_degree DESC, depth, index_id LIMIT 50""",
)
def gr3_frontier(spark, d):
    return graph.frontier(view(spark, d, "works"), view(spark, d, "cites"), 50, 3, 2)


@query("gr4_beyond", "SELECT count(*) AS n FROM {works} WHERE NOT hydrated AND NOT unresolved AND index_id IS NOT NULL AND depth > 2 AND work_id IN (SELECT to_work FROM {cites})")
def _gr4(spark, d):
    return graph.beyond(view(spark, d, "works"), view(spark, d, "cites"), 2)


@query(
    "gr2_levels",
    """WITH RECURSIVE t AS (SELECT 'C1' AS work_id, 0 AS hops UNION SELECT c.to_work, t.hops + 1 FROM {cites} c JOIN t ON t.work_id = c.from_work WHERE t.hops < 5)
    SELECT work_id, min(hops) AS hops FROM t GROUP BY work_id""",
)
def _gr2(spark, d):
    start = spark.createDataFrame([("C1",)], "work_id string")
    return graph.levels(view(spark, d, "works"), view(spark, d, "cites"), start, 5).select("work_id", "hops")


@query(
    "gr2_levels_parents",
    """WITH l1 AS (SELECT c.to_work AS work_id, c.from_work AS parent FROM {cites} c WHERE from_work = 'C1'),
    l2 AS (SELECT c.to_work AS work_id, min(c.from_work) AS parent FROM {cites} c JOIN l1 ON l1.work_id = c.from_work GROUP BY 1),
    l3 AS (SELECT c.to_work AS work_id, min(c.from_work) AS parent FROM {cites} c JOIN l2 ON l2.work_id = c.from_work GROUP BY 1)
    SELECT * FROM (SELECT 'C1' AS work_id, 0 AS hops, NULL AS parent UNION ALL SELECT work_id, 1, parent FROM l1 UNION ALL SELECT work_id, 2, parent FROM l2 UNION ALL SELECT work_id, 3, parent FROM l3)""",
)
def _gr2_parents(spark, d):
    start = spark.createDataFrame([("C1",)], "work_id string")
    return graph.levels(view(spark, d, "works"), view(spark, d, "cites"), start, 3).select("work_id", "hops", "parent")


@query("gr2b_lineage", """WITH l1 AS (SELECT DISTINCT to_work AS w FROM {cites} WHERE from_work = 'O1'), l2 AS (SELECT to_work AS w, min(from_work) AS p FROM {cites} JOIN l1 ON l1.w = from_work GROUP BY 1), l3 AS (SELECT to_work AS w, min(from_work) AS p FROM {cites} JOIN l2 ON l2.w = from_work GROUP BY 1),
    l4 AS (SELECT to_work AS w, min(from_work) AS p FROM {cites} JOIN l3 ON l3.w = from_work GROUP BY 1), x AS (SELECT l4.w AS r, l3.w AS n, l2.w AS s, l2.p FROM l4 JOIN l3 ON l3.w = l4.p JOIN l2 ON l2.w = l3.p WHERE l4.w = 'R0')
    SELECT CAST(i AS INT) AS step, CASE i WHEN 0 THEN r WHEN 1 THEN n WHEN 2 THEN s WHEN 3 THEN p ELSE 'O1' END AS work_id, CASE WHEN i > 0 THEN FALSE END AS cites FROM x, range(5) t(i)""")
def _gr2b(spark, d):
    """The path from an order to the region of its first supplier, either way round."""
    path = graph.lineage(view(spark, d, "works"), view(spark, d, "cites"), "R0", "O1", 6) or []
    return spark.createDataFrame([(i, w, f) for i, (w, f) in enumerate(path)], "step int, work_id string, cites boolean")


@query("gr9_degrees", "WITH p AS (SELECT DISTINCT least(from_work, to_work) AS a, greatest(from_work, to_work) AS b FROM {cites} WHERE from_work <> to_work), e AS (SELECT a AS work_id FROM p UNION ALL SELECT b FROM p), n AS (SELECT work_id, count(*) AS n FROM e GROUP BY 1) SELECT n >= 2 AS linked, count(*) AS works FROM n GROUP BY 1")
def _gr9_degrees(spark, d):
    pairs = view(spark, d, "cites").filter("from_work <> to_work").select(F.least("from_work", "to_work").alias("a"), F.greatest("from_work", "to_work").alias("b")).distinct()
    ends = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))
    return ends.groupBy((F.col("n") >= 2).alias("linked")).agg(F.count("*").alias("works"))


@query("gr9_groups")
def _gr9(spark, d):
    """Communities of the whole graph."""
    return graph.groups(view(spark, d, "cites"))


@query("gr11_ego_map", """WITH nb AS (SELECT from_work AS origin, to_work AS work_id FROM {cites} UNION SELECT to_work, from_work FROM {cites}),
    r AS (SELECT nb.origin, w.work_id, w.hydrated, row_number() OVER (PARTITION BY nb.origin ORDER BY w.hydrated DESC, w.year DESC NULLS LAST, w.index_id NULLS LAST, w.work_id) AS place FROM nb JOIN {works} w USING (work_id)),
    near AS (SELECT * FROM r WHERE origin = 'O1' AND place <= 12), up AS (SELECT work_id FROM near WHERE hydrated ORDER BY place LIMIT 6),
    far AS (SELECT r.origin, r.work_id, row_number() OVER (PARTITION BY r.origin ORDER BY r.place) AS k FROM r JOIN up ON up.work_id = r.origin WHERE r.work_id <> 'O1' AND r.work_id NOT IN (SELECT work_id FROM near))
    SELECT origin AS parent, work_id, 1 AS step FROM near UNION ALL SELECT origin, work_id, 2 FROM far WHERE k <= 3""")
def _gr11(spark, d):
    found = graph.ego_map(view(spark, d, "works"), view(spark, d, "cites"), "O1")
    return spark.createDataFrame(found, "parent string, work_id string, step int")


@query("gr5_expand")
def _gr5(spark, d):
    """Expansion from the seeds, fetching from the derived index under a budget of 300 ids."""
    works, cites = view(spark, d, "works"), view(spark, d, "cites")
    start = works.filter("depth <= 2")
    grown, edges, counts = graph.expand(start, cites.filter("from_work LIKE 'C%' OR from_work LIKE 'O%'"), works, cites, 300, 3)
    return grown.agg(F.count("*").alias("works"), F.count_if("hydrated").alias("fetched")).withColumns({"edges": F.lit(edges.count()), "tried": F.lit(counts["tried"]), "stop": F.lit(counts["stop"])})


@query("gr13_pairs", "SELECT from_work, to_work FROM {cites}")
def _gr13(spark, d):
    return view(spark, d, "cites").select("from_work", "to_work")


@query(
    "gr14_surroundings",
    """WITH o AS (SELECT c.from_work AS work_id, count(*) AS cites, count(*) FILTER (NOT w.hydrated AND NOT w.unresolved) AS unfetched, count(*) FILTER (NOT w.hydrated AND w.title IS NULL) AS untitled FROM {cites} c JOIN {works} w ON w.work_id = c.to_work GROUP BY 1),
    i AS (SELECT to_work AS work_id, count(*) AS cited_here FROM {cites} GROUP BY 1)
    SELECT work_id, cited_by_count, coalesce(cites, 0) AS cites, coalesce(unfetched, 0) AS unfetched, coalesce(untitled, 0) AS untitled, coalesce(cited_here, 0) AS cited_here FROM {works} LEFT JOIN o USING (work_id) LEFT JOIN i USING (work_id)""",
)
def _gr14(spark, d):
    return graph.surroundings(view(spark, d, "works"), view(spark, d, "cites"))


@query("agg6_around", "SELECT c.from_work AS work_id, count(*) AS cites, count(*) FILTER (NOT w.hydrated AND NOT w.unresolved) AS unfetched, count(*) FILTER (NOT w.hydrated AND w.title IS NULL) AS untitled FROM {cites} c JOIN {works} w ON w.work_id = c.to_work GROUP BY 1")
def _agg6(spark, d):
    return graph.surroundings(view(spark, d, "works"), view(spark, d, "cites")).filter("cites > 0").select("work_id", "cites", "unfetched", "untitled")


@query("win1_reference_rank", "SELECT from_work, to_work, CAST(row_number() OVER (PARTITION BY from_work ORDER BY ref_seq) AS INT) AS place FROM {cites}")
def _win1(spark, d):
    return view(spark, d, "cites").withColumn("place", F.row_number().over(Window.partitionBy("from_work").orderBy("ref_seq"))).select("from_work", "to_work", "place")


@query("set1_undirected", "SELECT from_work AS a, to_work AS b, TRUE AS cites FROM {cites} UNION ALL SELECT to_work, from_work, FALSE FROM {cites}")
def _set1(spark, d):
    return graph.directed(view(spark, d, "cites"), "either")


@query("jn1_cited_works", "SELECT c.from_work, c.to_work, w.title, w.hydrated FROM {cites} c JOIN {works} w ON w.work_id = c.to_work")
def _jn1(spark, d):
    works = view(spark, d, "works").select(F.col("work_id").alias("to_work"), "title", "hydrated")
    return view(spark, d, "cites").join(works, "to_work").select("from_work", "to_work", "title", "hydrated")


@query("srt4_ranked_page", "SELECT origin, work_id, CAST(rank AS INT) AS rank, n AS total FROM (SELECT c.from_work AS origin, w.work_id, row_number() OVER (PARTITION BY c.from_work ORDER BY w.hydrated DESC, w.cited_by_count DESC, w.year DESC NULLS LAST, w.index_id NULLS LAST, w.work_id) AS rank, count(*) OVER (PARTITION BY c.from_work) AS n FROM {cites} c JOIN {works} w ON w.work_id = c.to_work) x WHERE rank <= 3")
def _srt4(spark, d):
    works, cites = view(spark, d, "works"), view(spark, d, "cites")
    found = cites.select(F.col("from_work").alias("origin"), "to_work").join(works, F.col("to_work") == works.work_id)
    order = Window.partitionBy("origin").orderBy(F.col("hydrated").desc(), F.col("cited_by_count").desc(), F.col("year").desc(), *graph.id_order())
    totals = found.groupBy("origin").agg(F.count("*").alias("total"))
    return found.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").join(totals, "origin").select("origin", "work_id", "rank", "total")


@query("snk2_nodes", "SELECT CAST(row_number() OVER (ORDER BY index_id NULLS LAST, work_id) AS BIGINT) AS place, work_id FROM {works} WHERE hydrated")
def _snk2(spark, d):
    from quillgraph.sources.exports import numbered

    return numbered(view(spark, d, "works").filter("hydrated"), graph.id_order(), "place").select((F.col("place") + 1).alias("place"), "work_id")


@query("snk3_edges", "SELECT from_work, to_work FROM {cites} WHERE to_work IN (SELECT work_id FROM {works} WHERE hydrated)")
def _snk3(spark, d):
    fetched = view(spark, d, "works").filter("hydrated").select(F.col("work_id").alias("to_work"))
    return view(spark, d, "cites").join(fetched, "to_work", "left_semi").select("from_work", "to_work").orderBy("from_work", "to_work")


@query("snk4_whole_graph", "WITH n AS (SELECT work_id, row_number() OVER (ORDER BY arrival) - 1 AS i FROM {works}) SELECT a.i AS source, b.i AS target FROM {cites} c JOIN n a ON a.work_id = c.from_work JOIN n b ON b.work_id = c.to_work")
def _snk4(spark, d):
    from quillgraph.sources.exports import whole_graph

    return whole_graph(view(spark, d, "works"), view(spark, d, "cites"))[1]


@query("gr2_paths", """WITH pr AS (SELECT 'C' || c_custkey AS source, 'N' || c_nationkey AS target FROM {customer}),
    f1 AS (SELECT p.source, p.target, c.to_work AS w FROM pr p JOIN {cites} c ON c.from_work = p.source), f2 AS (SELECT f.source, f.target, c.to_work AS w, min(f.w) AS p FROM f1 f JOIN {cites} c ON c.from_work = f.w GROUP BY 1, 2, 3),
    f3 AS (SELECT f.source, f.target, c.to_work AS w, min(f.w) AS p FROM f2 f JOIN {cites} c ON c.from_work = f.w GROUP BY 1, 2, 3), f4 AS (SELECT f.source, f.target, min(f.w) AS p FROM f3 f JOIN {cites} c ON c.from_work = f.w AND c.to_work = f.target GROUP BY 1, 2),
    x AS (SELECT f4.source, f4.target, f2.p AS o, f3.p AS p, f4.p AS s FROM f4 JOIN f3 ON f3.source = f4.source AND f3.target = f4.target AND f3.w = f4.p JOIN f2 ON f2.source = f4.source AND f2.target = f4.target AND f2.w = f3.p)
    SELECT source, target, CAST(i AS INT) AS hop, CASE i WHEN 0 THEN source WHEN 1 THEN o WHEN 2 THEN p WHEN 3 THEN s ELSE target END AS work_id, CASE WHEN i > 0 THEN TRUE END AS cites FROM x, range(5) t(i)""")
def _gr2_paths(spark, d):
    """The path from each customer to a supplier of the customer's own nation, all searched from both ends at once."""
    pairs = view(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("source"), F.concat(F.lit("N"), "c_nationkey").alias("target"))
    return between(view(spark, d, "works"), view(spark, d, "cites"), pairs)

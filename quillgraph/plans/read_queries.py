"""Composite reads: what the tools and screens show, each a fixed plan over the operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import identity, presentation
from quillgraph.operators import graph, search, stats
from quillgraph.queries import query
from quillgraph.views import view


@query("src5_citing", "SELECT origin, work_id, CAST(place AS INT) AS place, total FROM (SELECT c.to_work AS origin, w.work_id, row_number() OVER (PARTITION BY c.to_work ORDER BY w.cited_by_count DESC, w.work_id) AS place, count(*) OVER (PARTITION BY c.to_work) AS total FROM {cites} c JOIN {works} w ON w.work_id = c.from_work) x WHERE place <= 10")
def _src5(spark, d):
    """The ten most cited works that cite each work, and how many there are."""
    return graph.citing(view(spark, d, "works"), view(spark, d, "links"), 10)


@query("jn8_by_either_id", "SELECT work_id FROM {works} WHERE work_id IN ('C1', 'R0') OR index_id IN ('O1', 'P5')")
def _jn8(spark, d):
    works = view(spark, d, "works")
    ids = lambda x, name: spark.createDataFrame([(i,) for i in x], f"{name} string")
    return works.join(ids(("C1", "R0"), "work_id"), "work_id", "left_semi").select("work_id").union(works.join(ids(("O1", "P5"), "index_id"), "index_id", "left_semi").select("work_id")).distinct()


@query("jn10_counts", "SELECT w.work_id, (SELECT count(*) FROM {cites} c WHERE c.to_work = w.work_id) AS cited_here, (SELECT count(*) FROM {authorship} a WHERE a.work_id = w.work_id) AS authors FROM {works} w")
def _jn10(spark, d):
    cited = view(spark, d, "cites").groupBy(F.col("to_work").alias("work_id")).agg(F.count("*").alias("cited_here"))
    people = view(spark, d, "authorship").groupBy("work_id").agg(F.count("*").alias("authors"))
    return view(spark, d, "works").select("work_id").join(cited, "work_id", "left").join(people, "work_id", "left").fillna(0)


@query("set2_upsert", "SELECT from_work, to_work FROM {cites} UNION SELECT to_work, from_work FROM {cites} WHERE from_work LIKE 'S%'")
def _set2(spark, d):
    cites = view(spark, d, "cites").select("from_work", "to_work")
    back = cites.filter("from_work LIKE 'S%'").select(F.col("to_work").alias("from_work"), F.col("from_work").alias("to_work"))
    return cites.unionByName(back.join(cites, ["from_work", "to_work"], "left_anti"))


@query("dml16_refile", "SELECT collection_id, work_id FROM {collection_work} WHERE collection_id <> 107 UNION SELECT 108, work_id FROM {collection_work} WHERE collection_id = 107")
def _dml16(spark, d):
    """Moving the works of one collection into another: keyed removal and upsert."""
    from quillgraph.operators import merge

    rows = view(spark, d, "collection_work")
    old = rows.filter("collection_id = 107")
    return merge.upsert(merge.removed(rows, old, ["collection_id", "work_id"]), old.withColumn("collection_id", F.lit(108)), ["collection_id", "work_id"])


@query("fts11_parts", "SELECT s_suppkey, 'x ' AS plain, s_name AS marked FROM supplier")
def _fts11(spark, d):
    parts = presentation.marked_parts(F.concat(F.lit("x [["), "s_name", F.lit("]]")))
    return view(spark, d, "supplier").select("s_suppkey", F.get(parts, F.lit(0))["text"].alias("plain"), F.get(parts, F.lit(1))["text"].alias("marked"))


@query("scal5_index_id", "SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN 'W' || o_orderkey END AS index_id FROM orders")
def _scal5(spark, d):
    return view(spark, d, "orders").select("o_orderkey", identity.index_id_of(F.concat(F.lit("https://openalex.org/works/w"), F.col("o_orderkey").cast("string"), F.lit("?x=1#y"))).alias("index_id"))


@query("scal6_arxiv", "SELECT p_partkey, CASE WHEN p_size % 20 BETWEEN 1 AND 12 THEN '20' || lpad(CAST(p_size % 20 AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') END AS arxiv_id FROM part")
def _scal6(spark, d):
    raw = F.concat(F.lit("20"), F.lpad((F.col("p_size") % 20).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit("v3.pdf"))
    return view(spark, d, "part").select("p_partkey", identity.arxiv_of(raw).alias("arxiv_id"))


@query("scal12_links", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'https://a/' || p_partkey || ',https://b/' || p_partkey ELSE 'https://b/' || p_partkey END AS links FROM part")
def _scal12(spark, d):
    place = lambda host, open_, version: F.struct(F.concat(F.lit(f"https://{host}/"), F.col("p_partkey").cast("string")).alias("url"), open_.alias("is_oa"), F.lit(version).alias("version"))
    listed = F.array(place("b", F.lit(True), "preprint"), place("a", F.col("p_size") % 2 == 0, "published"), place("c", F.lit(False), "published"), place("b", F.lit(True), "accepted"))
    return view(spark, d, "part").select("p_partkey", F.array_join(identity.pdf_links(place("b", F.lit(True), "accepted"), listed), ",").alias("links"))


@query("scal17_best_page", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'https://doi.org/10.1/' || p_partkey WHEN p_size % 3 = 1 THEN 'https://land/' || p_partkey ELSE 'https://openalex.org/P' || p_partkey END AS page FROM part")
def _scal17(spark, d):
    key, k = F.col("p_partkey").cast("string"), F.col("p_size") % 3
    return view(spark, d, "part").select("p_partkey", identity.best_page(F.when(k == 0, F.concat(F.lit("10.1/"), key)), F.when(k == 1, F.concat(F.lit("https://land/"), key)), F.lit(None).cast("string"), F.concat(F.lit("P"), key)).alias("page"))


@query("scal19_reasons", """SELECT w.work_id, CASE WHEN w.unresolved THEN 'not in the index' WHEN p.availability IS NULL THEN 'links not looked up' WHEN p.availability <> 'open' THEN 'no open PDF: ' || p.availability WHEN a.outcome IS NOT NULL THEN 'last try: ' || a.outcome ELSE 'not tried' END AS reason
    FROM {works} w LEFT JOIN {pdf_state} p USING (work_id) LEFT JOIN (SELECT work_id, arg_max(outcome, attempt_id) AS outcome FROM {attempts} GROUP BY 1) a USING (work_id) WHERE w.type = 'part'""")
def _scal19(spark, d):
    last = view(spark, d, "attempts").groupBy("work_id").agg(F.max_by("outcome", "attempt_id").alias("outcome"))
    rows = view(spark, d, "works").filter("type = 'part'").join(view(spark, d, "pdf_state"), "work_id", "left").join(last, "work_id", "left")
    return rows.select("work_id", presentation.no_pdf_reason(F.col("unresolved"), F.lit(True), F.col("availability"), F.col("outcome")).alias("reason"))


@query("api3_neighbour_sentences", "SELECT from_work, to_work, sentence, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY from_work, to_work ORDER BY page, start, sentence) AS place FROM {mentions}) x WHERE place <= 3")
def _api3(spark, d):
    place = F.row_number().over(Window.partitionBy("from_work", "to_work").orderBy("page", "start", "sentence"))
    return view(spark, d, "mentions").withColumn("place", place).filter("place <= 3").select("from_work", "to_work", "sentence", "place")


@query("api7_group_names")
def _api7(spark, d):
    found = graph.groups(view(spark, d, "cites"), least=3)
    people = view(spark, d, "authorship").join(view(spark, d, "authors"), "author_id")
    return presentation.group_names(found, view(spark, d, "works"), people)


@query("snk8_recent_calls", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _snk8(spark, d):
    """The last hundred entries of the call log (the limit is the feature)."""
    return view(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id", "event_type")


@query("agg10_outcomes_by_work", "SELECT work_id, outcome, count(*) AS n FROM {attempts} GROUP BY ALL")
def _agg10(spark, d):
    return view(spark, d, "attempts").groupBy("work_id", "outcome").agg(F.count("*").alias("n"))


@query("exp2_nearest_paper", "WITH e AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, label AS paper, max(round(list_sum(list_transform(list_zip(qe, embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2])), 4)) AS best FROM q, e GROUP BY ALL) SELECT query_id, paper, best FROM s")
def _exp2(spark, d):
    """Papers (labels) by their nearest passage (vector), for each query vector among all rows."""
    from quillgraph.operators.vectors import best_of_groups

    rows = view(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("paper"), "embedding")
    return best_of_groups(rows.filter("id % 100 = 0"), rows, "paper").select("query_id", "paper", F.round("best", 4).alias("best"))


@query("api5_library_stats", """SELECT 'works' AS what, '' AS item, count(*) AS n FROM {works} UNION ALL SELECT 'edges', '', count(*) FROM {cites} UNION ALL SELECT 'text', status, count(*) FROM {read_state} GROUP BY status
    UNION ALL SELECT 'no text', work_id, 1 FROM (SELECT work_id FROM {read_state} WHERE status = 'no-text' ORDER BY work_id LIMIT 20) a UNION ALL SELECT 'other version', work_id, 1 FROM (SELECT DISTINCT work_id FROM {files} WHERE version = 'other' AND NOT missing ORDER BY work_id LIMIT 20) b
    UNION ALL SELECT 'duplicates', key, n FROM (SELECT title AS key, count(*) AS n FROM {works} WHERE type = 'order' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, key LIMIT 20) c""")
def _api5(spark, d):
    """Counts, and the first twenty (the limit is the feature) works without text, files of another version, and titles in common."""
    return stats.library_stats(view(spark, d, "works"), view(spark, d, "cites"), view(spark, d, "read_state"), view(spark, d, "files"), view(spark, d, "works").filter("type = 'order'").groupBy(F.col("title").alias("item")).agg(F.count("*").alias("n")).filter("n > 1"))

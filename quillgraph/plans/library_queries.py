"""Queries over the library: listings, facets, counts, joins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.textnorm import title_key
from quillgraph.operators import listing, stats
from quillgraph.operators.listing import Query
from quillgraph.queries import query
from quillgraph.views import view

LIBRARY = ("files", "read_state", "collections", "collection_work", "favourites", "labels_of", "authorship", "authors")


def library(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: view(spark, d, n) for n in LIBRARY}


def _filtered(name: str, q, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        asked = q(spark) if callable(q) else q
        return listing.conditions(view(spark, d, "works"), asked, library(spark, d)).select("work_id")

    query(name, f"SELECT work_id FROM {{works}} w WHERE {where}")(run)


_PDF = "NOT f.missing AND lower(f.path) LIKE '%.pdf'"
_filtered("flt1_seeds", Query(seeds=True), "w.is_seed")
_filtered("flt2_with_pdf", Query(with_pdf=True), f"EXISTS (SELECT 1 FROM {{files}} f WHERE f.work_id = w.work_id AND {_PDF})")
_filtered("flt3_without_text", Query(without_text=True), "EXISTS (SELECT 1 FROM {read_state} t WHERE t.work_id = w.work_id AND t.status <> 'ok')")
_filtered("flt4_collection", Query(collection="NATION_7"), "EXISTS (SELECT 1 FROM {collection_work} c JOIN {collections} n ON n.id = c.collection_id WHERE c.work_id = w.work_id AND n.name = 'NATION_7')")
_filtered("flt5_subtree", Query(subtree=3), "w.work_id IN (SELECT work_id FROM {collection_work} c JOIN {collections} n ON n.id = c.collection_id WHERE n.id = 3 OR n.parent_id = 3)")
_filtered("flt6_starred", Query(starred=True), "w.work_id IN (SELECT work_id FROM {favourites})")
_filtered("flt7_labels", Query(labels=("BUILDING", "rich")), "(SELECT count(DISTINCT label) FROM {labels_of} l WHERE l.work_id = w.work_id AND l.label IN ('BUILDING', 'rich')) = 2")
_filtered("flt8_years", Query(year_from=1994, year_to=1996), "w.year BETWEEN 1994 AND 1996")
_filtered("flt9_authors", Query(authors=("Supplier#000000001", "Supplier#000000002")), "w.work_id IN (SELECT work_id FROM {authorship} a JOIN {authors} n USING (author_id) WHERE n.name IN ('Supplier#000000001', 'Supplier#000000002'))")
_filtered("flt10_venues", Query(venues=("BUILDING", "F")), "w.venue IN ('BUILDING', 'F')")
_filtered("flt11_among", lambda s: Query(among=s.createDataFrame([("C1",), ("O7",), ("X",)], "work_id string")), "w.work_id IN ('C1', 'O7', 'X')")
_filtered("flt11_among_none", lambda s: Query(among=s.createDataFrame([], "work_id string")), "FALSE")
_filtered("flt12_title", Query(title="URGENT"), "contains(lower(w.title), 'urgent')")


@query("flt13_unread", "SELECT work_id, status FROM {read_state} WHERE status <> 'ok'")
def _flt13(spark, d):
    return view(spark, d, "read_state").filter("status <> 'ok'").select("work_id", "status").orderBy("status", "work_id")


@query("flt14_have_pdfs", f"SELECT work_id, EXISTS (SELECT 1 FROM {{files}} f WHERE f.work_id = w.work_id AND {_PDF}) AS has_pdf FROM {{works}} w WHERE w.type = 'part'")
def _flt14(spark, d):
    has = listing.pdfs(view(spark, d, "files")).select("work_id").distinct().withColumn("has_pdf", F.lit(True))
    return view(spark, d, "works").filter("type = 'part'").select("work_id").join(has, "work_id", "left").fillna({"has_pdf": False})


@query("flt15_deleted_among", "SELECT DISTINCT work_id FROM {attempts} WHERE work_id IN (SELECT work_id FROM {read_state} WHERE status = 'gibberish')")
def _flt15(spark, d):
    return view(spark, d, "attempts").join(view(spark, d, "read_state").filter("status = 'gibberish'"), "work_id", "left_semi").select("work_id").distinct()


_CITED = "(SELECT to_work, count(*) AS n FROM {cites} GROUP BY to_work)"
_ORDERS = {
    "default": "w.is_seed DESC, coalesce(c.n, 0) DESC, w.arrival",
    "newest": "coalesce(w.year, 0) = 0, w.year DESC, w.arrival",
    "oldest": "coalesce(w.year, 0) = 0, w.year, w.arrival",
    "title": "coalesce(w.title, '') = '', lower(w.title), w.arrival",
    "cited": "coalesce(c.n, 0) DESC, w.arrival",
    "citedworld": "w.cited_by_count DESC, w.arrival",
    "added": "w.arrival DESC",
    "arrived": "w.arrival",
}


def _ordered(name: str, spark: SparkSession, d: str) -> DataFrame:
    """The second page of 50 of a listing order (paging is the feature)."""
    from pyspark.sql.window import Window

    works = view(spark, d, "works").join(listing.cited_here(view(spark, d, "cites")), "work_id", "left").fillna({"cited_here": 0})
    page = works.orderBy(*listing.order_of(name)).offset(50).limit(50)
    return page.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*listing.order_of(name))).cast("int")).select("place", "work_id", "cited_here")


for _name, _sql in _ORDERS.items():
    query(f"srt1_{_name}", f"SELECT CAST(row_number() OVER (ORDER BY {_sql}) AS INT) - 50 AS place, work_id, coalesce(c.n, 0) AS cited_here FROM {{works}} w LEFT JOIN {_CITED} c ON c.to_work = w.work_id QUALIFY row_number() OVER (ORDER BY {_sql}) BETWEEN 51 AND 100")(partial(_ordered, _name))

_LIST = """SELECT w.work_id, w.title, w.year, w.venue, coalesce(c.n, 0) AS cited_here,
    (SELECT count(*) FROM {cites} x WHERE x.from_work = w.work_id) AS "references",
    (SELECT n.name FROM {authorship} a JOIN {authors} n USING (author_id) WHERE a.work_id = w.work_id AND a.position = 0) AS first_author,
    (SELECT count(*) FROM {authorship} a WHERE a.work_id = w.work_id) AS n_authors,
    (SELECT min(path) FROM {files} f WHERE f.work_id = w.work_id AND NOT f.missing AND lower(f.path) LIKE '%.pdf') AS pdf,
    (SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM {labels_of} l WHERE l.work_id = w.work_id) AS labels,
    (SELECT status FROM {read_state} t WHERE t.work_id = w.work_id) AS text_status,
    w.work_id IN (SELECT work_id FROM {favourites}) AS starred"""


@query("api1_list", f"{_LIST} FROM {{works}} w LEFT JOIN {_CITED} c ON c.to_work = w.work_id")
def _api1(spark, d):
    rows = listing.list_works(view(spark, d, "works"), view(spark, d, "cites"), Query(), library(spark, d))
    return rows.select("work_id", "title", "year", "venue", "cited_here", "references", "first_author", "n_authors", "pdf", "labels", "text_status", "starred")


@query(
    "agg4_facets",
    """WITH years AS (SELECT 'year' AS facet, CAST(year AS VARCHAR) AS value, count(DISTINCT work_id) AS n FROM {works} WHERE venue IN ('F', 'BUILDING') AND coalesce(year, 0) <> 0 GROUP BY 2),
    venues AS (SELECT 'venue' AS facet, venue AS value, count(DISTINCT work_id) AS n FROM {works} WHERE year BETWEEN 1993 AND 1997 AND venue IS NOT NULL GROUP BY 2),
    topv AS (SELECT * FROM (SELECT * FROM venues ORDER BY n DESC, value LIMIT 8) UNION SELECT * FROM venues WHERE value IN ('F', 'BUILDING') UNION SELECT 'venue', x, 0 FROM (VALUES ('F'), ('BUILDING')) t(x) WHERE x NOT IN (SELECT value FROM venues)),
    people AS (SELECT 'author' AS facet, n.name AS value, count(DISTINCT w.work_id) AS n FROM {works} w JOIN {authorship} a USING (work_id) JOIN {authors} n USING (author_id) WHERE w.year BETWEEN 1993 AND 1997 AND w.venue IN ('F', 'BUILDING') GROUP BY 2 ORDER BY n DESC, value LIMIT 8),
    every AS (SELECT *, row_number() OVER (ORDER BY CAST(value AS INT)) AS place FROM years UNION ALL SELECT *, row_number() OVER (ORDER BY n DESC, value) FROM topv UNION ALL SELECT *, row_number() OVER (ORDER BY n DESC, value) FROM people)
    SELECT facet, CAST(place AS INT) AS place, value, n, (SELECT count(*) FROM {works} WHERE year BETWEEN 1993 AND 1997 AND venue IN ('F', 'BUILDING')) AS total FROM every""",
)
def _agg4(spark, d):
    return listing.facets(view(spark, d, "works"), Query(year_from=1993, year_to=1997, venues=("F", "BUILDING")), library(spark, d))


@query(
    "agg1_summary",
    """SELECT count(*) AS works, count(*) FILTER (hydrated) AS fetched, count(*) FILTER (NOT hydrated) AS stubs, count(*) FILTER (NOT hydrated AND unresolved) AS unresolved, count(*) FILTER (is_seed) AS seeds,
    (SELECT count(*) FROM {cites}) AS edges, count(*) FILTER (hydrated AND work_id NOT IN (SELECT from_work FROM {cites})) AS dead_ends,
    floor((count(*) FILTER (hydrated) - count(*) FILTER (hydrated AND work_id NOT IN (SELECT from_work FROM {cites}))) / count(*) FILTER (hydrated) * 100 + 0.5) / 100 AS coverage FROM {works}""",
)
def _agg1(spark, d):
    return stats.summary(view(spark, d, "works"), view(spark, d, "cites"))


@query("agg2_stats", "SELECT (SELECT count(*) FROM {works}) AS works, (SELECT count(*) FROM {works} WHERE NOT hydrated) AS stubs, (SELECT count(*) FROM {cites}) AS edges")
def _agg2(spark, d):
    return stats.summary(view(spark, d, "works"), view(spark, d, "cites")).select("works", "stubs", "edges")


@query("agg3_coverage", "SELECT type, floor((count(*) FILTER (hydrated) - count(*) FILTER (hydrated AND work_id NOT IN (SELECT from_work FROM {cites}))) / greatest(count(*) FILTER (hydrated), 1) * 100 + 0.5) / 100 AS coverage FROM {works} GROUP BY type")
def _agg3(spark, d):
    citing = view(spark, d, "cites").select(F.col("from_work").alias("work_id"), F.lit(True).alias("citing")).distinct()
    n = view(spark, d, "works").join(citing, "work_id", "left").groupBy("type").agg(F.count_if("hydrated").alias("f"), F.count_if(F.col("hydrated") & F.col("citing").isNull()).alias("e"))
    return n.select("type", stats.coverage(F.col("f"), F.col("e")).alias("coverage"))


@query("agg5_in_degree", "SELECT to_work AS work_id, count(*) AS cited_here FROM {cites} GROUP BY to_work")
def _agg5(spark, d):
    return listing.cited_here(view(spark, d, "cites"))


@query("agg7_text_status", "SELECT status, count(*) AS n FROM {read_state} GROUP BY status")
def _agg7(spark, d):
    return stats.histogram(view(spark, d, "read_state"), "status")


@query("agg8_contexts", "SELECT count(*) AS edges, count(m.n) AS with_sentence, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS mentions FROM {cites} c LEFT JOIN (SELECT from_work, to_work, count(*) AS n FROM {mentions} GROUP BY 1, 2) m USING (from_work, to_work) WHERE c.from_work IN (SELECT work_id FROM {read_state} WHERE status = 'ok')")
def _agg8(spark, d):
    return stats.context_counts(view(spark, d, "cites"), view(spark, d, "mentions"), view(spark, d, "read_state"))


@query("agg9_pdf_states", "SELECT CASE WHEN w.unresolved THEN 'not in index' ELSE coalesce(p.availability, 'not looked up') END AS availability, count(*) AS n FROM {works} w LEFT JOIN {pdf_state} p USING (work_id) GROUP BY 1")
def _agg9(spark, d):
    return stats.pdf_counts(view(spark, d, "works"), view(spark, d, "pdf_state"))


@query("agg10_outcomes", "SELECT outcome, count(*) AS n FROM {attempts} GROUP BY outcome")
def _agg10(spark, d):
    return stats.histogram(view(spark, d, "attempts"), "outcome")


@query("agg11_on_disk", f"SELECT count(DISTINCT work_id) AS n FROM {{files}} f WHERE {_PDF}")
def _agg11(spark, d):
    return listing.pdfs(view(spark, d, "files")).agg(F.count_distinct("work_id").alias("n"))


@query("agg12_labels", "SELECT n.name, count(DISTINCT l.work_id) AS uses FROM {label_names} n LEFT JOIN {labels_of} l ON l.label = n.name GROUP BY n.name")
def _agg12(spark, d):
    return stats.label_counts(view(spark, d, "label_names"), view(spark, d, "labels_of"))


@query("agg13_collections", "SELECT c.id, c.name, count(DISTINCT f.work_id) AS works FROM {collections} c LEFT JOIN {collections} b ON b.id = c.id OR b.parent_id = c.id LEFT JOIN {collection_work} f ON f.collection_id = b.id GROUP BY c.id, c.name")
def _agg13(spark, d):
    return stats.collection_counts(view(spark, d, "collections"), view(spark, d, "collection_work"))


@query("agg14_label_lists", "SELECT work_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM {labels_of} GROUP BY work_id")
def _agg14(spark, d):
    return view(spark, d, "labels_of").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


@query("agg15_import_state", "SELECT w.work_id, CASE max(CASE WHEN p.availability = 'open' THEN 1 WHEN p.availability IS NOT NULL THEN 0 END) WHEN 1 THEN 'matched' WHEN 0 THEN 'unmatched' ELSE '' END AS state FROM {works} w LEFT JOIN {pdf_state} p USING (work_id) WHERE w.type = 'part' GROUP BY 1")
def _agg15(spark, d):
    matched = F.max(F.when(F.col("availability") == "open", 1).when(F.col("availability").isNotNull(), 0))
    return view(spark, d, "works").filter("type = 'part'").join(view(spark, d, "pdf_state"), "work_id", "left").groupBy("work_id").agg(F.when(matched == 1, "matched").when(matched == 0, "unmatched").otherwise("").alias("state"))


_KEY = "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')"


@query("dml21_duplicates", f"SELECT k AS key, count(*) AS size, string_agg(work_id, ',' ORDER BY year NULLS FIRST, work_id) AS members, min(title) AS title FROM (SELECT *, regexp_replace(lower(t), '[^a-zà-öø-ÿœß0-9]', '', 'g') AS k FROM (SELECT doc_id, 'D' || doc_id AS work_id, CAST(NULL AS INT) AS year, string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[1] AS t FROM documents) AS a) AS b WHERE length(k) >= 20 GROUP BY k HAVING count(*) >= 2")
def _dml21(spark, d):
    docs = view(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("work_id"), F.lit(None).cast("int").alias("year"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.lit(True).alias("hydrated"))
    return stats.duplicates(docs, title_key(F.col("title")))


@query("agg17_readable", "SELECT count(*) AS n FROM {read_state} WHERE status = 'ok' AND work_id IN (SELECT to_work FROM {cites} WHERE from_work LIKE 'O%')")
def _agg17(spark, d):
    cited = view(spark, d, "cites").filter("from_work LIKE 'O%'").select(F.col("to_work").alias("work_id"))
    return view(spark, d, "read_state").filter("status = 'ok'").join(cited, "work_id", "left_semi").agg(F.count("*").alias("n"))


_GONE = "(SELECT 'C' || c_custkey AS work_id FROM customer WHERE c_custkey < 1400 UNION ALL SELECT 'O' || o_orderkey FROM orders WHERE o_custkey < 1400)"
_ORPHANS = f"""SELECT w.work_id FROM {{works}} w SEMI JOIN (SELECT to_work AS work_id FROM {{edges}} SEMI JOIN (SELECT work_id AS from_work FROM {_GONE} g) h USING (from_work)) c USING (work_id)
    ANTI JOIN {_GONE} g USING (work_id) ANTI JOIN (SELECT to_work AS work_id FROM {{edges}} ANTI JOIN (SELECT work_id AS from_work FROM {_GONE} g) h USING (from_work)) o USING (work_id)
    ANTI JOIN (SELECT from_work AS work_id FROM {{edges}} WHERE from_work NOT LIKE 'P%') f USING (work_id) ANTI JOIN {{favourites}} v USING (work_id) WHERE NOT w.hydrated AND NOT w.is_seed"""


def _gone(spark, d):
    return view(spark, d, "customer").filter("c_custkey < 1400").select(F.concat(F.lit("C"), "c_custkey").alias("work_id")).unionByName(view(spark, d, "orders").filter("o_custkey < 1400").select(F.concat(F.lit("O"), "o_orderkey").alias("work_id")))


def _orphans(spark, d):
    from quillgraph.operators.graph import orphans

    cites = view(spark, d, "cites").filter("from_work NOT LIKE 'P%'")  # parts lead nowhere here, so that there are leaves
    return orphans(view(spark, d, "works"), cites, _gone(spark, d), view(spark, d, "favourites"))


query("gr12_orphans", _ORPHANS)(_orphans)


@query("agg18_deletion_plan", f"""SELECT 'papers' AS what, (SELECT count(*) FROM {_GONE} g) AS n
    UNION ALL SELECT 'pdfs', (SELECT count(*) FROM {{files}} f WHERE {_PDF} AND work_id IN (SELECT work_id FROM {_GONE} g))
    UNION ALL SELECT 'collections', (SELECT count(DISTINCT collection_id) FROM {{collection_work}} WHERE work_id IN (SELECT work_id FROM {_GONE} g))
    UNION ALL SELECT 'labels', (SELECT count(DISTINCT label) FROM {{labels_of}} WHERE work_id IN (SELECT work_id FROM {_GONE} g))
    UNION ALL SELECT 'orphans', (SELECT count(*) FROM ({_ORPHANS}) o)""")
def _agg18(spark, d):
    return stats.deletion_plan(_gone(spark, d), view(spark, d, "files"), view(spark, d, "collection_work"), view(spark, d, "labels_of"), _orphans(spark, d))


@query("agg19_stubs_cited", f"SELECT DISTINCT to_work AS work_id FROM {{cites}} JOIN {{works}} w ON w.work_id = to_work WHERE NOT w.hydrated AND NOT w.unresolved AND from_work IN (SELECT work_id FROM {_GONE} g)")
def _agg19(spark, d):
    return stats.stubs_cited_by(view(spark, d, "works"), view(spark, d, "cites"), _gone(spark, d))


@query("win2_chosen_pdf", f"SELECT work_id, path, version FROM {{files}} f WHERE {_PDF} QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY CASE version WHEN 'published' THEN 1 WHEN 'accepted' THEN 2 WHEN 'preprint' THEN 3 ELSE 4 END, added_at, path) = 1")
def _win2(spark, d):
    return stats.chosen_pdf(view(spark, d, "files")).select("work_id", "path", "version")


@query("txt11_to_read", f"SELECT work_id, path FROM (SELECT work_id, path FROM {{files}} f WHERE {_PDF} QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY CASE version WHEN 'published' THEN 1 WHEN 'accepted' THEN 2 WHEN 'preprint' THEN 3 ELSE 4 END, added_at, path) = 1) c LEFT JOIN (SELECT work_id, pages FROM {{read_state}}) r USING (work_id) WHERE r.pages IS NULL OR r.pages < 25")
def _txt11(spark, d):
    chosen = stats.chosen_pdf(view(spark, d, "files")).select("work_id", F.col("path"))
    state = view(spark, d, "read_state").join(chosen, "work_id", "left").select("work_id", F.coalesce("path", F.lit("")).alias("path"), F.col("pages").alias("extractor"))
    return stats.to_read(view(spark, d, "files"), state, 25).select("work_id", "path")


@query("srt6_fetch_next", f"SELECT w.work_id, w.is_seed, coalesce(c.n, 0) AS cited_here FROM {{works}} w LEFT JOIN {_CITED} c ON c.to_work = w.work_id WHERE NOT w.unresolved AND NOT EXISTS (SELECT 1 FROM {{files}} f WHERE f.work_id = w.work_id AND {_PDF}) ORDER BY w.is_seed DESC, coalesce(c.n, 0) DESC, w.arrival LIMIT 200")
def _srt6(spark, d):
    return stats.fetch_next(view(spark, d, "works"), view(spark, d, "cites"), view(spark, d, "files"), 200)


@query("jn2_both_ends", "SELECT c.from_work, a.title AS from_title, c.to_work, b.title AS to_title FROM {cites} c JOIN {works} a ON a.work_id = c.from_work JOIN {works} b ON b.work_id = c.to_work")
def _jn2(spark, d):
    works = view(spark, d, "works").select("work_id", "title")
    return view(spark, d, "cites").join(works.toDF("from_work", "from_title"), "from_work").join(works.toDF("to_work", "to_title"), "to_work").select("from_work", "from_title", "to_work", "to_title")


@query("jn3_not_looked_up", "SELECT w.type, count(*) AS n FROM {works} w LEFT JOIN {pdf_state} p USING (work_id) WHERE p.work_id IS NULL GROUP BY w.type")
def _jn3(spark, d):
    return view(spark, d, "works").join(view(spark, d, "pdf_state"), "work_id", "left").filter("availability is null").groupBy("type").agg(F.count("*").alias("n"))


@query("jn5_mirrored", "SELECT c.id, c.name, p.id IS NOT NULL AS mirrored FROM {collections} c LEFT JOIN {collections} p ON p.id = c.parent_id")
def _jn5(spark, d):
    c = view(spark, d, "collections")
    up = c.select(F.col("id").alias("up"))
    return c.join(up, F.col("parent_id") == F.col("up"), "left").select("id", "name", F.col("up").isNotNull().alias("mirrored"))


@query("jn9_dead_ends", "SELECT work_id FROM {works} w WHERE hydrated AND NOT EXISTS (SELECT 1 FROM {cites} c WHERE c.from_work = w.work_id)")
def _jn9(spark, d):
    return view(spark, d, "works").filter("hydrated").join(view(spark, d, "cites").select(F.col("from_work").alias("work_id")), "work_id", "left_anti").select("work_id")


@query("jn11_first_mention", "SELECT from_work, to_work, arg_min(sentence, page * 1000 + start) AS sentence, max(confidence) AS confidence FROM {mentions} GROUP BY 1, 2")
def _jn11(spark, d):
    return view(spark, d, "mentions").groupBy("from_work", "to_work").agg(F.min_by("sentence", F.struct("page", "start")).alias("sentence"), F.max("confidence").alias("confidence"))


@query("set3_unfiled", "SELECT work_id FROM {works} WHERE type = 'customer' AND work_id NOT IN (SELECT work_id FROM {favourites}) AND work_id NOT IN (SELECT work_id FROM {labels_of} WHERE label = 'rich')")
def _set3(spark, d):
    return view(spark, d, "works").filter("type = 'customer'").join(view(spark, d, "favourites"), "work_id", "left_anti").join(view(spark, d, "labels_of").filter("label = 'rich'"), "work_id", "left_anti").select("work_id")


@query("rec3_tree", "WITH RECURSIVE t AS (SELECT id, name, parent_id, 0 AS level, name || '/' || id AS path FROM {collections} WHERE parent_id IS NULL UNION ALL SELECT c.id, c.name, c.parent_id, t.level + 1, t.path || '/' || c.name || '/' || c.id FROM {collections} c JOIN t ON t.id = c.parent_id) SELECT id, name, parent_id, level, path FROM t")
def _rec3(spark, d):
    found = listing.tree(view(spark, d, "collections"))
    spelt = F.array_join(F.transform("path", lambda x: F.concat_ws("/", F.upper(x["name"]), x["id"].cast("string"))), "/")
    return found.select("id", "name", "parent_id", "level", spelt.alias("path"))

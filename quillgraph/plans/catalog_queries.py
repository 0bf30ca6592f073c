"""Queries over the index, and over the user's own layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import identity
from quillgraph.functions.textnorm import title_key
from quillgraph.operators import catalog, shelf, titles
from quillgraph.plans.library_queries import library
from quillgraph.queries import query
from quillgraph.views import view


def _index(spark, d):
    """Parts with the identifiers that an index may know them by, one kind each."""
    key, k = F.col("p_partkey"), F.col("p_partkey") % 4
    number = F.lpad((key % 100000).cast("string"), 5, "0")
    return view(spark, d, "part").select(
        F.concat(F.lit("P"), key).alias("work_id"), F.concat(F.lit("W"), key + 1).alias("index_id"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("cited_by_count"),
        F.when(k == 0, F.concat(F.lit("https://doi.org/10.1234/ABC."), key)).when(k == 1, F.concat(F.lit("https://doi.org/10.48550/arXiv.2101."), number)).alias("doi"),
        F.when(k == 2, F.concat(F.lit("http://arxiv.org/abs/2102."), number)).alias("landing_page"), F.when(k == 3, (key + 10000).cast("string")).alias("pmid"),
    )


@query("src3_resolve", "SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN 'title' ELSE CASE p_partkey % 4 WHEN 0 THEN 'doi' WHEN 3 THEN 'pmid' ELSE 'arxiv' END END AS kind, CASE WHEN p_partkey % 5 < 4 THEN (SELECT min('P' || q.p_partkey) FROM part q WHERE q.p_partkey % 4 = p.p_partkey % 4 AND (p.p_partkey % 4 IN (0, 3) AND q.p_partkey = p.p_partkey OR p.p_partkey % 4 IN (1, 2) AND q.p_partkey % 100000 = p.p_partkey % 100000)) END AS found FROM part p")
def _src3(spark, d):
    """Typed identifiers of four kinds, each spelt in another way than the index has it; every fifth is a title, which names no work."""
    key, k = F.col("p_partkey"), F.col("p_partkey") % 4
    number = F.lpad((key % 100000).cast("string"), 5, "0")
    typed = F.when(key % 5 == 4, F.concat(F.lit("some title "), key)).when(k == 0, F.concat(F.lit("doi:10.1234/abc."), key)).when(k == 1, F.concat(F.lit("arXiv:2101."), number, F.lit("v2"))).when(k == 2, F.concat(F.lit("https://arxiv.org/pdf/2102."), number)).otherwise(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), key + 10000))
    return catalog.resolved(view(spark, d, "part").select("p_partkey", typed.alias("typed")), _index(spark, d)).select("p_partkey", "kind", "found")


@query("src4_title_search", "SELECT work_id, title_match, CAST(row_number() OVER (ORDER BY title_match DESC, cited DESC, work_id) AS INT) AS place FROM (SELECT 'P' || p_partkey AS work_id, lower(p_name) = 'red widget' AS title_match, p_size AS cited FROM part WHERE lower(p_name) LIKE '%widget%' AND lower(p_name) LIKE '%red%') x ORDER BY place LIMIT 25")
def _src4(spark, d):
    """The first candidates for a typed title (the limit is the feature)."""
    from pyspark.sql.window import Window

    found = catalog.title_candidates(_index(spark, d), "Red, widget?", 25)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("title_match").desc(), F.col("cited_by_count").desc(), "work_id"))  # 25 rows
    return found.select("work_id", "title_match", place.alias("place"))


@query("src6_locations", "SELECT 'P' || p_partkey AS work_id, CASE WHEN p_size % 4 < 2 THEN 'open' WHEN p_size % 4 = 2 THEN 'no-link' ELSE 'closed' END AS availability, CASE p_size % 4 WHEN 0 THEN 'https://a/' || p_partkey || ',https://b/' || p_partkey WHEN 1 THEN 'https://b/' || p_partkey ELSE '' END AS links FROM part WHERE p_partkey % 3 = 0")
def _src6(spark, d):
    part, k = view(spark, d, "part"), F.col("p_size") % 4
    place = lambda host, free, version: F.struct(F.concat(F.lit(f"https://{host}/"), F.col("p_partkey").cast("string")).alias("url"), free.alias("is_oa"), F.lit(version).alias("version"))
    index = part.select(F.concat(F.lit("P"), "p_partkey").alias("work_id"), F.when(k < 3, "gold").otherwise("closed").alias("oa_status"), place("b", k < 2, "accepted").alias("best"), F.array(place("a", k == 0, "published"), place("b", k < 2, "preprint")).alias("locations"))
    ids = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("work_id")).unionByName(spark.createDataFrame([("P404404404",)], "work_id string"))
    return catalog.locations(ids, index).select("work_id", "availability", F.array_join("links", ",").alias("links"))


@query("src7_decode", """SELECT 'W' || (p_partkey + 1) AS index_id, '10.1/x' || p_partkey AS doi, CAST(p_partkey + 7 AS VARCHAR) AS pmid, p_name AS title, 1990 + CAST(p_size AS INT) AS year, p_brand AS venue, 'gold' AS oa_status,
    'W' || (p_partkey + 2) || ',W' || (p_partkey + 3) AS refs, 'state of ' || p_brand AS abstract, 2 AS people FROM part""")
def _src7(spark, d):
    """Nested records as JSON text, decoded and flattened; a bad reference is left out."""
    from quillgraph.sources.readers import WORK, works_of

    key = F.col("p_partkey")
    url = lambda by: F.concat(F.lit("https://openalex.org/W"), key + by)
    person = lambda n: F.struct(F.struct(F.lit(f"https://openalex.org/A{n}").alias("id"), F.lit(f"Person {n}").alias("display_name")).alias("author"))
    record = F.struct(
        url(1).alias("id"), F.concat(F.lit("https://doi.org/10.1/X"), key).alias("doi"), F.struct(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), key + 7).alias("pmid")).alias("ids"), F.col("p_name").alias("title"), (F.col("p_size") + 1990).alias("publication_year"), F.lit("article").alias("type"),
        F.struct(F.lit("gold").alias("oa_status")).alias("open_access"), F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("source")).alias("primary_location"), F.array(person(1), person(2)).alias("authorships"),
        F.create_map(F.lit("of"), F.array(F.lit(1)), F.lit("state"), F.array(F.lit(0)), F.col("p_brand"), F.array(F.lit(2))).alias("abstract_inverted_index"), F.array(url(2), F.lit("https://openalex.org/no-work"), url(3)).alias("referenced_works"),
    )
    read = view(spark, d, "part").select(F.from_json(F.to_json(record.dropFields("doi").withField("doi", record["doi"])), WORK).alias("w")).select("w.*")
    flat = works_of(read.withColumn("doi", F.concat(F.lit("https://doi.org/10.1000/"), F.regexp_extract("doi", "X(.*)$", 1))))
    return flat.select("index_id", F.concat(F.lit("10.1/x"), F.regexp_extract("doi", r"10\.1000/(.*)$", 1)).alias("doi"), "pmid", "title", "year", "venue", "oa_status", F.array_join("references", ",").alias("refs"), "abstract", F.size("authorships").alias("people"))


@query("gr7_details", "SELECT work_id, CASE WHEN type = 'part' AND work_id LIKE 'P1%' THEN 'D ' || title ELSE title END AS title, CASE WHEN type = 'part' AND work_id LIKE 'P1%' THEN greatest(cited_by_count, 20) ELSE cited_by_count END AS cited_by_count, hydrated FROM {works}")
def _gr7(spark, d):
    """Named stubs get their details; the graph doesn't grow."""
    works = view(spark, d, "works")
    index = works.filter("type in ('part', 'order')").withColumns({"title": F.concat(F.lit("D "), "title"), "cited_by_count": F.lit(20).cast("long")})
    ids = works.filter("work_id LIKE 'P1%' or work_id LIKE 'O1%'").select("work_id").unionByName(spark.createDataFrame([("P404404404",)], "work_id string"))
    return catalog.detail(works, index, ids).select("work_id", "title", "cited_by_count", "hydrated")


@query("gr7_hydrate", "WITH h AS (SELECT 'P' || p_partkey AS work_id FROM part WHERE p_partkey % 10 = 3) SELECT w.work_id, w.hydrated OR w.work_id IN (SELECT work_id FROM h) AS hydrated, w.unresolved OR w.type = 'nation' AS unresolved, (SELECT count(*) FROM {cites} c WHERE c.from_work = w.work_id AND (w.type IN ('customer', 'order') OR w.work_id IN (SELECT work_id FROM h))) AS cites FROM {works} w")
def _gr7_hydrate(spark, d):
    """Named works are fetched with their references; what the index doesn't know becomes unresolved."""
    works, cites = view(spark, d, "works"), view(spark, d, "cites")
    here = cites.filter("from_work LIKE 'C%' or from_work LIKE 'O%'")
    ids = view(spark, d, "part").filter("p_partkey % 10 = 3").select(F.concat(F.lit("P"), "p_partkey").alias("work_id")).unionByName(works.filter("type = 'nation'").select("work_id"))
    grown, edges = catalog.hydrate(works, here, works.filter("type <> 'nation'"), cites, works.limit(0).select("work_id"), ids)
    out = edges.groupBy(F.col("from_work").alias("work_id")).agg(F.count("*").alias("cites"))
    return grown.select("work_id", "hydrated", "unresolved").join(out, "work_id", "left").fillna({"cites": 0})


@query("gr8_bring_in", """WITH near AS (SELECT o.work_id, o.title FROM {works} o JOIN {cites} c ON c.from_work = o.work_id WHERE c.to_work = 'P1' ORDER BY o.cited_by_count DESC, o.work_id LIMIT 12)
    SELECT work_id, 'I ' || title AS title, 3 AS depth, FALSE AS hydrated, TRUE AS cites FROM near WHERE CAST(substr(work_id, 2) AS BIGINT) % 3 <> 0
    UNION ALL SELECT s.work_id, 'I ' || s.title, 3, FALSE, FALSE FROM {works} s JOIN {cites} c ON c.to_work = s.work_id WHERE c.from_work = 'P1'""")
def _gr8(spark, d):
    """One step around a part, in a library without orders: its suppliers get their details, twelve orders come in, deleted ones stay deleted."""
    every, cites = view(spark, d, "works"), view(spark, d, "cites")
    works = every.filter("type <> 'order'").withColumn("hydrated", F.col("hydrated") | (F.col("work_id") == "P1"))
    here = cites.filter("from_work NOT LIKE 'O%' and to_work NOT LIKE 'O%'")
    index = every.withColumn("title", F.concat(F.lit("I "), "title"))
    gone = every.filter("type = 'order' and cast(substr(work_id, 2) as bigint) % 3 = 0").select("work_id")
    grown, edges, _ = catalog.bring_around(works, here, index, cites, gone, "P1", citing=12)
    citing = edges.filter("to_work = 'P1'").select(F.col("from_work").alias("work_id"), F.lit(True).alias("cites"))
    return grown.filter("title LIKE 'I %'").select("work_id", "title", "depth", "hydrated").join(citing, "work_id", "left").fillna({"cites": False})


@query("api8_add_seeds", "SELECT w.work_id, w.depth, w.is_seed, w.hydrated FROM (SELECT 'P' || p_partkey AS work_id, 0 AS depth, TRUE AS is_seed, TRUE AS hydrated FROM part WHERE p_size = 3 UNION ALL SELECT DISTINCT c.to_work, 1, FALSE, FALSE FROM {cites} c JOIN part p ON c.from_work = 'P' || p.p_partkey WHERE p_size = 3) w")
def _api8(spark, d):
    """Seeds added to an empty library: the works, a stub for each reference, and the edges between."""
    every, cites = view(spark, d, "works"), view(spark, d, "cites")
    seeds = view(spark, d, "part").filter("p_size = 3").select(F.concat(F.lit("P"), "p_partkey").alias("work_id"))
    return catalog.add_seed(every.limit(0), cites.limit(0), every, cites, every.limit(0).select("work_id"), seeds)[0].select("work_id", "depth", "is_seed", "hydrated")


@query("dml7_mark", "SELECT work_id, CASE WHEN type IN ('supplier', 'part') THEN TRUE ELSE unresolved END AS unresolved, CASE WHEN type = 'order' THEN TRUE ELSE is_seed END AS is_seed FROM {works}")
def _dml7(spark, d):
    from quillgraph.operators import merge

    works = view(spark, d, "works")
    missing = merge.mark(works, works.filter("type in ('supplier', 'part', 'customer')"), "unresolved")
    return merge.mark(missing, works.filter("type = 'order'").select("work_id"), "is_seed").select("work_id", "unresolved", "is_seed")


@query("dml12_local", "SELECT work_id, title, year, hydrated, is_seed, depth FROM {works} UNION ALL SELECT 'L' || s_suppkey, s_name, 2000 + CAST(s_nationkey AS INT), TRUE, TRUE, 0 FROM supplier")
def _dml12(spark, d):
    new = view(spark, d, "supplier").select(F.concat(F.lit("L"), "s_suppkey").alias("work_id"), F.col("s_name").alias("title"), (F.col("s_nationkey") + 2000).alias("year"))
    works = view(spark, d, "works")
    return shelf.add_local(works, new.unionByName(works.filter("type = 'region'").select("work_id", "title", "year"))).select("work_id", "title", "year", "hydrated", "is_seed", "depth")


@query("dml13_link", "SELECT label, CASE WHEN CAST(substr(work_id, 2) AS BIGINT) % 2 = 0 THEN 'P' || substr(work_id, 2) ELSE work_id END AS work_id, CASE WHEN CAST(substr(work_id, 2) AS BIGINT) % 2 = 0 THEN 'P' ELSE 'N' END || substr(work_id, 2) AS index_id FROM (SELECT 'mine' AS label, 'L' || s_suppkey AS work_id FROM supplier) x")
def _dml13(spark, d):
    """Local documents linked to the index: half of them fold into parts that are there, with their labels."""
    works, k = view(spark, d, "works").filter("type = 'part'"), F.col("s_suppkey")
    local = view(spark, d, "supplier").select(F.concat(F.lit("L"), k).alias("work_id"), F.col("s_name").alias("title"), F.lit(None).cast("int").alias("year"))
    labels = local.select(F.lit("mine").alias("label"), "work_id")
    links = view(spark, d, "supplier").select(F.concat(F.lit("L"), k).alias("work_id"), F.concat(F.when(k % 2 == 0, "P").otherwise("N"), k).alias("index_id"))
    grown, _, layers, _ = shelf.link_local(shelf.add_local(works, local), view(spark, d, "cites").limit(0), links, {"labels": (labels, ["label", "work_id"])})
    return layers["labels"].join(grown.select("work_id", "index_id"), "work_id").select("label", "work_id", "index_id")


@query("dml14_put_text", "SELECT 'D' || doc_id AS work_id, ordinal, text FROM {passages} WHERE doc_id % 3 <> 0 UNION ALL SELECT 'D' || doc_id, 0, upper(lang) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def _dml14(spark, d):
    """A third of the documents is read anew; of these every second one gave a passage, the others none."""
    rows = view(spark, d, "passages").select(F.concat(F.lit("D"), "doc_id").alias("work_id"), F.col("ordinal").cast("int").alias("ordinal"), "text")
    state = view(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("work_id"), F.lit("ok").alias("status"), F.lit(1).alias("pages"))
    third = view(spark, d, "documents").filter("doc_id % 3 = 0")
    new = third.filter("doc_id % 2 = 0").select(F.concat(F.lit("D"), "doc_id").alias("work_id"), F.lit(0).alias("ordinal"), F.upper("lang").alias("text"))
    read = third.select(F.concat(F.lit("D"), "doc_id").alias("work_id"), F.lit("no-text").alias("status"), F.lit(2).alias("pages"))
    return shelf.put_text(rows, state, new, read)[0]


@query("dml18_view_totals", "SELECT v.name, count(w.work_id) AS total FROM (VALUES ('Nineties', 1990, 1999, ''), ('year 95', 1995, 1995, ''), ('never', 1800, 1801, ''), ('urgent', 1992, 1993, 'urgent')) v(name, a, b, t) LEFT JOIN {works} w ON w.year BETWEEN a AND b AND contains(lower(w.title), t) GROUP BY v.name")
def _dml18(spark, d):
    """Saved views: one is written over another of the same name in another case, one is dropped; then their totals."""
    views = spark.createDataFrame([], "name string, filters string")
    for name, filters in (("nineties", {"year_from": 1900}), ("gone", {"seeds": True}), ("year 95", {"year_from": 1995, "year_to": 1995}), ("Nineties", {"year_from": 1990, "year_to": 1999}), ("never", {"year_from": 1800, "year_to": 1801}), ("urgent", {"year_from": 1992, "year_to": 1993, "title": "Urgent"})):
        views = shelf.put_view(views, name, filters)
    return shelf.view_totals(shelf.drop_view(views, "GONE"), view(spark, d, "works"), library(spark, d))


@query("dml19_moved_files", "SELECT work_id, CASE WHEN path LIKE 'brand#1/%' THEN 'archive/one' || substr(path, 8) ELSE path END AS path FROM {files}")
def _dml19(spark, d):
    return shelf.moved_files(view(spark, d, "files"), "brand#1/", "archive/one").select("work_id", "path")


@query("dml19_notes", "SELECT 'C' || conv_id || '-' || turn AS id, CASE WHEN turn % 3 = 1 THEN 'X ' || max(text) ELSE max(text) END AS body FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND turn % 3 < 2 GROUP BY conv_id, turn HAVING trim(coalesce(max(text), '')) <> ''")
def _dml19_notes(spark, d):
    """Notes that are changed (every third turn), emptied (every third other one, which removes them) or left."""
    rows = view(spark, d, "conversations").filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max("text").alias("body"))
    notes = rows.select(F.concat(F.lit("C"), "conv_id", F.lit("-"), "turn").alias("id"), F.concat(F.lit("C"), "conv_id").alias("work_id"), F.col("turn").cast("int").alias("page"), F.lit(None).cast("string").alias("quote"), "body")
    new = notes.filter("page % 3 = 1").withColumn("body", F.concat(F.lit("X "), "body")).unionByName(notes.filter("page % 3 = 2").withColumn("body", F.lit("  ")))
    return shelf.put_notes(notes, new).select("id", "body")


@query("dml23_import", "SELECT 'K' || p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN 'known' WHEN p_partkey % 4 IN (0, 3) THEN 'matched' WHEN p_partkey % 4 = 1 THEN 'already' ELSE 'unmatched' END AS outcome FROM part WHERE p_size % 5 <> 1")
def _dml23(spark, d):
    """Items of a manager: known keys, identifiers that the index has, local documents that are there, and new ones; those in skipped collections alone stay out."""
    part, key, k = view(spark, d, "part"), F.col("p_partkey"), F.col("p_partkey") % 4
    inside = F.when(F.col("p_size") % 5 == 1, F.array(F.lit("sub"))).when(F.col("p_size") % 5 == 2, F.array(F.lit("sub"), F.lit("top"))).when(F.col("p_size") % 5 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("top")))
    items = part.select(F.concat(F.lit("K"), key).alias("key"), F.concat(F.lit("Item "), key).alias("title"), F.lit(2001).alias("year"), F.when(k == 0, F.concat(F.lit("10.1234/abc."), key)).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.when(k == 3, (key + 10000).cast("string")).alias("pmid"), inside.alias("collections"), F.array(F.lit("tag")).alias("tags"))
    tree = spark.createDataFrame([("top", "nowhere", "Top"), ("skipped", None, "Skipped"), ("sub", "skipped", " ")], "key string, parent string, name string")
    local = part.filter(k == 1).select(F.concat(F.lit("L"), key).alias("work_id"), F.concat(F.lit("Item "), key).alias("title"), F.lit(2001).alias("year"))
    works = shelf.add_local(view(spark, d, "works").filter("type = 'part'"), local)
    known = part.filter("p_partkey % 7 = 0").select(F.concat(F.lit("K"), key).alias("key"), F.concat(F.lit("P"), key).alias("work_id"))
    found = shelf.import_items(items, tree, spark.createDataFrame([("skipped",)], "key string"), known, works, _index(spark, d))[0]
    return found.select("key", "outcome")


@query("ctx11_reading_order", "SELECT from_work, to_work, CAST(row_number() OVER (PARTITION BY from_work ORDER BY page, start, to_work, sentence) AS INT) AS place FROM {mentions}")
def _ctx11(spark, d):
    return shelf.mentions_in_order(view(spark, d, "mentions")).select("from_work", "to_work", "place")


@query("ctx11_cited_on_pages", "SELECT from_work, page, string_agg(to_work, ',' ORDER BY start, to_work) AS cited FROM (SELECT from_work, page, to_work, min(start) AS start FROM {mentions} GROUP BY ALL) x GROUP BY ALL")
def _ctx11_pages(spark, d):
    return shelf.cited_on_pages(view(spark, d, "mentions")).select("from_work", "page", F.array_join("cited", ",").alias("cited"))


@query("api2_show", """WITH m AS (SELECT to_work, from_work, row_number() OVER (PARTITION BY to_work ORDER BY from_work) AS k FROM (SELECT DISTINCT to_work, from_work FROM {mentions}) x),
    p AS (SELECT work_id, path FROM {files} f WHERE NOT missing AND lower(path) LIKE '%.pdf' QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY CASE version WHEN 'published' THEN 1 WHEN 'accepted' THEN 2 WHEN 'preprint' THEN 3 ELSE 4 END, added_at, path) = 1),
    a AS (SELECT work_id, count(*) AS attempts, arg_max(outcome, attempt_id) AS last_outcome FROM {attempts} GROUP BY 1), n AS (SELECT work_id, string_agg(name, '; ' ORDER BY position, name) AS authors FROM {authorship} JOIN {authors} USING (author_id) GROUP BY 1),
    o AS (SELECT from_work AS work_id, count(*) AS cites FROM {cites} GROUP BY 1), i AS (SELECT to_work AS work_id, count(*) AS cited FROM {cites} GROUP BY 1), f AS (SELECT work_id, count(*) AS files FROM {files} GROUP BY 1), t AS (SELECT to_work AS work_id, count(*) AS mentions FROM {mentions} GROUP BY 1)
    SELECT w.work_id, w.title, coalesce(cites, 0) AS cites, coalesce(cited, 0) AS cited, coalesce(files, 0) AS files, coalesce(mentions, 0) AS mentions, coalesce(attempts, 0) AS attempts, last_outcome, p.path AS pdf, r.status AS text_status, authors, c.cited_in
    FROM {works} w LEFT JOIN o USING (work_id) LEFT JOIN i USING (work_id) LEFT JOIN f USING (work_id) LEFT JOIN t USING (work_id) LEFT JOIN a USING (work_id) LEFT JOIN p USING (work_id) LEFT JOIN {read_state} r USING (work_id) LEFT JOIN n USING (work_id)
    LEFT JOIN (SELECT to_work AS work_id, string_agg(from_work, ',' ORDER BY k) AS cited_in FROM m WHERE k <= 5 GROUP BY 1) c USING (work_id)""")
def _api2(spark, d):
    return shelf.show(view(spark, d, "works"), view(spark, d, "cites"), library(spark, d), view(spark, d, "attempts"), view(spark, d, "mentions"))


@query("scal7_url_ids", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'doi' WHEN 1 THEN 'index' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'pmid' WHEN 4 THEN 'doi' WHEN 5 THEN 'doi' ELSE 'url' END AS kind,
    CASE page_id % 7 WHEN 0 THEN '10.1234/ab.' || page_id WHEN 1 THEN 'W' || (page_id + 1) WHEN 2 THEN '2101.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') WHEN 3 THEN CAST(page_id + 1 AS VARCHAR) WHEN 4 THEN '10.5555/x' || page_id WHEN 5 THEN '10.1101/2020.' || page_id ELSE 'https://example.org/' || page_id END AS value FROM pages""")
def _scal7(spark, d):
    """Addresses of works at resolvers, archives and publishers, with the tails that they carry."""
    key, k = F.col("page_id").cast("string"), F.col("page_id") % 7
    forms = [("https://dx.doi.org/10.1234/AB.", key, ""), ("https://openalex.org/works/w", (F.col("page_id") + 1).cast("string"), "?x=1"), ("https://www.arxiv.org/pdf/2101.", F.lpad((F.col("page_id") % 100000).cast("string"), 5, "0"), "v3.pdf"), ("https://pubmed.ncbi.nlm.nih.gov/", (F.col("page_id") + 1).cast("string"), "/"), ("https://pub.example.com/doi/full/10.5555/x", key, ".full.pdf"), ("https://www.biorxiv.org/content/10.1101/2020.", key, "v2.full"), ("https://example.org/", key, "")]
    url = F.coalesce(*[F.when(k == n, F.concat(F.lit(a), b, F.lit(c))) for n, (a, b, c) in enumerate(forms)])
    return view(spark, d, "pages").select("page_id", identity.of_url(url).alias("x")).select("page_id", "x.kind", "x.value")


@query("scal20_expand", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 4 = 3 THEN 0 ELSE 3 * l_linenumber + 3 + 99 END AS BIGINT) AS total FROM lineitem")
def _scal20(spark, d):
    """The sum of the numbers of "n-n+2, 99"; a range that runs backwards voids the whole marker."""
    n = F.col("l_linenumber")
    marker = F.when(n % 4 == 3, F.concat(n + 2, F.lit("-"), n)).otherwise(F.concat(n.cast("string"), F.lit(" – "), (n + 2).cast("string"), F.lit("; 99")))
    return view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.aggregate(identity.ranges_of(marker), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("ctx10_references", "WITH a AS (SELECT work_id, arg_min(name, position) AS first, count(*) AS authors FROM {authorship} JOIN {authors} USING (author_id) GROUP BY 1) SELECT c.from_work AS work_id, c.ref_seq, c.to_work AS id, w.title, w.year, 'Doi ' || w.work_id AS doi, list_last(string_split(trim(a.first), ' ')) AS surname, coalesce(a.authors, 0) AS authors FROM {cites} c JOIN {works} w ON w.work_id = c.to_work LEFT JOIN a ON a.work_id = c.to_work")
def _ctx10(spark, d):
    from quillgraph.operators.text import references_of

    works = view(spark, d, "works").withColumn("doi", F.concat(F.lit("Doi "), "work_id"))
    return references_of(view(spark, d, "cites"), works, view(spark, d, "authorship"), view(spark, d, "authors"))


@query("gr10_presentation", """WITH g AS (SELECT 'C' || c_custkey AS work_id, 'C' || min(c_custkey) OVER (PARTITION BY c_nationkey) AS anchor, c_nationkey FROM customer), s AS (SELECT anchor, min(c_nationkey) AS nation, count(*) AS size FROM g GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY size DESC, anchor) AS INT) AS index, anchor, 'Around Customer#' || lpad(substr(anchor, 2), 9, '0') AS name, size, size AS fetched, 3 * size AS cited_within, nation % 5 = 0 AS dismissed, CASE WHEN nation % 5 = 0 THEN nation END AS collection_id FROM s""")
def _gr10(spark, d):
    """How groups are shown: customers of a nation as groups, some of them dismissed."""
    from pyspark.sql.window import Window

    from quillgraph.functions.presentation import group_summaries

    customer = view(spark, d, "customer")
    anchor = F.concat(F.lit("C"), F.min("c_custkey").over(Window.partitionBy("c_nationkey")))
    groups = customer.select("c_nationkey", F.concat(F.lit("C"), "c_custkey").alias("work_id"), anchor.alias("anchor"), F.lit(3).cast("long").alias("cited_within"), F.lit(False).alias("fringe"))
    sizes = groups.groupBy("anchor").agg(F.count("*").alias("size"), F.min("c_nationkey").alias("nation"))
    choices = sizes.filter("nation % 5 = 0").select("anchor", F.lit(True).alias("dismissed"), F.col("nation").alias("collection_id"))
    shown = group_summaries(groups.join(sizes.drop("nation"), "anchor"), view(spark, d, "works"), view(spark, d, "authorship").join(view(spark, d, "authors"), "author_id"), choices)
    return shown.drop("year_from", "year_to")


@query("src16_outcomes", "SELECT 'P' || p_partkey AS work_id, place, CASE WHEN place = 1 THEN CASE p_size % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'refused' WHEN 2 THEN 'not-a-pdf' WHEN 3 THEN 'timeout' ELSE 'not-found' END ELSE CASE p_partkey % 2 WHEN 0 THEN 'ok' ELSE 'http-error' END END AS outcome FROM part, (VALUES (1), (2)) t(place) WHERE place = 1 OR p_size % 5 <> 0")
def _src16(spark, d):
    """Ranked links tried host by host against a stand-in for the web; a second link only where the first one failed."""
    from quillgraph.operators.graph import cut
    from quillgraph.sources import fetch

    def answers(url: str) -> fetch.Answer:
        kind = url.rsplit("/", 1)[-1]
        if kind == "3":
            raise TimeoutError(url)
        return {"0": fetch.Answer(200, {}, b"%PDF-1.4"), "1": fetch.Answer(403, {}, b""), "2": fetch.Answer(200, {}, b"<html>"), "4": fetch.Answer(410, {}, b""), "bad": fetch.Answer(500, {}, b"")}[kind]

    part, work = view(spark, d, "part"), F.concat(F.lit("P"), "p_partkey").alias("work_id")
    host = F.concat(F.lit("https://host"), (F.col("p_partkey") % 20).cast("string"), F.lit("/"))
    first = part.select(work, F.lit(1).alias("place"), F.concat(host, (F.col("p_size") % 5).cast("string")).alias("url"))
    second = part.select(work, F.lit(2).alias("place"), F.concat(host, F.when(F.col("p_partkey") % 2 == 0, "0").otherwise("bad")).alias("url"))
    return fetch.downloaded(first.unionByName(second), cut, answers, pause=0.0).select("work_id", "place", "outcome")


@query("dml22_typed_titles", r"""WITH t AS (SELECT doc_id, regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{Nd}]', '', 'g') AS k FROM documents), h AS (SELECT k, count(*) AS works, min(doc_id) AS work_id FROM t WHERE length(k) > 0 GROUP BY 1),
    a AS (SELECT doc_id AS ask, CASE WHEN doc_id % 200 = 0 THEN k ELSE substr(k, 1, 1) || k END AS k FROM t WHERE doc_id % 100 = 0 AND length(k) > 0)
    SELECT ask, a.k = h.k AS exact, 1 - levenshtein(a.k, h.k) / greatest(length(a.k), length(h.k)) AS similarity, works, work_id FROM a JOIN h ON abs(length(a.k) - length(h.k)) * 20 <= 3 * greatest(length(a.k), length(h.k)) AND 1 - levenshtein(a.k, h.k) / greatest(length(a.k), length(h.k)) >= 0.85""")
def _dml22_typed(spark, d):
    """The first lines of every hundredth document, half of them mistyped, looked up among those of all documents."""
    docs = view(spark, d, "documents").select(F.col("doc_id"), F.split("text", "\n")[0].alias("title"))
    key = title_key(F.col("title"))
    typed = F.when(F.col("doc_id") % 200 == 0, F.col("title")).otherwise(F.concat(F.substring(key, 1, 1), F.col("title")))
    asked = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("ask"), typed.alias("typed"))
    return titles.similar(asked, docs.select(F.col("doc_id").alias("work_id"), "title"))

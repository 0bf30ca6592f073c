"""Queries that show changes to the library as the state after them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import graph, merge
from quillgraph.queries import query
from quillgraph.views import view

_EVEN = "SELECT 'P' || p_partkey AS alias, 'P' || (p_partkey - 1) AS work_id FROM part WHERE p_partkey % 2 = 1"


def _aliases(spark, d):
    return view(spark, d, "part").filter("p_partkey % 2 = 1").select(F.concat(F.lit("P"), "p_partkey").alias("alias"), F.concat(F.lit("P"), F.col("p_partkey") - 1).alias("work_id"))


@query("dml1_upsert_works", "SELECT w.work_id, CASE WHEN w.type = 'part' THEN 'new ' || w.title ELSE w.title END AS title, CASE WHEN w.type = 'part' THEN least(w.depth, 1) ELSE w.depth END AS depth, w.hydrated OR w.type = 'part' AS hydrated, w.unresolved AND w.type <> 'part' AS unresolved FROM {works} w")
def _dml1(spark, d):
    works = view(spark, d, "works")
    new = works.filter("type = 'part'").withColumns({"title": F.concat(F.lit("new "), "title"), "depth": F.lit(1)})
    return merge.upsert_works(works, new).select("work_id", "title", "depth", "hydrated", "unresolved")


@query("dml2_upsert_stubs", "SELECT work_id, depth FROM {works} WHERE type NOT IN ('nation', 'region') UNION ALL SELECT 'N' || n_nationkey, 2 FROM nation")
def _dml2(spark, d):
    works = view(spark, d, "works").filter("type not in ('nation', 'region')")
    stubs = view(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("work_id"), F.lit(2).alias("depth"))
    return merge.upsert_stubs(works, stubs.unionByName(stubs.withColumn("depth", F.lit(4)))).select("work_id", "depth")


@query("dml3_record_references", "SELECT from_work, to_work FROM {cites} WHERE from_work LIKE 'O%' AND to_work NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size = 1)")
def _dml3(spark, d):
    works, cites = view(spark, d, "works"), view(spark, d, "cites")
    lists = cites.filter("from_work LIKE 'O%'").groupBy(F.col("from_work").alias("work_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_seq", "to_work"))), lambda x: x["to_work"]).alias("references"))
    lists = lists.withColumn("references", F.concat("references", F.array("work_id"), F.slice("references", 1, 1)))
    gone = view(spark, d, "part").filter("p_size = 1").select(F.concat(F.lit("P"), "p_partkey").alias("work_id"))
    return merge.record_references(works, cites.limit(0), lists, gone)[1].select("from_work", "to_work")


@query("dml4_upsert_edges", "SELECT c.from_work, c.to_work, coalesce(m.confidence, 0.5) AS confidence FROM {cites} c LEFT JOIN (SELECT from_work, to_work, max(confidence) AS confidence FROM {mentions} GROUP BY ALL) m USING (from_work, to_work)")
def _dml4(spark, d):
    cites = view(spark, d, "cites").withColumn("confidence", F.lit(0.5))
    new = view(spark, d, "mentions").groupBy("from_work", "to_work").agg(F.max("confidence").alias("confidence"))
    return merge.upsert_edges(cites, new).select("from_work", "to_work", "confidence")


@query("dml5_fold", f"WITH a AS ({_EVEN}), m AS (SELECT coalesce(x.work_id, from_work) AS from_work, coalesce(y.work_id, to_work) AS to_work, ref_seq FROM {{cites}} c LEFT JOIN a x ON x.alias = from_work LEFT JOIN a y ON y.alias = to_work) SELECT from_work, to_work, min(ref_seq) AS ref_seq FROM m WHERE from_work <> to_work GROUP BY ALL")
def _dml5(spark, d):
    cites = merge.fold(view(spark, d, "works"), view(spark, d, "cites"), _aliases(spark, d))[1]
    return cites.select("from_work", "to_work", F.col("ref_seq").cast("long").alias("ref_seq"))


@query("dml5_fold_labels", "WITH a AS (SELECT 'C' || c_custkey AS alias, 'C' || (c_custkey - 1) AS work_id FROM customer WHERE c_custkey % 2 = 1) SELECT DISTINCT label, coalesce(a.work_id, l.work_id) AS work_id FROM {labels_of} l LEFT JOIN a ON a.alias = l.work_id")
def _dml5_labels(spark, d):
    aliases = view(spark, d, "customer").filter("c_custkey % 2 = 1").select(F.concat(F.lit("C"), "c_custkey").alias("alias"), F.concat(F.lit("C"), F.col("c_custkey") - 1).alias("work_id"))
    return merge.fold(view(spark, d, "works"), view(spark, d, "cites"), aliases, {"labels": (view(spark, d, "labels_of"), ["label", "work_id"])})[2]["labels"].select("label", "work_id")


@query("dml6_doi_survivors", "WITH w AS (SELECT work_id, arrival, lower(title) AS doi FROM {works} WHERE type = 'part') SELECT work_id AS alias, holder AS work_id FROM (SELECT *, first_value(work_id) OVER (PARTITION BY doi ORDER BY arrival, work_id) AS holder FROM w) x WHERE holder <> work_id")
def _dml6(spark, d):
    return merge.doi_survivors(view(spark, d, "works").filter("type = 'part'").withColumn("doi", F.lower("title")))


@query("dml8_put_details", "SELECT work_id, CASE WHEN type IN ('part', 'nation') THEN 'D ' || title ELSE title END AS title, CASE WHEN type IN ('part', 'nation') THEN greatest(cited_by_count, 20) ELSE cited_by_count END AS cited_by_count FROM {works}")
def _dml8(spark, d):
    works = view(spark, d, "works")
    details = works.filter("type in ('part', 'nation', 'order')").select("work_id", F.concat(F.lit("D "), "title").alias("title"), F.lit(20).cast("long").alias("cited_by_count"), "venue", "type")
    return merge.put_details(works, details).select("work_id", "title", "cited_by_count")


@query("dml9_bylines", "SELECT work_id, author_id, position FROM {authorship} WHERE work_id NOT LIKE 'P1%' UNION ALL SELECT work_id, author_id, position + 5 FROM {authorship} WHERE work_id LIKE 'P1%'")
def _dml9(spark, d):
    """Works get their bylines anew, some twice over and some without a name; the rows are written once, as all parts read them."""
    rows = graph.cut(view(graph.in_pieces(spark), d, "authorship").withColumn("position", F.col("position").cast("long")))
    new = rows.filter("work_id LIKE 'P1%'").withColumn("position", F.col("position") + 5)
    later = F.struct("author_id", (F.col("position") + 1).alias("position"))
    lines = F.explode(F.array(F.struct("author_id", "position"), later, F.struct(F.lit("").alias("author_id"), "position")))
    return graph.cut(merge.replace_bylines(rows, new.select("work_id", lines.alias("l")).select("work_id", "l.*")), spark)


@query("dml10_delete", "SELECT from_work, to_work FROM {cites} WHERE from_work NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 25) AND to_work NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 25)")
def _dml10(spark, d):
    gone = view(spark, d, "part").filter("p_size > 25").select(F.concat(F.lit("P"), "p_partkey").alias("work_id"))
    works = view(spark, d, "works")
    return merge.delete_works({"works": works, "cites": view(spark, d, "cites")}, gone, works.limit(0).select("work_id", "title"))[0]["cites"].select("from_work", "to_work")


@query("dml11_tombstones", "SELECT work_id, title FROM {works} WHERE type = 'part' AND cited_by_count > 25 AND index_id IS NOT NULL")
def _dml11(spark, d):
    works = view(spark, d, "works")
    gone = view(spark, d, "part").filter("p_size > 25").select(F.concat(F.lit("P"), "p_partkey").alias("work_id"))
    return merge.delete_works({"works": works}, gone, works.limit(0).select("work_id", "title"))[1]


@query("dml15_contexts", "SELECT from_work, to_work, arg_min(sentence, page * 1000 + start) AS context, max(confidence) AS confidence FROM {mentions} GROUP BY ALL")
def _dml15(spark, d):
    rows = view(spark, d, "mentions")
    return merge.put_mentions(rows.limit(0), view(spark, d, "cites"), rows)[1]


@query("dml17_sync", "WITH c AS (SELECT work_id, path FROM {files} WHERE version <> 'other'), w AS (SELECT work_id, path FROM {files} WHERE version <> 'published') SELECT *, 'add' AS change FROM (FROM w EXCEPT FROM c) UNION ALL SELECT *, 'remove' FROM (FROM c EXCEPT FROM w)")
def _dml17(spark, d):
    files = view(spark, d, "files").select("work_id", "path", "version")
    return merge.sync(files.filter("version <> 'other'"), files.filter("version <> 'published'"), ["work_id", "path"])


@query("dml20_scan", """SELECT CASE WHEN k = 1 THEN 'b/' ELSE 'a/' END || p_partkey AS path, 'P' || p_partkey AS work_id, CASE k WHEN 0 THEN 'same' WHEN 1 THEN 'moved' WHEN 2 THEN 'missing' ELSE 'changed' END AS state, CASE WHEN k = 1 THEN 'a/' || p_partkey END AS was FROM (SELECT *, p_partkey % 4 AS k FROM part) x
    UNION ALL SELECT 'c/' || s_suppkey, NULL, 'loose', NULL FROM supplier""")
def _dml20(spark, d):
    part = view(spark, d, "part")
    old = part.select(F.concat(F.lit("a/"), "p_partkey").alias("path"), F.concat(F.lit("P"), "p_partkey").alias("work_id"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"), F.col("p_size").alias("size"))
    k = F.col("p_partkey") % 4
    disk = part.filter(k != 2).select(F.concat(F.when(k == 1, "b/").otherwise("a/"), "p_partkey").alias("path"), F.sha2(F.concat(F.col("p_partkey").cast("string"), F.when(k == 3, "x").otherwise("")), 256).alias("sha256"), F.col("p_size").alias("size"))
    loose = view(spark, d, "supplier").select(F.concat(F.lit("c/"), "s_suppkey").alias("path"), F.sha2(F.concat(F.lit("s"), "s_suppkey"), 256).alias("sha256"), F.lit(1).alias("size"))
    return merge.scan_diff(old, disk.unionByName(loose)).select("path", "work_id", "state", "was")


# Suppliers are works with a folder each; the files in it are the parts that they supply.  By supplier, modulo 7: left alone, moved into a
# chapter, its id taken off the name, gone, its files spread over folders by part, moved with a file renamed inside and one added, and two parents swapped.
_SUPPLIED = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM {lineitem}"
_FILED = f"""SELECT s, p, s % 7 AS k, 'S' || s AS work_id, 'papers/' || (s % 2) || '/Supplier ' || s || '--S' || s AS old,
    CASE s % 7 WHEN 0 THEN 'papers/' || (s % 2) || '/Supplier ' || s || '--S' || s WHEN 1 THEN 'papers/Chapter/mine--s' || s WHEN 2 THEN 'papers/Supplier ' || s WHEN 4 THEN 'papers/' || (p % 5) || ' of ' || s
        WHEN 5 THEN 'papers/moved/5--S' || s WHEN 6 THEN 'papers/' || ((s + 1) % 2) || '/Supplier ' || s || '--S' || s END AS now,
    CASE WHEN s % 7 = 5 AND p = min(p) OVER (PARTITION BY s) THEN 'renamed' ELSE 'part ' END || p || '.pdf' AS name, 'part ' || p || '.pdf' AS old_name,
    s % 7 = 4 AND min(p % 5) OVER (PARTITION BY s) < max(p % 5) OVER (PARTITION BY s) AS spread FROM ({_SUPPLIED}) AS x"""


def _scanned(spark, d):
    from quillgraph.operators.scan import scan

    filed = graph.cut(spark.sql(_FILED, lineitem=view(spark, d, "lineitem")))
    content = (F.sha2(F.concat_ws(" ", "s", "p"), 256).alias("sha256"), (F.col("s") + F.col("p")).alias("size"))
    loose = view(spark, d, "nation").selectExpr("concat('papers/Chapter/', n_name, if(n_nationkey % 2 = 0, '.PDF', '.txt')) as path", "sha2(n_name, 256) as sha256", "cast(0 as bigint) as size")
    odd = view(spark, d, "region").selectExpr("concat('papers/', r_name, '--X', r_regionkey) as path")
    disk = filed.filter("now is not null").select(F.concat_ws("/", "now", "name").alias("path"), *content).unionByName(loose).unionByName(odd.select(F.concat("path", F.lit("/a.pdf")).alias("path"), F.lit("x").alias("sha256"), F.lit(0).cast("long").alias("size")))
    disk = disk.unionByName(filed.filter("k = 5").select("now").distinct().select(F.concat("now", F.lit("/notes.txt")).alias("path"), F.lit("n").alias("sha256"), F.lit(1).cast("long").alias("size")))
    folders = filed.select(F.col("old").alias("path"), "work_id").distinct()
    files = filed.select(F.concat_ws("/", "old", "old_name").alias("path"), "work_id", *content)
    there = filed.filter("now is not null").select(F.col("now").alias("path")).unionByName(odd)
    return scan(folders, files, view(spark, d, "works").filter("type = 'supplier'").select(F.col("work_id").alias("ref"), "work_id"), there, disk)


@query("dml20_folders", f"""WITH f AS ({_FILED}) SELECT DISTINCT CASE WHEN k = 3 OR spread THEN old ELSE now END AS path, work_id, CASE WHEN k = 0 THEN 'same' WHEN k = 3 OR spread THEN 'missing' WHEN k IN (2, 4) THEN 'renamed' ELSE 'moved' END AS state, CASE WHEN NOT (k IN (0, 3) OR spread) THEN old END AS was FROM f
    UNION ALL SELECT 'papers/' || r_name || '--X' || r_regionkey, NULL, 'unknown', NULL FROM {{region}}""")
def _dml20_folders(spark, d):
    """Whole folders found again by the id in their names or by what they hold."""
    return _scanned(spark, d)[0]


@query("dml20_files", f"""WITH f AS ({_FILED}) SELECT coalesce(now, old) || '/' || CASE WHEN k = 5 THEN old_name ELSE name END AS path, work_id, CASE WHEN k = 3 OR (k = 5 AND name <> old_name) THEN 'missing' WHEN k IN (2, 4) THEN 'moved' ELSE 'same' END AS state, CASE WHEN k NOT IN (0, 3) THEN old || '/' || old_name END AS was FROM f
    UNION ALL SELECT now || '/' || name, work_id, 'new', NULL FROM f WHERE name <> old_name UNION ALL SELECT DISTINCT now || '/notes.txt', work_id, 'new', NULL FROM f WHERE k = 5
    UNION ALL SELECT 'papers/Chapter/' || n_name || '.PDF', NULL, 'loose', NULL FROM {{nation}} WHERE n_nationkey % 2 = 0""")
def _dml20_files(spark, d):
    """Files that follow their folders, are found by content, are new, missing or loose."""
    return _scanned(spark, d)[1]


@query("jn12_resolve", f"WITH a AS ({_EVEN}) SELECT 'P' || p_partkey AS ref, 'P' || p_partkey AS work_id FROM part UNION ALL SELECT 'R0', 'R0' UNION ALL SELECT 'nothing', NULL UNION ALL SELECT 'old' || alias, work_id FROM a")
def _jn12(spark, d):
    works, aliases = view(spark, d, "works"), _aliases(spark, d).withColumn("alias", F.concat(F.lit("old"), "alias"))
    refs = works.filter("type = 'part' or work_id = 'R0'").select(F.col("work_id").alias("ref")).unionByName(aliases.select(F.col("alias").alias("ref"))).unionByName(spark.createDataFrame([("nothing",)], "ref string"))
    return merge.resolve(refs, works, aliases)


@query("src2_batch_fetch", f"WITH a AS ({_EVEN}), t AS (SELECT work_id FROM a) SELECT 'work' AS kind, w.work_id FROM {{works}} w WHERE w.work_id IN (SELECT work_id FROM t) UNION ALL SELECT 'alias', alias FROM a UNION ALL SELECT 'missing', 'W404'")
def _src2(spark, d):
    aliases = _aliases(spark, d)
    ids = aliases.select(F.col("alias").alias("work_id")).unionByName(spark.createDataFrame([("W404",), ("W404",)], "work_id string"))
    works, found, missing = merge.batch_fetch(ids, view(spark, d, "works"), aliases)
    parts = (works.select(F.lit("work").alias("kind"), "work_id"), found.select(F.lit("alias").alias("kind"), F.col("alias").alias("work_id")), missing.select(F.lit("missing").alias("kind"), "work_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dml22_find", "SELECT work_id FROM {works} WHERE type = 'part' AND 1 - levenshtein(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 'redwidgets') / greatest(length(regexp_replace(lower(title), '[^a-z0-9]', '', 'g')), 10) >= 0.85")
def _dml22(spark, d):
    return merge.find_title(view(spark, d, "works").filter("type = 'part'"), "Red widgets").select("work_id")


@query("txt13_import", "SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size % 6 = 0 THEN 'duplicate of filed' WHEN p_size % 6 = 1 THEN 'filed' WHEN p_size % 6 = 2 THEN 'filed by title' WHEN p_size % 6 = 3 THEN 'candidates' WHEN p_size % 6 = 4 THEN 'unconfirmed' ELSE 'unidentified' END AS outcome FROM part")
def _txt13(spark, d):
    k = F.col("p_size") % 6
    files = view(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_partkey").cast("string").alias("sha256"), (k <= 1).cast("int").alias("verified"), k.isin(1, 4).cast("int").alias("named"), F.when(k == 2, 1).when(k == 3, 2).otherwise(0).alias("candidates"))
    earlier = view(spark, d, "part").filter("p_size % 6 = 0").select(F.col("p_partkey").cast("string").alias("sha256"), F.lit("filed").alias("outcome"))
    return merge.import_verdicts(files, earlier)


def _data(name: str, value: str, there: str = "") -> str:
    return f"CASE WHEN {name} IS NOT NULL {there} THEN '<data key=\"{name}\">' || {value} || '</data>' ELSE '' END"


_XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')".format
_KEYS = (("index_id", "string"), ("title", "string"), ("year", "int"), ("venue", "string"), ("type", "string"), ("cited_by_count", "long"), ("hydrated", "boolean"), ("is_seed", "boolean"), ("depth", "int"), ("unresolved", "boolean"))
_HEAD = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(f'<key id="{n}" for="node" attr.name="{n}" attr.type="{t}"/>' for n, t in _KEYS) + '<graph edgedefault="directed">'


@query("snk1_graphml", f"""SELECT 0 AS part, '' AS id, '{_HEAD}' AS line UNION ALL SELECT 3, '', '</graph></graphml>'
    UNION ALL SELECT 1, work_id, '<node id="' || work_id || '">' || {" || ".join(_data(n, _XML(f"CAST({n} AS VARCHAR)")) for n, _ in _KEYS)} || '</node>' FROM {{works}} WHERE hydrated
    UNION ALL SELECT 2, from_work || ' ' || to_work, '<edge source="' || from_work || '" target="' || to_work || '"/>' FROM {{edges}} SEMI JOIN (SELECT work_id AS from_work FROM {{works}} WHERE hydrated) a USING (from_work) SEMI JOIN (SELECT work_id AS to_work FROM {{works}} WHERE hydrated) b USING (to_work)""")
def _snk1(spark, d):
    """The file itself: by (part, id), head, nodes, edges and end."""
    from quillgraph.sources.exports import graphml

    return graphml(view(spark, d, "works"), view(spark, d, "cites"))


_TEXTS, _OTHERS = ("work_id", "index_id", "title", "venue", "type"), ("year", "cited_by_count", "hydrated", "is_seed", "depth", "unresolved", "arrival")
_JSON = {c: f"'\"{c}\":' || to_json({c})" for c in _TEXTS} | {c: f"'\"{c}\":' || CAST({c} AS VARCHAR)" for c in _OTHERS}


@query("snk5_json_lines", "SELECT '{{' || concat_ws(',', ".replace("{{", "{") + ", ".join(_JSON[c] for c in ("work_id", "index_id", "title", "year", "venue", "type", "cited_by_count", "hydrated", "is_seed", "depth", "unresolved", "arrival")) + ") || '}' AS value FROM {works}")
def _snk5(spark, d):
    from quillgraph.sources.exports import json_lines

    return json_lines(view(spark, d, "works"))


@query("snk6_notes", "SELECT 'W' || conv_id AS work_id, string_agg('**p. ' || (turn + 1) || '**' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, rn) AS markdown FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn, text) AS rn FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL AND turn IS NOT NULL) GROUP BY conv_id")
def _snk6(spark, d):
    from quillgraph.sources.exports import notes_markdown

    rows = view(spark, d, "conversations").filter("conv_id is not null and text is not null and turn is not null")
    return notes_markdown(rows.select(F.concat(F.lit("W"), "conv_id").alias("work_id"), F.col("text").alias("id"), (F.col("turn") + 1).alias("page"), F.lit(None).cast("string").alias("quote"), F.col("text").alias("body")))

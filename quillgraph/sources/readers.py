"""Sources: nested work records as JSON, reference-manager exports as XML or JSON, folders of files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.identity import WORK_ID, abstract_of, arxiv_of, doi_of, index_id_of

#: Names of files and folders that systems leave about, in lower case.
JUNK = ("desktop.ini", "thumbs.db", "icon\r")

WORK = """id string, doi string, ids struct<pmid:string>, title string, publication_year int, type string, cited_by_count bigint,
    open_access struct<oa_status:string,oa_url:string>, primary_location struct<landing_page_url:string,source:struct<display_name:string>>,
    authorships array<struct<author:struct<id:string,display_name:string,orcid:string>>>, abstract_inverted_index map<string,array<int>>,
    referenced_works array<string>, best_oa_location struct<pdf_url:string,is_oa:boolean,version:string>, locations array<struct<pdf_url:string,is_oa:boolean,version:string>>"""


def read_works(spark: SparkSession, path: str, answers: bool = True) -> DataFrame:
    """JSON records of works: lines, or whole answers {"results": [...]}."""
    if answers:
        return spark.read.option("multiLine", True).schema(f"results array<struct<{_struct(WORK)}>>").json(path).select(F.explode("results").alias("w")).select("w.*")
    return spark.read.schema(WORK).json(path)


def _struct(ddl: str) -> str:
    """`name type, ...` as the inside of struct<name:type,...>."""
    out, depth = [], 0
    for part in ddl.split():
        bare = depth == 0 and part.isidentifier() and not out[-1:] == [":"]
        out += [part, ":"] if bare else [part]
        depth += part.count("<") - part.count(">")
    return "".join(out)


def works_of(records: DataFrame) -> DataFrame:
    """Flat works; a record with a bad id of its own is an error, bad references are left out."""
    own = index_id_of(F.col("id"))
    return records.select(
        F.coalesce(own, F.raise_error(F.concat(F.lit("bad work id: "), F.coalesce("id", F.lit("null")))).cast("string")).alias("index_id"),
        doi_of(F.col("doi")).alias("doi"), F.regexp_extract("ids.pmid", "([0-9]+)$", 1).alias("pmid"), "title", F.col("publication_year").alias("year"), F.col("primary_location.source.display_name").alias("venue"), "type", "cited_by_count",
        F.col("open_access.oa_status").alias("oa_status"), F.col("open_access.oa_url").alias("oa_url"), abstract_of(F.col("abstract_inverted_index")).alias("abstract"),
        F.coalesce(arxiv_of(F.regexp_extract(F.lower("doi"), r"10\.48550/arxiv\.(.+)$", 1)), arxiv_of(F.regexp_extract("primary_location.landing_page_url", r"arxiv\.org/abs/(.+)$", 1))).alias("arxiv_id"),
        F.array_compact(F.transform("referenced_works", index_id_of)).alias("references"), F.col("authorships"),
    )


def authorship_of(records: DataFrame) -> DataFrame:
    flat = records.select(index_id_of(F.col("id")).alias("work_id"), F.posexplode("authorships").alias("position", "a"))
    return flat.select("work_id", F.regexp_extract("a.author.id", "([^/]+)$", 1).alias("author_id"), F.col("a.author.display_name").alias("name"), F.col("a.author.orcid").alias("orcid"), "position").filter("author_id <> '' and name is not null")


def read_rdf(spark: SparkSession, path: str, row: str) -> DataFrame:
    """The elements `row` of an RDF/XML export; rdf:about and rdf:resource are columns with an underscore."""
    return spark.read.format("xml").option("rowTag", row).option("attributePrefix", "_").load(path)


def items_of(items: DataFrame) -> DataFrame:
    """Items of a reference manager's JSON: trashed ones go, automatic tags go, attachments join their parents.

    (key, parent, type, title, deleted, tags array<struct<tag,type>>, path) becomes (key, type, title, tags, files).
    """
    live = items.filter(~F.coalesce("deleted", F.lit(False)))
    files = live.filter("type = 'attachment' and path is not null").groupBy(F.col("parent").alias("key")).agg(F.array_sort(F.collect_list("path")).alias("files"))
    tags = F.transform(F.filter("tags", lambda t: F.coalesce(t["type"], F.lit(0)) != 1), lambda t: t["tag"])
    return live.filter("type not in ('attachment', 'note')").select("key", "type", "title", tags.alias("tags")).join(files, "key", "left")


def collections_of(raw: DataFrame) -> DataFrame:
    """(key, parent, name) of a manager's collections (key, name, parentCollection as JSON: false, or a key)."""
    parent = F.regexp_extract(F.trim("parentCollection"), '^"?([^"]+)"?$', 1)
    return raw.select("key", F.when(~parent.isin("", "false", "null"), parent).alias("parent"), "name")


def rdf_library(items: DataFrame, collections: DataFrame, attachments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triples of an export joined: (about, title, doi, collections, files) and (key, parent, name).

    items are (about, title, identifiers array, links array), collections (about, title, parts array), attachments (about, path, type):
    a part that is a collection lies inside, one that is an item is filed; a link that is a PDF's attachment is a file of its item.
    """
    parts = collections.select(F.col("about").alias("key"), F.explode("parts").alias("part"))
    inner = parts.join(collections.select(F.col("about").alias("part")), "part").groupBy("part").agg(F.min("key").alias("parent"))
    tree = collections.select(F.col("about").alias("key"), F.col("title").alias("name")).join(inner.withColumnRenamed("part", "key"), "key", "left").select("key", "parent", "name")
    filed = parts.join(items.select(F.col("about").alias("part")), "part").groupBy(F.col("part").alias("about")).agg(F.array_sort(F.collect_set("key")).alias("collections"))
    pdf = attachments.filter(F.lower(F.coalesce("type", F.lit(""))) == "application/pdf").select(F.col("about").alias("link"), "path")
    files = items.select("about", F.explode("links").alias("link")).join(pdf, "link").groupBy("about").agg(F.array_sort(F.collect_list("path")).alias("files"))
    doi = F.get(F.filter(F.transform("identifiers", doi_of), lambda x: x.isNotNull()), F.lit(0))
    found = items.select("about", "title", doi.alias("doi")).join(filed, "about", "left").join(files, "about", "left")
    return found, tree


def read_folder(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size, sha256, modified) of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def inbox(spark: SparkSession, root: str, folder: str = "Inbox") -> DataFrame:
    """(path, size, modified) of the PDFs waiting in a library's inbox, paths below the root; hidden files and folders and what systems leave about are no entries."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/{folder}").select("path", "length", "modificationTime")  # the contents aren't read
    rel = F.regexp_extract(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"/({re.escape(folder)}/.*)$", 1)
    parts = F.split(rel, "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | F.lower(p).isin(*JUNK))
    return found.withColumn("rel", rel).filter(~hidden & F.endswith(F.lower("rel"), F.lit(".pdf"))).select(F.col("rel").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def work_folders(files: DataFrame) -> DataFrame:
    """Files (path) with the id of the work whose folder they are in: the last word of a folder's name, if it has the shape of an id; null for loose files."""
    words = F.transform(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda p: F.element_at(F.split(F.trim(p), r"\s+"), -1))
    ids = F.filter(words, lambda w: F.rlike(w, F.lit(WORK_ID)) & F.rlike(w, F.lit("[0-9]")))
    return files.withColumn("work_id", F.when(F.size(ids) > 0, F.element_at(ids, -1)))

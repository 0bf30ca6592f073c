"""The user's own layer: local documents, a reference manager's items, saved views, notes, logs, moved files, what one sees of a work.

Functions from table states to table states, as in `merge`.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import listing, merge
from quillgraph.operators.catalog import resolved
from quillgraph.operators.stats import chosen_pdf

# --- Local documents ---------------------------------------------------------------------------------------------------


def add_local(works: DataFrame, new: DataFrame) -> DataFrame:
    """(work_id, title, year): documents that the index doesn't know, as seeds at depth 0 that need no fetching."""
    blank = {c: F.lit(None).cast(works.schema[c].dataType) for c in works.columns}
    blank |= {c: F.col(c).cast(works.schema[c].dataType) for c in new.columns if c in works.columns}
    blank |= {"hydrated": F.lit(True), "is_seed": F.lit(True), "unresolved": F.lit(False), "depth": F.lit(0).cast(works.schema["depth"].dataType)}
    fresh = new.join(works.select("work_id"), "work_id", "left_anti")
    return works.unionByName(fresh.select(*[blank[c].alias(c) for c in works.columns]))


def link_local(works: DataFrame, cites: DataFrame, links: DataFrame, layers: dict[str, tuple[DataFrame, list[str]]] | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], DataFrame]:
    """(work_id, index_id): local documents become the works that the index knows.

    Where the library has the work already the document folds into it, and stays as an alias; else it takes the index id.
    A document that has an index id refuses the whole write.  Returns works, cites, layers and the aliases.
    """
    asked = links.select("work_id", F.col("index_id").alias("quill_index"))
    if not works.join(asked, "work_id").filter("index_id is not null").isEmpty():
        raise ValueError("a document is already linked")
    have = works.filter("index_id is not null").select(F.col("index_id").alias("quill_index"), F.col("work_id").alias("holder"))
    known = asked.join(have, "quill_index", "left")
    aliases = known.filter("holder is not null").select(F.col("work_id").alias("alias"), F.col("holder").alias("work_id"))
    taken = known.filter("holder is null").select("work_id", "quill_index")
    works = works.join(taken, "work_id", "left").withColumn("index_id", F.coalesce("index_id", "quill_index")).select(*works.columns)
    return *merge.fold(works, cites, aliases, layers), aliases


def put_text(passages: DataFrame, read_state: DataFrame, new_passages: DataFrame, new_state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A work's text is one reading of one file: what was read anew replaces its passages and its row, also where it gave no passage."""
    kept = merge.removed(passages, new_state, ["work_id"])
    mine = new_passages.join(new_state.select("work_id"), "work_id", "left_semi")
    return kept.unionByName(mine.select(*passages.columns)), merge.upsert(read_state, new_state, ["work_id"])


# --- A reference manager's items ---------------------------------------------------------------------------------------


def mirrored(collections: DataFrame, skip: DataFrame) -> DataFrame:
    """(key, parent, name, level): a manager's collections (key, parent, name), parents first, without skipped ones and those inside them; a parent that isn't there means the top.  Those in a circle have no row."""
    name = F.when(F.trim("name") != "", F.trim("name")).otherwise("Untitled collection")
    rows = collections.select("key", "parent", F.coalesce(name, F.lit("Untitled collection")).alias("name"))
    keys = rows.select(F.col("key").alias("up"))
    rows = rows.join(keys, F.col("parent") == F.col("up"), "left").select("key", F.col("up").alias("parent"), "name").join(skip.select("key"), "key", "left_anti")
    placed = listing.tops(rows.select(F.col("key").alias("id"), F.col("parent").alias("parent_id"))).select(F.col("id").alias("key"), (F.size("path") - 1).alias("level"))
    return rows.join(placed, "key").select("key", "parent", "name", "level")


def import_items(items: DataFrame, collections: DataFrame, skip: DataFrame, known: DataFrame, works: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of a manager's items: (key, outcome, work_id, title, year), (collection, work_id) and (label, work_id).

    An item stays if it is in no collection or in one that isn't skipped.  A known key (key, work_id) whose work is there is
    reused; else the DOI, the arXiv id or the PubMed id, in this order, is resolved in the index; else the local document of
    the same title and year, or a new one, named by its key.
    """
    kept = mirrored(collections, skip).select(F.col("key").alias("collection"))
    filed = items.select("key", F.explode_outer("collections").alias("collection"))
    inside = filed.join(kept, "collection")
    chosen = items.join(filed.filter("collection is null").select("key").unionByName(inside.select("key")).distinct(), "key", "left_semi")
    typed = F.coalesce(F.nullif("doi", F.lit("")), F.concat(F.lit("arXiv:"), F.nullif("arxiv_id", F.lit(""))), F.concat(F.lit("pmid:"), F.nullif("pmid", F.lit(""))))
    named = F.when(F.trim("title") != "", F.col("title")).otherwise(F.concat(F.lit("Untitled item "), "key"))
    rows = chosen.select("key", "tags", F.coalesce(named, F.concat(F.lit("Untitled item "), "key")).alias("title"), "year", typed.alias("typed"))
    found = resolved(rows, index).filter("kind in ('doi', 'arxiv', 'pmid') and found is not null").select("key", "found")
    there = known.join(works.select("work_id"), "work_id", "left_semi").select("key", F.col("work_id").alias("known"))
    local = works.filter("index_id is null").groupBy("title", "year").agg(F.min("work_id").alias("local"))
    same = (rows["title"] == local["title"]) & rows["year"].eqNullSafe(local["year"])
    placed = rows.join(local, same, "left").select(rows["key"], "tags", rows["title"], rows["year"], "local").join(there, "key", "left").join(found, "key", "left")
    # Several items of one title and year that nothing else names are one new document.
    fresh = F.concat(F.lit("L"), F.substring(F.sha2(F.concat_ws("\u0000", "title", F.col("year").cast("string")), 256), 1, 12))
    outcome = F.when(F.col("known").isNotNull(), "known").when(F.col("found").isNotNull(), "matched").when(F.col("local").isNotNull(), "already").otherwise("unmatched")
    out = placed.select("key", "tags", outcome.alias("outcome"), F.coalesce("known", "found", "local", fresh).alias("work_id"), "title", "year")
    label = out.select(F.explode("tags").alias("label"), "work_id").filter("length(label) between 1 and 100").distinct()
    return out.drop("tags"), inside.join(out.select("key", "work_id"), "key").select("collection", "work_id").distinct(), label


# --- Views, notes, logs, files -------------------------------------------------------------------------------------------


def put_view(views: DataFrame, name: str, filters: dict) -> DataFrame:
    """Save a view (name, filters as JSON); one without filters is refused, and names differ in more than case."""
    held = {k: v for k, v in filters.items() if v not in (None, "", [], (), False)}
    if not name.strip() or not held:
        raise ValueError("a view needs a name and a filter")
    new = views.sparkSession.createDataFrame([(name.strip(), json.dumps(held, sort_keys=True))], "name string, filters string")
    return drop_view(views, name).unionByName(new)


def drop_view(views: DataFrame, name: str) -> DataFrame:
    return views.filter(listing.ascii_lower(F.col("name")) != listing.ascii_lower(F.lit(name.strip())))


def asked_by(filters: str) -> listing.Query:
    """The listing that a saved view's filters ask for."""
    held = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(filters).items()}
    return listing.Query(**held)


def view_totals(views: DataFrame, works: DataFrame, lib: dict[str, DataFrame]) -> DataFrame:
    """(name, total): how many works each saved view holds; views are typed by hand, so their number is small."""
    totals = [listing.conditions(works, asked_by(v["filters"]), lib).agg(F.count_distinct("work_id").alias("total")).select(F.lit(v["name"]).alias("name"), "total") for v in views.orderBy("name").collect()]
    return reduce(DataFrame.unionByName, totals) if totals else views.select("name", F.lit(0).cast("long").alias("total")).limit(0)


def put_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes (id, work_id, page, quote, body) by id; one with neither quote nor body goes."""
    rows = merge.upsert(notes, new, ["id"])
    return rows.filter("coalesce(trim(quote), '') <> '' or coalesce(trim(body), '') <> ''")


def put_choices(choices: DataFrame, new: DataFrame) -> DataFrame:
    """Choices about groups (anchor, dismissed, collection_id): a new value that isn't null wins."""
    return merge.upsert(choices, new, ["anchor"], {c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) for c in new.columns if c != "anchor"})


def logged(log: DataFrame, new: DataFrame) -> DataFrame:
    """An append-only log."""
    return log.unionByName(new.select(*log.columns))


def moved_files(files: DataFrame, old: str, new: str) -> DataFrame:
    """Files of a folder (or one file) that was moved: the path's prefix changes, at a folder's edge only."""
    old, new = old.rstrip("/"), new.rstrip("/")
    path = F.regexp_replace("path", f"^{re.escape(old)}(?=/|$)", re.sub(r"([\\$])", r"\\\1", new))
    return files.withColumn("path", path)


# --- Reading ---------------------------------------------------------------------------------------------------------------


def mentions_in_order(mentions: DataFrame) -> DataFrame:
    """Mentions with their place (from 1) in the citing work's reading order, and among those of their edge."""
    order = ("page", "start", "to_work", "sentence")
    return mentions.withColumns({"place": F.row_number().over(Window.partitionBy("from_work").orderBy(*order)), "of_edge": F.row_number().over(Window.partitionBy("from_work", "to_work").orderBy("page", "start", "sentence"))})


def cited_on_pages(mentions: DataFrame) -> DataFrame:
    """(from_work, page, cited): the works that a page cites, in the order of their first mention there."""
    first = mentions.groupBy("from_work", "page", "to_work").agg(F.min("start").alias("start"))
    return first.groupBy("from_work", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "to_work"))), lambda x: x["to_work"]).alias("cited"))


def show(works: DataFrame, cites: DataFrame, lib: dict[str, DataFrame], attempts: DataFrame, mentions: DataFrame, sample: int = 5) -> DataFrame:
    """Everything about each work: its neighbours' numbers, the chosen PDF, links and tries, its text, and the first sentences that cite it."""
    count = lambda rows, key, name: rows.groupBy(F.col(key).alias("work_id")).agg(F.count("*").alias(name))
    parts = [count(cites, "from_work", "cites"), count(cites, "to_work", "cited"), count(lib["files"], "work_id", "files"), count(mentions, "to_work", "mentions")]
    parts.append(attempts.groupBy("work_id").agg(F.count("*").alias("attempts"), F.max_by("outcome", "attempt_id").alias("last_outcome")))
    parts.append(chosen_pdf(lib["files"]).select("work_id", F.col("path").alias("pdf")))
    parts.append(lib["read_state"].select("work_id", F.col("status").alias("text_status")))
    names = lib["authorship"].join(lib["authors"], "author_id").groupBy("work_id")
    parts.append(names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), "; ").alias("authors")))
    early = mentions_in_order(mentions).filter("of_edge = 1")
    place = F.row_number().over(Window.partitionBy("to_work").orderBy("from_work"))
    early = early.withColumn("k", place).filter(F.col("k") <= sample).groupBy(F.col("to_work").alias("work_id"))
    parts.append(early.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "from_work"))), lambda x: x["from_work"]), ",").alias("cited_in")))
    shown = works.select("work_id", "title")
    for part in parts:
        shown = shown.join(part, "work_id", "left")
    return shown.fillna(0, ["cites", "cited", "files", "mentions", "attempts"])

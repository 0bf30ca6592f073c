"""Listings of the library: filters, orders, facets, pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Query:
    """What a listing asks for; conditions are joined by AND, an empty `among` finds nothing."""

    seeds: bool = False
    with_pdf: bool = False
    without_text: bool = False
    collection: str | None = None
    subtree: int | None = None
    starred: bool = False
    labels: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    authors: tuple[str, ...] = ()
    venues: tuple[str, ...] = ()
    among: DataFrame | None = None
    title: str = ""
    order: str = "default"
    offset: int = 0
    limit: int | None = None
    skip: frozenset[str] = field(default_factory=frozenset)


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(c, _UPPER, _LOWER)


def tops(collections: DataFrame) -> DataFrame:
    """(id, top, path): the collection without a parent above each one, and the ids from it down, by doubling the stride of all pointers in each round.

    The rounds grow with the logarithm of the depth, whatever it is.  Collections in or below a circle, or below a parent that isn't there, have no row.
    """
    whole = collections.select("id", F.col("parent_id").alias("up"), F.array("id").alias("path")).filter("id is not null")
    done, open_ = whole.filter("up is null"), cut(whole.filter("up is not null"))
    done, most, stride = cut(done), collections.count(), 1
    while stride <= most and not open_.isEmpty():
        every = done.unionByName(open_).select(F.col("id").alias("above"), F.col("up").alias("next"), F.col("path").alias("before"))
        moved = cut(open_.join(every, F.col("up") == F.col("above")).select("id", F.col("next").alias("up"), F.concat("before", "path").alias("path")))
        done, open_, stride = done.unionByName(moved.filter("up is null")), moved.filter("up is not null"), 2 * stride
    return done.select("id", F.col("path")[0].alias("top"), "path")


def circles(collections: DataFrame) -> DataFrame:
    """(id): the collections that no top is above, as they are in a circle, below one, or below a parent that isn't there."""
    return collections.select("id").join(tops(collections), "id", "left_anti")


def subtree(collections: DataFrame, root: int) -> DataFrame:
    """(id): a collection and all below it, however deep; a circle through it is opened there."""
    opened = collections.withColumn("parent_id", F.when(F.col("id") != root, F.col("parent_id")))
    return tops(opened).filter(F.col("top") == root).select("id")


def tree(collections: DataFrame) -> DataFrame:
    """(id, name, parent_id, level, path): depth-first, siblings by (name, id); `path` sorts so.  What `circles` reports has no row."""
    ids = tops(collections).select("id", F.posexplode("path").alias("at", "step"))
    named = collections.select(F.col("id").alias("step"), F.struct(ascii_lower(F.col("name")).alias("name"), F.col("id")).alias("named"))
    paths = ids.join(named, "step").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "named"))).alias("steps"))
    paths = paths.select("id", (F.size("steps") - 1).alias("level"), F.transform("steps", lambda x: x["named"]).alias("path"))
    return collections.join(paths, "id").select("id", "name", "parent_id", "level", "path")


def closure(collections: DataFrame) -> DataFrame:
    """(ancestor, id): each collection with itself and all below it, each pair once, also in circles; strides double in each round."""
    known = collections.select("id", F.col("parent_id").alias("up")).filter("id is not null")
    jump = cut(known.join(known.select(F.col("id").alias("up")), "up").select("id", "up"))
    found, most, stride = cut(known.select(F.col("id").alias("ancestor"), "id")), collections.count(), 1
    while stride <= most and not jump.isEmpty():
        further = found.join(jump.select(F.col("id").alias("ancestor"), "up"), "ancestor").select(F.col("up").alias("ancestor"), "id")
        found = cut(found.unionByName(further).distinct())
        jump = cut(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
        stride *= 2
    return found


def folded(c: Column) -> Column:
    """Lower case without accents, for matching: common Latin letters with marks lose them."""
    return F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def pdfs(files: DataFrame) -> DataFrame:
    """Present files that are PDFs."""
    return files.filter(~F.col("missing") & ascii_lower(F.col("path")).endswith(".pdf"))


def conditions(works: DataFrame, q: Query, lib: dict[str, DataFrame]) -> DataFrame:
    """The works that pass; `lib` holds the tables of the library by name.  Every EXISTS is a semi-join on work_id."""
    found = works
    semi = lambda t: found.join(t.select("work_id"), "work_id", "left_semi")
    if q.seeds:
        found = found.filter("is_seed")
    if q.with_pdf:
        found = semi(pdfs(lib["files"]))
    if q.without_text:
        found = semi(lib["read_state"].filter("status <> 'ok'"))
    if q.collection is not None:
        found = semi(lib["collection_work"].join(lib["collections"].filter(F.col("name") == q.collection).select(F.col("id").alias("collection_id")), "collection_id", "left_semi"))
    if q.subtree is not None:
        found = semi(lib["collection_work"].join(subtree(lib["collections"], q.subtree).withColumnRenamed("id", "collection_id"), "collection_id", "left_semi"))
    if q.starred:
        found = semi(lib["favourites"])
    if q.labels:
        wanted = lib["labels_of"].filter(F.col("label").isin(*q.labels))
        found = semi(wanted.groupBy("work_id").agg(F.count_distinct("label").alias("n")).filter(F.col("n") == len(set(q.labels))))
    if "year" not in q.skip:
        if q.year_from is not None:
            found = found.filter(F.col("year") >= q.year_from)
        if q.year_to is not None:
            found = found.filter((F.col("year") <= q.year_to) & (F.col("year") > 0))
    if q.authors and "author" not in q.skip:
        found = semi(lib["authorship"].join(lib["authors"].filter(F.col("name").isin(*q.authors)), "author_id", "left_semi"))
    if q.venues and "venue" not in q.skip:
        found = found.filter(F.col("venue").isin(*q.venues))
    if q.among is not None:
        found = semi(q.among)
    for word in q.title.split():
        found = found.filter(F.contains(folded(F.col("title")), folded(F.lit(word))))
    return found


def cited_here(cites: DataFrame) -> DataFrame:
    return cites.groupBy(F.col("to_work").alias("work_id")).agg(F.count("*").alias("cited_here"))


def order_of(name: str) -> list[Column]:
    """The sort keys of a listing order; missing years and titles come last in all of them."""
    no_year, no_title = F.coalesce("year", F.lit(0)) == 0, F.coalesce("title", F.lit("")) == ""
    arrival = F.col("arrival")
    orders = {
        "default": [F.col("is_seed").desc(), F.col("cited_here").desc(), arrival],
        "newest": [no_year, F.col("year").desc(), arrival],
        "oldest": [no_year, F.col("year"), arrival],
        "title": [no_title, ascii_lower(F.col("title")), arrival],
        "cited": [F.col("cited_here").desc(), arrival],
        "citedworld": [F.col("cited_by_count").desc(), arrival],
        "added": [arrival.desc()],
        "arrived": [arrival],
    }
    if name not in orders:
        raise ValueError(f"no order is called {name!r}: {', '.join(orders)}")
    return orders[name]


def list_works(works: DataFrame, cites: DataFrame, q: Query, lib: dict[str, DataFrame]) -> DataFrame:
    """One row for each work that passes, in order, paged: its columns and what the library knows of it."""
    found = conditions(works, q, lib).join(cited_here(cites), "work_id", "left").fillna({"cited_here": 0})
    refs = cites.groupBy(F.col("from_work").alias("work_id")).agg(F.count("*").alias("references"))
    first = lib["authorship"].join(lib["authors"], "author_id").groupBy("work_id").agg(F.min_by("name", "position").alias("first_author"), F.count("*").alias("n_authors"))
    path = pdfs(lib["files"]).groupBy("work_id").agg(F.min("path").alias("pdf"))
    labels = lib["labels_of"].groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    star = lib["favourites"].select("work_id", F.lit(True).alias("starred")).distinct()
    found = found.orderBy(*order_of(q.order))
    if q.offset or q.limit is not None:
        found = found.offset(q.offset).limit(q.limit if q.limit is not None else 2**31 - 1 - q.offset)
    page = found
    for extra in (refs, first, path, labels, lib["read_state"].select("work_id", F.col("status").alias("text_status")), star):
        page = page.join(extra, "work_id", "left")
    return page.fillna({"references": 0, "n_authors": 0, "starred": False}).orderBy(*order_of(q.order))


def facets(works: DataFrame, q: Query, lib: dict[str, DataFrame], find: str = "", top: int = 8) -> DataFrame:
    """(facet, place, value, n, total): years ascending; the `top` authors and venues by (count, name), then chosen ones.

    Each facet ignores its own filter; `total` counts the works that pass all.
    """
    from dataclasses import replace

    from pyspark.sql.window import Window

    def under(name: str) -> DataFrame:
        return conditions(works, replace(q, skip=q.skip | {name}), lib)

    years = under("year").filter("coalesce(year, 0) <> 0").groupBy(F.col("year").cast("string").alias("value")).agg(F.count_distinct("work_id").alias("n"))
    out = years.select(F.lit("year").alias("facet"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("value").cast("int"))).alias("place"), "value", "n")
    people = lib["authorship"].join(lib["authors"], "author_id").select("work_id", F.col("name").alias("value"))
    sides = {"author": (under("author").join(people, "work_id"), q.authors), "venue": (under("venue").withColumn("value", F.col("venue")).filter("value is not null"), q.venues)}
    for name, (rows, chosen) in sides.items():
        counted = rows.groupBy("value").agg(F.count_distinct("work_id").alias("n"))
        if chosen:
            wanted = works.sparkSession.createDataFrame([(c,) for c in sorted(set(chosen))], "value string")
            counted = counted.unionByName(wanted.join(counted, "value", "left_anti").withColumn("n", F.lit(0).cast("long")))
        shown = counted.filter(F.contains(folded(F.col("value")), folded(F.lit(find)))) if find else counted
        ranked = shown.orderBy(F.col("n").desc(), "value").limit(top).withColumn("top", F.lit(True))
        kept = ranked.drop("top")
        if chosen:
            kept = kept.unionByName(counted.filter(F.col("value").isin(*chosen)).join(ranked.select("value"), "value", "left_anti"))
        out = out.unionByName(kept.select(F.lit(name).alias("facet"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), "value")).alias("place"), "value", "n"))
    total = conditions(works, q, lib).agg(F.count_distinct("work_id").alias("total"))
    return out.withColumn("total", F.lit(total.first()["total"]).cast("long"))

"""Counts over the library, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.listing import ascii_lower, closure, pdfs


def summary(works: DataFrame, cites: DataFrame) -> DataFrame:
    """Works, fetched ones, stubs, unresolved stubs, seeds, edges, dead ends and the reference coverage, in one pass over each table.

    A dead end has been fetched and cites nothing.
    """
    citing = cites.groupBy(F.col("from_work").alias("work_id")).agg(F.count("*").alias("n"))
    one = works.join(citing, "work_id", "left").agg(
        F.count("*").alias("works"), F.count_if("hydrated").alias("fetched"), F.count_if(~F.col("hydrated")).alias("stubs"), F.count_if(~F.col("hydrated") & F.col("unresolved")).alias("unresolved"),
        F.count_if("is_seed").alias("seeds"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.count_if(F.col("hydrated") & F.col("n").isNull()).alias("dead_ends"),
    )
    return one.withColumn("coverage", coverage(F.col("fetched"), F.col("dead_ends")))


def coverage(fetched: Column, dead_ends: Column) -> Column:
    """The share of fetched works with references, rounded half up to two places; 0 when nothing is fetched."""
    return F.when(fetched > 0, F.floor((fetched - dead_ends) / fetched * 100 + 0.5) / 100).otherwise(0.0)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def context_counts(cites: DataFrame, mentions: DataFrame, read_state: DataFrame) -> DataFrame:
    """Edges of works whose text was read, those with a sentence, and all mentions."""
    ok = read_state.filter("status = 'ok'").select(F.col("work_id").alias("from_work"))
    said = mentions.groupBy("from_work", "to_work").agg(F.count("*").alias("n"))
    return cites.join(ok, "from_work", "left_semi").join(said, ["from_work", "to_work"], "left").agg(F.count("*").alias("edges"), F.count("n").alias("with_sentence"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))


def pdf_counts(works: DataFrame, state: DataFrame) -> DataFrame:
    """Availability of PDFs; unresolved works are not in the index, others without a row have not been looked up."""
    what = F.when(F.col("unresolved"), "not in index").otherwise(F.coalesce("availability", F.lit("not looked up")))
    return works.join(state, "work_id", "left").groupBy(what.alias("availability")).agg(F.count("*").alias("n"))


def label_counts(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Uses of each label, unused ones too."""
    used = labels.groupBy("label").agg(F.count_distinct("work_id").alias("uses"))
    return names.join(used, names.name == used.label, "left").select("name", F.coalesce("uses", F.lit(0)).alias("uses")).orderBy(ascii_lower(F.col("name")))


def collection_counts(collections: DataFrame, filed: DataFrame) -> DataFrame:
    """(id, works): distinct works in a collection or below it."""
    below = closure(collections).join(filed, F.col("id") == F.col("collection_id"))
    n = below.groupBy("ancestor").agg(F.count_distinct("work_id").alias("works"))
    return collections.join(n, F.col("id") == F.col("ancestor"), "left").select("id", "name", F.coalesce("works", F.lit(0)).alias("works"))


def chosen_pdf(files: DataFrame) -> DataFrame:
    """One present PDF for each work: published, accepted, preprint, other; then the first added, then by path."""
    rank = F.array_position(F.array(*map(F.lit, ("published", "accepted", "preprint"))), F.col("version"))
    order = [F.when(rank > 0, rank).otherwise(4), "added_at", "path"]
    ranked = pdfs(files).withColumn("place", F.row_number().over(Window.partitionBy("work_id").orderBy(*order)))
    return ranked.filter("place = 1").drop("place")


def to_read(files: DataFrame, state: DataFrame, extractor: int) -> DataFrame:
    """Chosen PDFs that were never read, whose content changed, or that an older extractor read; `state` has (work_id, path, extractor)."""
    read = state.select("work_id", F.col("path").alias("old_path"), F.col("extractor").alias("old"))
    return chosen_pdf(files).join(read, "work_id", "left").filter(F.col("old").isNull() | (F.col("old_path") != F.col("path")) | (F.col("old") < extractor)).drop("old_path", "old")


def fetch_next(works: DataFrame, cites: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """Works without a PDF: seeds first, then by citations here, then by arrival."""
    cited = cites.groupBy(F.col("to_work").alias("work_id")).agg(F.count("*").alias("cited_here"))
    open_ = works.filter("not unresolved").join(pdfs(files), "work_id", "left_anti").join(cited, "work_id", "left").fillna({"cited_here": 0})
    return open_.select("work_id", "is_seed", "cited_here", "arrival").orderBy(F.col("is_seed").desc(), F.col("cited_here").desc(), "arrival").limit(limit).drop("arrival")


def deletion_plan(deleted: DataFrame, files: DataFrame, filed: DataFrame, labels: DataFrame, orphaned: DataFrame) -> DataFrame:
    """What a deletion would take: papers, present PDFs, distinct collections and labels, and the orphans it leaves."""
    ids = deleted.select("work_id").distinct()
    def count(rows: DataFrame, name: str, what: Column | None = None) -> DataFrame:
        return rows.join(ids, "work_id", "left_semi").agg((F.count("*") if what is None else F.count_distinct(what)).alias("n")).select(F.lit(name).alias("what"), "n")

    parts = [ids.agg(F.count("*").alias("n")).select(F.lit("papers").alias("what"), "n"), count(pdfs(files), "pdfs"), count(filed, "collections", F.col("collection_id")), count(labels, "labels", F.col("label")), orphaned.agg(F.count("*").alias("n")).select(F.lit("orphans").alias("what"), "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stubs_cited_by(works: DataFrame, cites: DataFrame, which: DataFrame) -> DataFrame:
    """Distinct stubs that a set of works cites, in id order."""
    cited = cites.join(which.select(F.col("work_id").alias("from_work")), "from_work", "left_semi").select(F.col("to_work").alias("work_id")).distinct()
    return works.filter("not hydrated and not unresolved").join(cited, "work_id", "left_semi").select("work_id")


def duplicates(works: DataFrame, key: Column, least: int = 20) -> DataFrame:
    """Probable duplicates: fetched, titled works with one title key of `least` characters or more, in groups of two or more.

    Reported as (key, size, members by (year, id)); nothing is merged.
    """
    keyed = works.filter("hydrated and title is not null").withColumn("key", key).filter(F.length("key") >= least)
    return keyed.groupBy("key").agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "work_id"))), lambda x: x["work_id"]), ",").alias("members"), F.min("title").alias("title")).filter("size >= 2")


def library_stats(works: DataFrame, cites: DataFrame, read_state: DataFrame, files: DataFrame, repeated: DataFrame, most: int = 20) -> DataFrame:
    """(what, item, n): the library's counts, its texts by status, and the first `most` works without text, files of another version, and repeated titles (item, n)."""
    row = lambda rows, what, item, n: rows.select(F.lit(what).alias("what"), item.alias("item"), n.cast("long").alias("n"))
    one = summary(works, cites)
    silent = read_state.filter("status = 'no-text'").select("work_id").orderBy("work_id").limit(most)
    other = files.filter("version = 'other' and not missing").select("work_id").distinct().orderBy("work_id").limit(most)
    parts = [
        row(one, "works", F.lit(""), F.col("works")), row(one, "edges", F.lit(""), F.col("edges")), row(histogram(read_state, "status"), "text", F.col("status"), F.col("n")),
        row(silent, "no text", F.col("work_id"), F.lit(1)), row(other, "other version", F.col("work_id"), F.lit(1)), row(repeated.orderBy(F.col("n").desc(), "item").limit(most), "duplicates", F.col("item"), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

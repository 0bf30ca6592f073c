"""Text operators on DataFrames of works and pages: reading, passages, mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillgraph.functions import contexts as ctx
from quillgraph.functions import pagetext

READ = "work_id string, pages int, chars long, status string, passages array<struct<page:int,ordinal:int,section:string,start:long,end:long,text:string>>"
MENTIONS = "from_work string, to_work string, page int, start long, end long, sentence string, section string, marker string, method string, confidence double"


def gathered(pages: DataFrame) -> DataFrame:
    """(work_id, pages): the texts of a work's pages (work_id, page, text) in order."""
    return pages.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("pages"))


#: Texts that Python holds at a time, in bytes of a batch.
PIECE = 4_000_000


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of Arrow batches in runs of about `PIECE` bytes, at least one row: what is made of texts is larger than they are, so it is made of few at a time."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pylist()


def cleaned(works: DataFrame) -> DataFrame:
    """(work_id, pages) with every page cleaned."""

    schema = pa.schema([("work_id", pa.string()), ("pages", pa.list_(pa.string()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            for r in rows:
                r["pages"] = [pagetext.clean(p or "") for p in r["pages"]]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return works.select("work_id", "pages").mapInArrow(make, "work_id string, pages array<string>")


def read(works: DataFrame) -> DataFrame:
    """Clean, judge and cut works (work_id, pages) in one pass: one row each, with passages only where the text is ok."""
    passage = pa.struct([("page", pa.int32()), ("ordinal", pa.int32()), ("section", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
    schema = pa.schema([("work_id", pa.string()), ("pages", pa.int32()), ("chars", pa.int64()), ("status", pa.string()), ("passages", pa.list_(passage))])

    def one(work: str, listed: list) -> dict:
        pages = [pagetext.clean(p or "") for p in listed]
        status = pagetext.judged("\n".join(pages), len(pages))
        return {"work_id": work, "pages": len(pages), "chars": sum(map(len, pages)), "status": status, "passages": [p._asdict() for p in pagetext.passages(pages)] if status == "ok" else []}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            yield pa.RecordBatch.from_pylist([one(r["work_id"], r["pages"]) for r in rows], schema)

    return works.select("work_id", "pages").mapInArrow(make, READ)


def passages(read_works: DataFrame) -> DataFrame:
    return read_works.select("work_id", F.explode("passages").alias("p")).select("work_id", "p.*")


def references_of(cites: DataFrame, works: DataFrame, authorship: DataFrame, authors: DataFrame) -> DataFrame:
    """(work_id, ref_seq, id, title, year, doi, surname, authors): the references of each work as `mentions` wants them.

    The surname is the last word of the first author's name; `works` has (work_id, title, year, doi).
    """
    named = authorship.join(authors.select("author_id", "name"), "author_id").groupBy("work_id").agg(F.min_by("name", "position").alias("first"))
    counted = authorship.groupBy("work_id").agg(F.count("*").alias("authors"))
    surname = F.element_at(F.split(F.trim("first"), r"\s+"), -1)
    known = works.select("work_id", "title", "year", "doi").join(named, "work_id", "left").join(counted, "work_id", "left")
    known = known.select(F.col("work_id").alias("id"), "title", "year", "doi", surname.alias("surname"), F.coalesce("authors", F.lit(0)).alias("authors"))
    return cites.select(F.col("from_work").alias("work_id"), "ref_seq", F.col("to_work").alias("id")).join(known, "id").select("work_id", "ref_seq", "id", "title", "year", "doi", "surname", "authors")


def mentions(works: DataFrame, references: DataFrame) -> DataFrame:
    """Where works (work_id, pages) cite their references (work_id, id, title, year, doi, surname, authors, ref_seq)."""
    fields = ("id", "title", "year", "doi", "surname", "authors")
    listed = references.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("ref_seq", *fields))).alias("refs"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for work, pages, refs in zip(f["work_id"], f["pages"], f["refs"], strict=True):
                rows += [(work, *m) for m in ctx.contexts(list(pages), [_ref(r, fields) for r in refs])]
            yield pd.DataFrame(rows, columns=["from_work", "to_work", "page", "start", "end", "sentence", "section", "marker", "method", "confidence"])

    return works.join(listed, "work_id").select("work_id", "pages", "refs").mapInPandas(make, MENTIONS)


def identity_checked(works: DataFrame) -> DataFrame:
    """Works (pages, title, surname and others) with `same`: whether the text is that of the work."""

    @F.pandas_udf(BooleanType())
    def same(pages: pd.Series, titles: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([pagetext.identity_matches([x or "" for x in p], t or "", n) for p, t, n in zip(pages, titles, names, strict=True)], dtype=bool)

    return works.withColumn("same", same("pages", "title", "surname"))


def front_titles(runs: DataFrame, most: int = 40) -> DataFrame:
    """(work_id, title): the text in the largest size with three words or more, top to bottom, left to right; runs are (work_id, text, size, top, left).

    Sizes within half a point are one, lines within half a size are one; a preprint's stamp is no title, and a list of authors ends it.
    """
    stamp = F.rlike("text", F.lit(r"(?i)arXiv:\s*\S+\s+(?:\[[^\]]{1,30}\]\s+)?\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}"))
    there = runs.filter(~stamp & (F.trim("text") != "")).withColumn("bucket", F.round(F.col("size") * 2) / 2)
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    sized = there.groupBy("work_id", "bucket").agg(F.sum(words).alias("words"), F.collect_list(F.struct("top", "left", "text")).alias("runs")).filter((F.col("words") >= 3) & (F.col("bucket") > 0))
    best = sized.groupBy("work_id").agg(F.max_by("runs", "bucket").alias("runs"), F.max("bucket").alias("bucket"))
    lines = F.transform("runs", lambda r: F.struct((-F.round(r["top"] / (F.col("bucket") / 2))).alias("line"), r["left"].alias("left"), r["text"].alias("text")))
    joined = F.array_join(F.transform(F.array_sort(lines), lambda r: F.trim(r["text"])), " ")
    title = F.regexp_replace(joined, r"\s+(?:[A-Z]\.\s?)+\s?[A-Z][\w-]+\s*(?:,|and\b).*$", "")
    return best.select("work_id", F.array_join(F.slice(F.split(F.trim(title), r"\s+"), 1, most), " ").alias("title"))


def listed_references(works: DataFrame, references: DataFrame) -> DataFrame:
    """(work_id, entry, ref, confidence): the numbered entries of each work's reference list, with the known reference each is matched to, if any."""
    fields = ("id", "title", "year", "doi", "surname", "authors")
    listed = references.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("ref_seq", *fields))).alias("refs"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for work, pages, refs in zip(f["work_id"], f["pages"], f["refs"], strict=True):
                entries, found = ctx.matched_entries(list(pages), [_ref(r, fields) for r in refs])
                rows += [(work, n, found[n][0].id if n in found else None, found[n][1] if n in found else None) for n in entries]
            yield pd.DataFrame(rows, columns=["work_id", "entry", "ref", "confidence"])

    return works.join(listed, "work_id").select("work_id", "pages", "refs").mapInPandas(make, "work_id string, entry int, ref string, confidence double")


def matching_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Listed entries, matched ones, those that the truth (work_id, ref) confirms, and recall and precision."""
    said = found.filter("ref is not null").select("work_id", "ref").distinct()
    right = said.join(truth.select("work_id", "ref").distinct(), ["work_id", "ref"], "left_semi").agg(F.count("*").alias("confirmed"))
    counts = found.agg(F.count("*").alias("listed"), F.count("ref").alias("matched"))
    one = counts.withColumn("confirmed", F.lit(right.first()["confirmed"]))
    return one.withColumns({"recall": F.round(F.col("confirmed") / F.greatest("listed", F.lit(1)), 6), "precision": F.round(F.col("confirmed") / F.greatest("matched", F.lit(1)), 6)})


def _ref(r: dict, fields: tuple[str, ...]) -> ctx.Ref:
    return ctx.Ref(*(None if r[k] is None or r[k] != r[k] else int(r[k]) if k in ("year", "authors") else r[k] for k in fields))


def page_text(chunks: DataFrame) -> DataFrame:
    """(work_id, page, text): pages put together again from passages that may overlap, by their byte offsets."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("end"), F.encode("text", "UTF-8").alias("raw"))))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("out"))
    joined = F.aggregate(
        ordered, empty,
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], F.when((x["start"] > s["at"]) & (F.length(s["out"]) > 0), F.lit("\n").cast("binary")).otherwise(F.lit("").cast("binary")), F.substring(x["raw"], F.greatest(s["at"] - x["start"], F.lit(0)).cast("int") + 1, F.lit(2**31 - 1))).alias("out"))),
        lambda s: F.decode(s["out"], "UTF-8"),
    )
    return chunks.groupBy("work_id", "page").agg(joined.alias("text"))


def shingle_recall(left: DataFrame, right: DataFrame, n: int = 5) -> DataFrame:
    """(id, f1, recall): word F1 and the share of the right text's n-grams that the left one has, for texts (id, words)."""
    bag = lambda t: t.select("id", F.explode("words").alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    grams = lambda t: t.select("id", F.explode(F.array_distinct(F.transform(F.slice("words", 1, F.greatest(F.size("words") - (n - 1), F.lit(0))), lambda w, i: F.concat_ws(" ", w, *[F.get("words", i + k) for k in range(1, n)])))).alias("g"))
    same = bag(left).join(bag(right).withColumnRenamed("n", "m"), ["id", "w"]).groupBy("id").agg(F.sum(F.least("n", "m")).alias("same"))
    kept = grams(right).join(grams(left), ["id", "g"], "left_semi").groupBy("id").agg(F.count("*").alias("kept"))
    of = grams(right).groupBy("id").agg(F.count("*").alias("of"))
    sizes = left.select("id", F.size("words").alias("a")).join(right.select("id", F.size("words").alias("b")), "id")
    joined = sizes.join(same, "id", "left").join(kept, "id", "left").join(of, "id", "left").fillna(0)
    return joined.select("id", F.when(F.col("a") + F.col("b") > 0, 2 * F.col("same") / (F.col("a") + F.col("b"))).otherwise(0.0).alias("f1"), F.when(F.col("of") > 0, F.col("kept") / F.col("of")).otherwise(0.0).alias("recall"))

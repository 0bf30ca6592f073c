"""The index outside the library: resolving identifiers, title candidates, PDF links, and bringing works in.

The index is a table with the columns of works and, where known, doi, pmid, arxiv_id and landing_page; `references` is
its table of (from_work, to_work, ref_seq).  Everything returns new tables; nothing of the index is collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import identity
from quillgraph.functions.presentation import is_open
from quillgraph.functions.textnorm import similarity, titles_match
from quillgraph.operators import merge
from quillgraph.operators.graph import cut
from quillgraph.operators.listing import folded

#: Title candidates shown if no number is asked for, and at most.
SHOWN, MOST = 10, 25


@F.pandas_udf(identity.KIND_VALUE)
def identified(typed: pd.Series) -> pd.DataFrame:
    """The kind and normal form of typed identifiers; `bad` for what looks like one and isn't."""

    def one(text: str | None) -> tuple[str, str | None]:
        try:
            return tuple(identity.parse(text or ""))
        except identity.BadIdentity:
            return "bad", None

    return pd.DataFrame([one(t) for t in typed], columns=["kind", "value"])


def index_keys(index: DataFrame) -> DataFrame:
    """(kind, value, rank, work_id): what an identifier may find; a preprint by the DOI made from its arXiv id first, then by its page."""
    has = set(index.columns)
    text = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    preprint = lambda c, pattern: identity.arxiv_of(F.nullif(F.regexp_extract(F.lower(c), pattern, 1), F.lit("")))
    keys = [
        ("index", 1, text("index_id")), ("doi", 1, identity.doi_of(text("doi"))), ("pmid", 1, text("pmid")), ("work", 1, text("work_id")),
        ("arxiv", 1, preprint(text("doi"), r"10\.48550/arxiv\.(.+)$")), ("arxiv", 2, preprint(text("landing_page"), r"^https?://arxiv\.org/abs/(.+)$")),
    ]
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rank"), v.alias("value")) for k, r, v in keys]))
    return index.select("work_id", every.alias("x")).select("x.*", "work_id").filter("value is not null")


def resolved(asked: DataFrame, index: DataFrame) -> DataFrame:
    """`asked` with (kind, value, found): the work that the typed identifier `typed` names; a title names none."""
    known = asked.withColumn("quill_id", identified("typed"))
    keys = index_keys(index).groupBy("kind", "value").agg(F.min_by("work_id", F.struct("rank", "work_id")).alias("found"))
    named = known.select(*asked.columns, F.col("quill_id.kind").alias("kind"), F.col("quill_id.value").alias("value"))
    return named.join(keys, ["kind", "value"], "left").select(*asked.columns, "kind", "value", "found")


def title_candidates(index: DataFrame, title: str, limit: int = 0) -> DataFrame:
    """Works whose titles hold all words of a typed one (commas, pipes and wildcards carry no meaning): matching titles first, then the most cited."""
    words = title.translate(str.maketrans(",|*?", "    ")).split()
    if not words:
        raise ValueError("an empty title")
    plain = " ".join(words)
    there = F.concat(F.lit(" "), F.regexp_replace(folded(F.col("title")), r"[^\p{L}\p{Nd}]+", " "), F.lit(" "))
    holds = [F.contains(there, F.concat(F.lit(" "), folded(F.lit(w)), F.lit(" "))) for w in words]
    found = index.filter(F.col("title").isNotNull())
    for h in holds:
        found = found.filter(h)
    found = found.withColumns({"title_match": titles_match(F.col("title"), F.lit(plain)), "similarity": similarity(F.col("title"), F.lit(plain))})
    return found.orderBy(F.col("title_match").desc(), F.col("cited_by_count").desc(), "work_id").limit(min(limit or SHOWN, MOST))


def locations(ids: DataFrame, index: DataFrame) -> DataFrame:
    """(work_id, availability, links) of a batch of ids: open PDF links in order, or why there is none; an unknown id has no row.

    `index` has (work_id, oa_status, best, locations) with structs of (url, is_oa, version).
    """
    links = identity.pdf_links(F.col("best"), F.col("locations"))
    asked = index.join(ids.select("work_id").distinct(), "work_id", "left_semi").select("work_id", links.alias("links"), is_open(F.col("oa_status")).alias("free"))
    return asked.select("work_id", F.when(F.size("links") > 0, "open").when(F.col("free"), "no-link").otherwise("closed").alias("availability"), "links")


def fetched(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The works of the index with these ids (work_id, depth), as hydrated ones."""
    found = index.drop("depth").join(ids.select("work_id", "depth"), "work_id")
    return found.withColumns({"hydrated": F.lit(True), "unresolved": F.lit(False), "is_seed": F.lit(False)})


def detail(works: DataFrame, index: DataFrame, ids: DataFrame) -> DataFrame:
    """Give named stubs their details; the graph doesn't grow."""
    new = index.join(ids.select("work_id").distinct(), "work_id", "left_semi")
    return merge.put_details(works, new.select("work_id", "title", "year", "venue", "type", "cited_by_count"))


def hydrate(works: DataFrame, cites: DataFrame, index: DataFrame, references: DataFrame, tombstones: DataFrame, ids: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fetch named works with their references; ids that the index sends elsewhere are folded, unknown ones become unresolved."""
    wanted = works.join(ids.select("work_id").distinct(), "work_id", "left_semi").select("work_id", "depth")
    if aliases is not None:
        moved = wanted.select(F.col("work_id").alias("alias"), "depth").join(aliases.select("alias", "work_id"), "alias")
        targets = moved.groupBy("work_id").agg(F.min("depth").alias("depth"))
        works = merge.upsert_stubs(works, targets)
        works, cites, _ = merge.fold(works, cites, moved.select("alias", "work_id"))
        wanted = wanted.join(moved.select(F.col("alias").alias("work_id")), "work_id", "left_anti").unionByName(targets).groupBy("work_id").agg(F.min("depth").alias("depth"))
    new = fetched(index, wanted).select(*works.columns)
    works = merge.upsert_works(works, new)
    missing = wanted.join(index.select("work_id"), "work_id", "left_anti")
    works = merge.mark(works, missing, "unresolved")
    lists = references.join(new.select(F.col("work_id").alias("from_work")), "from_work", "left_semi").groupBy(F.col("from_work").alias("work_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_seq", "to_work"))), lambda x: x["to_work"]).alias("references"))
    return merge.record_references(works, cites, lists, tombstones)


def bring_around(works: DataFrame, cites: DataFrame, index: DataFrame, references: DataFrame, tombstones: DataFrame, centre: str, refs: bool = True, follow: bool = False, citing: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step around a work, in either direction, without growing the rest of the graph.

    Its stubs get their details, or are fetched if `follow`; of the works that cite it the `citing` most cited come in one
    step deeper, with their details and the citation, or are fetched; deleted ones stay deleted.  Returns the new works and
    cites, and the works that came in (work_id, new).
    """
    one = works.filter(F.col("work_id") == centre)
    if one.filter("index_id is not null").isEmpty():
        raise ValueError(f"{centre} is not a work of the index")
    if refs and not one.filter("not hydrated").isEmpty():
        works, cites = hydrate(works, cites, index, references, tombstones, one)
    if refs:
        stubs = works.filter("not hydrated and not unresolved and index_id is not null").join(cites.filter(F.col("from_work") == centre).select(F.col("to_work").alias("work_id")), "work_id", "left_semi")
        if follow:
            works, cites = hydrate(works, cites, index, references, tombstones, stubs)
        else:
            works = detail(works, index, stubs)
    works, cites = cut(works), cut(cites)
    near = references.filter(F.col("to_work") == centre).select(F.col("from_work").alias("work_id"))
    top = index.join(near, "work_id", "left_semi").orderBy(F.col("cited_by_count").desc(), "work_id").limit(max(citing, 0))
    top = cut(top.join(tombstones.select("work_id"), "work_id", "left_anti"))
    came = top.select("work_id").join(works.select("work_id", F.lit(False).alias("new")), "work_id", "left").fillna({"new": True})
    depth = works.filter(F.col("work_id") == centre).first()["depth"]
    grown = merge.upsert_stubs(works, top.select("work_id", F.lit((depth or 0) + 1).alias("depth")))
    if follow:
        grown, cites = hydrate(grown, cites, index, references, tombstones, top)
    else:
        grown = detail(grown, index, top)
        edges = top.select(F.col("work_id").alias("from_work"), F.lit(centre).alias("to_work")).join(cites.select("from_work", "to_work"), ["from_work", "to_work"], "left_anti")
        cites = cites.unionByName(edges.withColumn("ref_seq", F.lit(None).cast(cites.schema["ref_seq"].dataType)).select(*cites.columns))
    return grown, cites, came


def add_seed(works: DataFrame, cites: DataFrame, index: DataFrame, references: DataFrame, tombstones: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add works of the index as seeds: the works at depth 0, a stub for each reference, and the edges between."""
    seeds = ids.select("work_id").distinct().withColumn("depth", F.lit(0))
    works, cites = hydrate(merge.upsert_stubs(works, seeds), cites, index, references, tombstones, seeds)
    return merge.mark(works, seeds, "is_seed"), cites

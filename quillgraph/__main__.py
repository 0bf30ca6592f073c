"""The engine on the command line: `python -m quillgraph COMMAND`, over a folder of Parquet tables.

A library is a folder with the tables of `TABLES` as Parquet (missing ones count as empty).  Commands print rows as JSON lines.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import presentation
from quillgraph.operators import graph, listing, merge, search, shelf, stats
from quillgraph.sources import exports

TABLES = {
    "works": "work_id string, index_id string, title string, year int, venue string, type string, cited_by_count long, hydrated boolean, is_seed boolean, depth int, unresolved boolean, arrival long",
    "cites": "from_work string, to_work string, ref_seq long", "authors": "author_id string, name string", "authorship": "work_id string, author_id string, position long",
    "files": "work_id string, path string, missing boolean, version string, added_at long", "read_state": "work_id string, status string, pages int", "collections": "id int, name string, parent_id int",
    "collection_work": "collection_id int, work_id string", "labels_of": "label string, work_id string", "favourites": "work_id string", "attempts": "attempt_id long, work_id string, outcome string",
    "mentions": "from_work string, to_work string, page int, start long, sentence string, confidence double", "passages": "work_id string, page int, ordinal int, text string",
}


class Library:
    """The tables of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.parquet")
        if where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self.spark.createDataFrame([], TABLES[name])

    def layers(self) -> dict[str, DataFrame]:
        return {n: self[n] for n in ("files", "read_state", "collections", "collection_work", "favourites", "labels_of", "authorship", "authors")}


def _asked(a: argparse.Namespace) -> listing.Query:
    return listing.Query(seeds=a.seeds, with_pdf=a.with_pdf, starred=a.starred, collection=a.collection, labels=tuple(a.label), year_from=a.year_from, year_to=a.year_to, authors=tuple(a.author), venues=tuple(a.venue), title=a.title, order=a.sort, offset=a.offset, limit=a.limit)


def _search(lib: Library, a: argparse.Namespace) -> DataFrame:
    """Passages by BM25 with every term, or else with some; the best three of a paper, marked."""
    rows = graph.cut(lib["passages"].select(F.concat_ws("#", "work_id", "ordinal").alias("passage_id"), F.col("work_id").alias("paper_id"), "page", "text", search.stems("text").alias("words")))
    terms = search.subject(search.parse(" ".join(a.words)))
    stemmed = [search.Term(tuple(w if t.prefix else search.stem(w) for w in t.words), t.prefix) for t in terms]
    read = rows.join(lib["read_state"].filter("status = 'ok'").select(F.col("work_id").alias("paper_id")), "paper_id", "left_semi")
    scored = search.all_or_any(search.bm25(search.matching(graph.cut(search.postings(read)), stemmed), search.corpus(read)), len(stemmed))
    titles = lib["works"].select(F.col("work_id").alias("passage_id"), F.col("work_id").alias("paper_id"), search.stems("title").alias("words"))
    named = search.papers(search.bm25(search.matching(search.postings(titles), stemmed), search.corpus(titles)), titles)
    chosen = search.selected(scored, read, search.fused(search.papers(scored, read), named), a.limit)
    wanted = F.array(*[F.lit(w) for t in stemmed for w in t.words])
    return chosen.join(rows.select("passage_id", "page", "text"), "passage_id").select("paper_id", "page", "rank", "place", search.snippets("text", wanted).alias("snippet")).orderBy("rank", "place")


def _groups(lib: Library, a: argparse.Namespace) -> DataFrame:
    found = graph.cut(graph.groups(lib["cites"], {"broad": 0.5, "normal": 1.0, "fine": 2.0}[a.detail]))
    choices = lib.spark.createDataFrame([], "anchor string, dismissed boolean, collection_id int")
    shown = presentation.group_summaries(found, lib["works"], lib["authorship"].join(lib["authors"], "author_id"), choices)
    return presentation.group_of(shown, a.group) if a.group else shown.orderBy("index")


def _path(lib: Library, a: argparse.Namespace) -> DataFrame:
    found = graph.lineage(lib["works"], lib["cites"], a.work, a.other, a.hops, a.either) or []
    return lib.spark.createDataFrame([(n, w, f) for n, (w, f) in enumerate(found)], "step int, work_id string, cites boolean")


def _neighbours(lib: Library, a: argparse.Namespace) -> DataFrame:
    ids = lib.spark.createDataFrame([(a.work,)], "work_id string")
    return graph.neighbours(lib["works"], lib["cites"], ids, not a.citing).select("rank", "work_id", "title", "year", "hydrated").orderBy("rank").limit(a.limit)


def _export(lib: Library, a: argparse.Namespace) -> DataFrame:
    exports.write_graphml(lib["works"], lib["cites"], a.to, a.stubs)
    return lib.spark.createDataFrame([(a.to,)], "written string")


def _run(lib: Library, a: argparse.Namespace) -> DataFrame:
    from quillgraph.queries import QUERIES

    return QUERIES[a.name](lib.spark, lib.path)


COMMANDS = {
    "stats": lambda lib, a: stats.summary(lib["works"], lib["cites"]),
    "neighbours": _neighbours,
    "path": _path,
    "groups": _groups,
    "search": _search,
    "export": _export,
    "list": lambda lib, a: listing.list_works(lib["works"], lib["cites"], _asked(a), lib.layers()),
    "show": lambda lib, a: shelf.show(lib["works"].filter(F.col("work_id") == a.work), lib["cites"], lib.layers(), lib["attempts"], lib["mentions"]),
    "fetch": lambda lib, a: stats.fetch_next(lib["works"], lib["cites"], lib["files"], a.limit),
    "expand": lambda lib, a: graph.frontier(lib["works"], lib["cites"], a.limit, a.depth),
    "match": lambda lib, a: merge.find_title(lib["works"], " ".join(a.words)).select("work_id", "title", "similarity"),
    "cited": lambda lib, a: shelf.cited_on_pages(lib["mentions"].filter(F.col("from_work") == a.work)).orderBy("page"),
    "run": _run,
}


#: Commands that change and write nothing.
READS = {n: c for n, c in COMMANDS.items() if n not in ("export", "run")}


class _Strict(argparse.ArgumentParser):
    """Errors are raised instead of ending the process."""

    def error(self, message: str):
        raise ValueError(message)


def parser(strict: bool = True) -> argparse.ArgumentParser:
    kind = argparse.ArgumentParser if strict else _Strict
    p = kind(prog="quillgraph")
    p.add_argument("--library", default=".", help="the folder of the tables")
    sub = p.add_subparsers(dest="command", required=True, parser_class=kind)
    made = {n: sub.add_parser(n) for n in [*COMMANDS, "serve", "version"]}
    made["serve"].add_argument("--host", default="127.0.0.1")
    made["serve"].add_argument("--port", type=int, default=8765)
    for n in ("neighbours", "path", "show", "cited"):
        made[n].add_argument("work")
    for n, limit in (("neighbours", 50), ("search", 10), ("list", None), ("fetch", 200), ("expand", 100)):
        made[n].add_argument("--limit", type=int, default=limit)
    made["neighbours"].add_argument("--citing", action="store_true")
    made["path"].add_argument("other")
    made["path"].add_argument("--hops", type=int, default=6)
    made["path"].add_argument("--either", action="store_true")
    made["groups"].add_argument("group", nargs="?")
    made["groups"].add_argument("--detail", choices=("broad", "normal", "fine"), default="normal")
    made["export"].add_argument("to")
    made["export"].add_argument("--stubs", action="store_true")
    made["expand"].add_argument("--depth", type=int, default=3)
    made["run"].add_argument("name")
    for n in ("search", "match"):
        made[n].add_argument("words", nargs="+")
    q = made["list"]
    for flag in ("seeds", "with-pdf", "starred"):
        q.add_argument(f"--{flag}", action="store_true")
    for many in ("label", "author", "venue"):
        q.add_argument(f"--{many}", action="append", default=[])
    q.add_argument("--collection")
    q.add_argument("--year-from", type=int)
    q.add_argument("--year-to", type=int)
    q.add_argument("--title", default="")
    q.add_argument("--sort", default="default")
    q.add_argument("--offset", type=int, default=0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    a = parser().parse_args(argv)
    if a.command == "version":
        print("quillgraph", file=out)
        return 0
    spark = spark or SparkSession.builder.appName("quillgraph").getOrCreate()
    if a.command == "serve":
        from quillgraph.server import serve

        serve(spark, a.library, a.host, a.port).serve_forever()
    for row in COMMANDS[a.command](Library(spark, a.library), a).toJSON().toLocalIterator():
        print(row, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

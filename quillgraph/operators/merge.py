"""Changes to the library: functions from table states to table states.

Each takes and returns DataFrames, is idempotent, and is one plan of keyed joins; the caller writes
the new state (a partition overwrite, or MERGE where the table format has it).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.textnorm import similarity


def upsert(rows: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """Keyed union: new rows are added, present ones overwritten, or merged by `merge` (expressions over `old.x` and `new.x`)."""
    merge = merge or {}
    both = rows.alias("old").join(new.alias("new"), reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]), "full_outer")
    there, fresh = F.col(f"old.{keys[0]}").isNotNull(), F.col(f"new.{keys[0]}").isNotNull()

    def column(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))
        if c not in new.columns:
            return F.col(f"old.{c}")
        return F.when(fresh & there, merge.get(c, F.col(f"new.{c}"))).when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    return both.select(*[column(c).alias(c) for c in rows.columns])


def removed(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def mark(works: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """Works with a flag (unresolved, is_seed) set for some ids; a work that has been fetched is never unresolved."""
    ids = ids.select("work_id").distinct().withColumn("quill_mark", F.lit(True))
    new = F.coalesce("quill_mark", F.lit(False)) & (~F.col("hydrated") if flag == "unresolved" else F.lit(True))
    return works.join(ids, "work_id", "left").withColumn(flag, F.col(flag) | new).select(*works.columns)


def upsert_works(works: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched works: metadata is overwritten, the depth only lowers, a seed stays one, the first source is kept."""
    merge = {"depth": F.least("old.depth", "new.depth"), "is_seed": F.col("old.is_seed") | F.col("new.is_seed"), "arrival": F.col("old.arrival")}
    if "source" in works.columns:
        merge["source"] = F.coalesce("old.source", "new.source")
    return upsert(works, fetched.withColumns({"hydrated": F.lit(True), "unresolved": F.lit(False)}), ["work_id"], merge)


def upsert_stubs(works: DataFrame, stubs: DataFrame) -> DataFrame:
    """(work_id, depth): unseen ones become stubs, known ones only lower their depth."""
    low = stubs.groupBy("work_id").agg(F.min("depth").alias("new_depth"))
    known = works.join(low, "work_id", "left").withColumn("depth", F.least("depth", "new_depth")).select(*works.columns)
    blank = {c: F.lit(None).cast(works.schema[c].dataType).alias(c) for c in works.columns}
    blank |= {"work_id": F.col("work_id"), "index_id": F.col("work_id").alias("index_id"), "depth": F.col("new_depth").cast(works.schema["depth"].dataType).alias("depth")}
    blank |= {c: F.lit(False).alias(c) for c in ("hydrated", "is_seed", "unresolved") if c in works.columns}
    fresh = low.join(works.select("work_id"), "work_id", "left_anti").select(*[blank[c] for c in works.columns])
    return known.unionByName(fresh)


def record_references(works: DataFrame, cites: DataFrame, lists: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work_id, references array): edges in list order without self-citations, repeats and deleted works; stubs one step deeper."""
    flat = lists.select("work_id", F.posexplode("references").alias("pos", "to_work")).filter("to_work is not null and to_work <> work_id")
    first = flat.groupBy("work_id", "to_work").agg(F.min("pos").alias("pos")).join(tombstones.select(F.col("work_id").alias("to_work")).distinct(), "to_work", "left_anti")
    deeper = first.join(works.select("work_id", "depth"), "work_id").groupBy("to_work").agg((F.min("depth") + 1).alias("depth")).withColumnRenamed("to_work", "work_id")
    new = first.select(F.col("work_id").alias("from_work"), "to_work", (F.col("pos") + 1).cast(cites.schema["ref_seq"].dataType).alias("ref_seq"))
    return upsert_stubs(works, deeper), cites.unionByName(new.join(cites, ["from_work", "to_work"], "left_anti").select(*cites.columns))


def upsert_edges(cites: DataFrame, new: DataFrame) -> DataFrame:
    """What is known of an edge: a new value that isn't null wins."""
    extra = [c for c in new.columns if c not in ("from_work", "to_work")]
    if not new.filter("from_work = to_work").isEmpty():
        raise ValueError("a work can't cite itself")
    return upsert(cites, new, ["from_work", "to_work"], {c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) for c in extra})


def remapped(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """`column` with ids replaced by those that (alias, work_id) maps them to."""
    to = aliases.select(F.col("alias").alias("quill_alias"), F.col("work_id").alias("quill_to"))
    return rows.join(to, rows[column] == to.quill_alias, "left").withColumn(column, F.coalesce("quill_to", F.col(column))).drop("quill_alias", "quill_to")


def fold(works: DataFrame, cites: DataFrame, aliases: DataFrame, layers: dict[str, tuple[DataFrame, list[str]]] | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Fold works into others: aliases is (alias, work_id), one step.

    Edges move both ways, without self-citations and repeats (the smallest ref_seq stays); a seed and the lower
    depth pass on; the rows of each layer (table, key columns with work_id) move unless the survivor has them.
    """
    gone = works.join(aliases.select(F.col("alias").alias("work_id")), "work_id", "left_semi")
    passed = remapped(gone.select("work_id", "depth", "is_seed"), aliases, "work_id").groupBy("work_id").agg(F.min("depth").alias("d"), F.max("is_seed").alias("s"))
    kept = works.join(aliases.select(F.col("alias").alias("work_id")), "work_id", "left_anti").join(passed, "work_id", "left")
    kept = kept.withColumns({"depth": F.least("depth", "d"), "is_seed": F.col("is_seed") | F.coalesce("s", F.lit(False))}).select(*works.columns)
    moved = remapped(remapped(cites, aliases, "from_work"), aliases, "to_work").filter("from_work <> to_work")
    rest = [c for c in cites.columns if c not in ("from_work", "to_work", "ref_seq")]
    moved = moved.groupBy("from_work", "to_work").agg(F.min("ref_seq").alias("ref_seq"), *[F.min_by(c, "ref_seq").alias(c) for c in rest]).select(*cites.columns)
    return kept, moved, {n: remapped(t, aliases, "work_id").dropDuplicates(keys) for n, (t, keys) in (layers or {}).items()}


def doi_survivors(works: DataFrame) -> DataFrame:
    """(alias, work_id): works whose DOI an earlier one holds."""
    first = Window.partitionBy("doi").orderBy("arrival", "work_id")
    held = works.filter("doi is not null").withColumn("holder", F.first("work_id").over(first))
    return held.filter("holder <> work_id").select(F.col("work_id").alias("alias"), F.col("holder").alias("work_id"))


def put_details(works: DataFrame, details: DataFrame) -> DataFrame:
    """Title and year of stubs are overwritten, venue and type filled in, the count only grows; fetched works stay."""
    new = details.join(works.filter("not hydrated").select("work_id"), "work_id", "left_semi")
    merge = {"venue": F.coalesce("old.venue", "new.venue"), "type": F.coalesce("old.type", "new.type"), "cited_by_count": F.greatest("old.cited_by_count", "new.cited_by_count")}
    return upsert(works, new, ["work_id"], merge)


def replace_bylines(authorship: DataFrame, new: DataFrame) -> DataFrame:
    """(work_id, author_id, position): the authors of the works in `new`; unnamed ones go, the first position stays."""
    first = new.filter("coalesce(author_id, '') <> ''").groupBy("work_id", "author_id").agg(F.min("position").alias("position"))
    return removed(authorship, new, ["work_id"]).unionByName(first.select(*authorship.columns))


def delete_works(tables: dict[str, DataFrame], gone: DataFrame, tombstones: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove works from all tables (work_id, or from_work and to_work) and remember those the index knows."""
    ids = gone.select("work_id").distinct()
    out = {}
    for name, t in tables.items():
        if "from_work" in t.columns:
            t = t.join(ids.withColumnRenamed("work_id", "from_work"), "from_work", "left_anti").join(ids.withColumnRenamed("work_id", "to_work"), "to_work", "left_anti").select(*t.columns)
        else:
            t = t.join(ids, "work_id", "left_anti").select(*t.columns)
        out[name] = t
    known = tables["works"].join(ids, "work_id", "left_semi").filter("index_id is not null").select("work_id", "title")
    return out, tombstones.join(known.select("work_id"), "work_id", "left_anti").select("work_id", "title").unionByName(known)


def put_mentions(mentions: DataFrame, cites: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the mentions of the citing works in `new`, and (from, to, context, confidence) of all edges.

    A mention without an edge refuses the whole write.
    """
    if not new.join(cites, ["from_work", "to_work"], "left_anti").isEmpty():
        raise ValueError("a mention has no edge")
    kept = removed(mentions, new, ["from_work"]).unionByName(new.select(*mentions.columns))
    contexts = kept.groupBy("from_work", "to_work").agg(F.min_by("sentence", F.struct("page", "start")).alias("context"), F.max("confidence").alias("confidence"))
    return kept, contexts


def sync(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The difference to a wanted table: its keys with `change` = add or remove."""
    add = wanted.select(*keys).distinct().join(current.select(*keys), keys, "left_anti").withColumn("change", F.lit("add"))
    return add.unionByName(current.select(*keys).distinct().join(wanted.select(*keys), keys, "left_anti").withColumn("change", F.lit("remove")))


def scan_diff(recorded: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, work_id, state, was): files on disk against recorded ones: same, changed, moved (by size and hash), missing or loose.

    recorded is (path, work_id, sha256, size), disk is (path, sha256, size).
    """
    a, b = recorded.alias("a"), disk.alias("b")
    at_path = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    both = at_path.filter("a.path is not null and b.path is not null").select(F.col("b.path"), "work_id", F.when(F.col("a.sha256") == F.col("b.sha256"), "same").otherwise("changed").alias("state"), F.lit(None).cast("string").alias("was"))
    lost = at_path.filter("b.path is null").select(F.col("a.path").alias("was"), "work_id", F.col("a.sha256").alias("sha256"), F.col("a.size").alias("size"))
    found = at_path.filter("a.path is null").select(F.col("b.path").alias("path"), F.col("b.sha256").alias("sha256"), F.col("b.size").alias("size"))
    number = lambda t, c: t.withColumn("k", F.row_number().over(Window.partitionBy("sha256", "size").orderBy(c)))
    pairs = number(lost, "was").join(number(found, "path"), ["sha256", "size", "k"], "full_outer")
    moved = pairs.select(F.coalesce("path", "was").alias("path"), "work_id", F.when(F.col("was").isNull(), "loose").when(F.col("path").isNull(), "missing").otherwise("moved").alias("state"), F.when(F.col("path").isNotNull(), F.col("was")).alias("was"))
    return both.unionByName(moved)


def resolve(refs: DataFrame, works: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref, work_id): keys that are a work id, an index id or an alias, in that order of preference; unknown ones are null."""
    keys = works.select(F.col("work_id").alias("ref"), F.lit(1).alias("p"), "work_id").unionByName(works.filter("index_id is not null").select(F.col("index_id").alias("ref"), F.lit(2).alias("p"), "work_id")).unionByName(aliases.select(F.col("alias").alias("ref"), F.lit(3).alias("p"), "work_id"))
    best = keys.join(refs.select("ref").distinct(), "ref", "left_semi").groupBy("ref").agg(F.min_by("work_id", F.struct("p", "work_id")).alias("work_id"))
    return refs.join(best, "ref", "left").select(*refs.columns, "work_id")


def find_title(works: DataFrame, title: str, least: float = 0.85) -> DataFrame:
    """Works whose titles match a typed one, the most similar first: several mean that it is ambiguous."""
    near = works.withColumn("similarity", similarity(F.col("title"), F.lit(title))).filter(F.col("similarity") >= least)
    return near.orderBy(F.col("similarity").desc(), "work_id")


def batch_fetch(ids: DataFrame, index: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, aliases, missing) of normalised ids (work_id) against an index; redirects is (alias, work_id)."""
    wanted = ids.select("work_id").distinct()
    aliases = wanted.withColumnRenamed("work_id", "alias").join(redirects.select("alias", "work_id"), "alias")
    targets = wanted.join(aliases.select(F.col("alias").alias("work_id")), "work_id", "left_anti").unionByName(aliases.select("work_id")).distinct()
    return index.join(targets, "work_id", "left_semi"), aliases, targets.join(index, "work_id", "left_anti")


def import_verdicts(files: DataFrame, earlier: DataFrame) -> DataFrame:
    """(path, outcome): what becomes of imported files.

    files is (path, sha256, verified, named, candidates): identifiers verified, identifiers found, titles that match.
    """
    old = earlier.select("sha256", F.col("outcome").alias("before"))
    outcome = F.when(F.col("before").isNotNull(), F.concat(F.lit("duplicate of "), "before")).when(F.col("verified") > 0, "filed").when(F.col("candidates") == 1, "filed by title").when(F.col("candidates") > 1, "candidates").when(F.col("named") > 0, "unconfirmed").otherwise("unidentified")
    return files.join(old, "sha256", "left").select("path", outcome.alias("outcome"))

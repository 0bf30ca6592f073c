"""A scan of the library folder: what lies on disk against what is recorded, whole folders before single files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.graph import cut, small

#: A group of equal keys is numbered in this many parts.
PARTS = 256
#: Keys of more rows than this are numbered in parts before they are paired.
MANY = 100_000
_CONTENT = ["sha256", "size"]
_OTHER = "?" * 33


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`rows` with `k`, gapless from 1 within `keys`; a group of any size is sorted in `PARTS` parts, which are counted first.

    Rows with a null key belong to no group and are left out.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64(order), F.lit(PARTS)))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "part").agg(F.count("*").alias("held_by_part")).withColumn("start", F.coalesce(F.sum("held_by_part").over(before), F.lit(0))).drop("held_by_part")
    within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(order))
    return rows.withColumn("k", within).join(starts, [*keys, "part"]).withColumn("k", F.col("k") + F.col("start")).drop("part", "start")


def _above(rows: DataFrame) -> DataFrame:
    """Each row once for each folder above its `path`, as `above`."""
    parts = F.split("path", "/")
    return rows.withColumn("above", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))))


def _dir(path: str) -> Column:
    """The folder that a path lies in; null where it names none."""
    return F.when(F.col(path).contains("/"), F.expr(f"substring({path}, 1, length({path}) - length(substring_index({path}, '/', -1)) - 1)"))


def _nearest(rows: DataFrame, folders: DataFrame, *values: str) -> DataFrame:
    """(path, above, *values): the deepest of `folders` (above, *values) over each path of `rows` that has one."""
    found = _above(rows.select("path").distinct()).join(folders, "above")
    best = F.max_by(F.struct("above", *values), F.length("above")).alias("best")
    return found.groupBy("path").agg(best).select("path", "best.*")


def _under(rows: DataFrame, path: str, folders: DataFrame, *values: str) -> DataFrame:
    """`rows` with (above, *values) of the deepest of `folders` over each `path`, else nulls; looked up once for each folder that has files."""
    rows = rows.withColumn("lies_in", _dir(path))
    dirs = rows.select(F.concat("lies_in", F.lit("/")).alias("path")).filter("path is not null")
    found = _nearest(dirs, folders, *values).withColumn("lies_in", F.expr("substring(path, 1, length(path) - 1)")).drop("path")
    return rows.join(small(cut(found)), "lies_in", "left").drop("lies_in")


def _packed(sha: Column) -> Column:
    """A SHA-256 in hex as its 32 bytes, any other text as more than 32; the inverse is `_unpacked`."""
    return F.when(sha.rlike("^[0-9a-f]{64}\\z"), F.unhex(sha)).otherwise(F.concat(F.lit(_OTHER).cast("binary"), sha.cast("binary")))


def _unpacked(sha: Column) -> Column:
    return F.when(F.length(sha) == 32, F.lower(F.hex(sha))).otherwise(F.substring(sha, len(_OTHER) + 1, 2147483647).cast("string"))


def _below(path: Column, old: Column, new: Column) -> Column:
    return F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))


def _pairs(lost: DataFrame, found: DataFrame, *within: str) -> DataFrame:
    """(path, to, owner): recorded files and files on disk of the same content (and the same `within`), one to one.

    Both sides are shuffled together once; contents of more than `MANY` rows are numbered in parts and joined.
    """
    keys, full = [*within, *_CONTENT], "sha256 is not null and size is not null"
    text = F.lit(None).cast("string")
    owner = F.col("owner") if "owner" in lost.columns else text
    a = lost.filter(full).select(*keys, "path", owner.alias("owner"))
    b = found.filter(full).select(*keys, F.col("path").alias("to"))
    rows = a.withColumn("to", text).unionByName(b.withColumns({"path": text, "owner": text})).withColumn("h", F.xxhash64(*keys))
    often = cut(rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select("h"))
    some = not often.isEmpty()
    few = rows.join(F.broadcast(often), "h", "left_anti") if some else rows
    k = F.row_number().over(Window.partitionBy(*keys, F.col("to").isNull()).orderBy(F.coalesce("path", "to")))
    out = few.drop("h").repartition(*keys).withColumn("k", k).groupBy(*keys, "k").agg(F.max("path").alias("path"), F.max("to").alias("to"), F.max("owner").alias("owner")).filter("path is not null and to is not null").select("path", "to", "owner")
    if some:
        big = lambda t: t.withColumn("h", F.xxhash64(*keys)).join(F.broadcast(often), "h", "left_semi").drop("h")
        out = out.unionByName(numbered(big(a), keys, "path").join(numbered(big(b), keys, "to"), [*keys, "k"]).select("path", "to", "owner"))
    return out


def _contents(files: DataFrame, folder: str) -> DataFrame:
    """A folder's files as four sums that don't depend on their order; none for a folder with an unknown content."""
    one, two = F.xxhash64("sha256", "size"), F.xxhash64("size", "sha256")
    return files.groupBy(folder).agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s1"), F.sum(two.cast("decimal(38,0)")).alias("s2"), F.bit_xor(one).alias("x"), F.bool_and(F.col("sha256").isNotNull() & F.col("size").isNotNull()).alias("all")).filter("all").drop("all")


def scan(folders: DataFrame, files: DataFrame, known: DataFrame, disk_folders: DataFrame, disk: DataFrame, root: str = "papers") -> tuple[DataFrame, DataFrame]:
    """What a scan of `root` finds: (folders, files), each as (path, work_id, state, was).

    folders is (path, work_id) and files (path, work_id, sha256, size) as recorded; known (ref, work_id) says which work an id means, in
    either case; disk_folders (path) and disk (path, sha256, size) are what is there.  A path is a key of its table: of repeated rows
    the least counts.  A folder on disk is a work's if its name ends in two dashes and a known id, and no folder
    above it ends in an id.

    A folder is "same" where it was recorded; "moved" if its work's recorded folder is gone (the k-th such folder by the k-th gone); "second" if
    none is; "unknown" if its id is; "renamed" if a recorded folder is gone and its files lie in one folder without an id; else "missing".
    A renamed folder is first one whose files are all those of the gone one, then one that holds each of its files that was found
    anywhere; of gone folders that mean the same one, the first by path gets it, and the top folder is never one.

    Files follow their folder (`was` is where they were recorded) and are "same" or "changed" where they are, "new" in a work's
    folder, else "moved" by content among files in no work's folder, else "missing"; PDFs in no work's folder that nothing claims are "loose".
    Equal contents are interchangeable.  Null paths and paths with a part that begins with a dot are left out, null contents match nothing, an
    empty table is a library or a disk without anything, other columns are not read.
    """
    content = (_packed(F.lower("sha256")).alias("sha256"), F.col("size").cast("long").alias("size"))
    text = F.lit(None).cast("string")
    visible = lambda t: t.filter("path is not null and not path rlike '(^|/)[.]'")
    folders = cut(visible(folders).groupBy("path").agg(F.min("work_id").alias("work_id")))
    files = visible(files).select("path", "work_id", *content)
    there = cut(visible(disk_folders).select("path").distinct())
    disk = visible(disk).select("path", *content)

    # Folders by the id in their names.
    known = known.groupBy(F.upper("ref").alias("ref")).agg(F.min("work_id").alias("work_id"))
    named = there.withColumn("ref", F.upper(F.regexp_extract("path", "--([^/-]+)$", 1))).filter("ref <> ''")
    under = cut(_nearest(there, named.select(F.col("path").alias("above"))).select("path"))
    there = there.join(under, "path", "left_anti")
    named = cut(named.join(under, "path", "left_anti").join(known, "ref", "left").select("path", "work_id"))
    homes = named.filter("work_id is not null")
    plain = folders.join(there, "path", "left_semi").join(named, "path", "left_anti")
    kept = homes.join(folders.select("path"), "path", "left_semi").unionByName(plain)
    gone = folders.join(kept.select("path"), "path", "left_anti").select(F.col("path").alias("was"), "work_id")
    come = homes.join(folders.select("path"), "path", "left_anti")
    met = cut(numbered(come, ["work_id"], "path").join(numbered(gone, ["work_id"], "was"), ["work_id", "k"], "full_outer").select("path", "work_id", "was"))
    moved, vanished = met.filter("path is not null and was is not null"), met.filter("path is null").select("was", "work_id").unionByName(gone.filter("work_id is null"))

    # Recorded files go with their folders, and meet what lies there in one shuffle; `was` is null in a row of the disk.
    led = _under(files, "path", moved.select(F.col("was").alias("above"), F.col("path").alias("to")), "to")
    led = led.select(F.coalesce(_below(F.col("path"), F.col("above"), F.col("to")), "path").alias("path"), F.col("path").alias("was"), "work_id", *_CONTENT, F.lit(False).alias("home"))
    inside = _under(disk, "path", named.select(F.col("path").alias("above"), "work_id"), "work_id").filter("above is null or work_id is not null")
    inside = inside.select("path", text.alias("was"), "work_id", *_CONTENT, F.col("above").isNotNull().alias("home"))
    rows = led.unionByName(inside).repartition("path").withColumn("sha256", _unpacked(F.col("sha256")))
    rows = rows.groupBy("path", "was").agg(F.min(F.struct("work_id", *_CONTENT)).alias("f"), F.max("home").alias("home")).select("path", "was", "f.*", "home")
    here = Window.partitionBy("path")
    on_disk = F.col("was").isNull()
    rows = rows.withColumns({"there": F.max(on_disk).over(here), "held": F.min(F.when(~on_disk, F.struct("was", "work_id", *_CONTENT))).over(here)})
    kind = F.when(on_disk & (F.col("held").isNotNull() | F.col("home")), "at").when(on_disk, "spare").when(~F.col("there") | (F.col("was") != F.col("held.was")), "unseen")
    state = F.when(F.col("held").isNull(), "new").when((F.col("sha256") == F.col("held.sha256")) & (F.col("size") == F.col("held.size")), "same").otherwise("changed")
    at = F.col("kind") == "at"
    rows = rows.withColumn("kind", kind).filter("kind is not null").select(
        "path", F.when(at, F.col("held.was")).otherwise(F.col("was")).alias("was"), F.when(at, F.coalesce("work_id", "held.work_id")).otherwise(F.col("work_id")).alias("work_id"),
        F.when(~at, _packed(F.col("sha256"))).alias("sha256"), F.when(~at, F.col("size")).alias("size"), F.when(at, state).alias("state"), "kind",
    )
    rows = cut(rows)
    placed = rows.filter("kind = 'at'").select("path", "work_id", "state", F.when(F.col("was") != F.col("path"), F.col("was")).alias("was"))
    spare = rows.filter("kind = 'spare'").select("path", *_CONTENT, F.coalesce(_dir("path"), F.lit("")).alias("dir"))

    # Vanished folders: by all their files, then by those that were found.
    unseen = _under(rows.filter("kind = 'unseen'").select(F.col("path").alias("now"), F.col("was").alias("path"), "work_id", *_CONTENT), "now", vanished.select(F.col("was").alias("above")))
    unseen = cut(unseen.withColumnRenamed("above", "owner"))
    mine = unseen.filter("owner is not null").select("path", *_CONTENT, "owner")
    taken = kept.select("path").unionByName(met.filter("path is not null").select("path"))
    free = spare.filter((F.col("dir") != root) & (F.col("dir") != "")).join(taken.select(F.col("path").alias("dir")), "dir", "left_anti")
    sums = ["n", "s1", "s2", "x"]
    whole = numbered(_contents(mine, "owner"), sums, "owner").join(numbered(_contents(free, "dir"), sums, "dir"), [*sums, "k"]).select("owner", "dir")
    whole = cut(whole)
    some = small(whole)
    by_whole = cut(_pairs(mine.join(some, "owner"), spare.join(some.select("dir"), "dir", "left_semi"), "dir").select("path", "to"))
    rest = mine.join(some.select("owner"), "owner", "left_anti")
    left = spare.join(by_whole.select(F.col("to").alias("path")), "path", "left_anti")
    hits = cut(_pairs(rest, left).withColumn("dir", F.coalesce(_dir("to"), F.lit(""))))
    single = hits.groupBy("owner").agg(F.min("dir").alias("dir"), F.max("dir").alias("other")).filter("dir = other").drop("other")
    single = single.filter((F.col("dir") != root) & (F.col("dir") != "")).join(taken.select(F.col("path").alias("dir")), "dir", "left_anti").join(whole.select("dir"), "dir", "left_anti")
    renamed = cut(whole.unionByName(single.groupBy("dir").agg(F.min("owner").alias("owner"))))
    by_found = hits.join(renamed, ["owner", "dir"], "left_semi").select("path", "to")
    followed = cut(by_whole.unionByName(by_found))

    # Single files, by content.
    lost = unseen.join(followed.select("path"), "path", "left_anti")
    open_ = spare.join(followed.select(F.col("to").alias("path")), "path", "left_anti")
    alone = cut(_pairs(lost.select("path", *_CONTENT), open_).select("path", "to"))
    gone_to = unseen.select("path", "now", "work_id", "owner").join(followed.unionByName(alone), "path", "left").join(small(renamed), "owner", "left")
    where = F.coalesce("to", _below(F.col("now"), F.col("owner"), F.col("dir")), "now")  # the last two name a missing file
    fate = F.when(F.col("to").isNull(), "missing").otherwise("moved")
    lost = gone_to.select(where.alias("now"), "work_id", fate.alias("state"), F.when(where != F.col("path"), F.col("path")).alias("was")).withColumnRenamed("now", "path")
    pdfs = spare.filter(F.lower("path").endswith(".pdf")).select("path")
    loose = pdfs.join(followed.unionByName(alone).select(F.col("to").alias("path")), "path", "left_anti").select("path", text.alias("work_id"), F.lit("loose").alias("state"), text.alias("was"))

    back = vanished.join(renamed.select(F.col("owner").alias("was"), "dir"), "was", "left")
    verdicts = [
        kept.select("path", "work_id", F.lit("same").alias("state"), text.alias("was")),
        met.filter("path is not null").select("path", "work_id", F.when(F.col("was").isNull(), "second").otherwise("moved").alias("state"), "was"),
        back.select(F.coalesce("dir", "was").alias("path"), "work_id", F.when(F.col("dir").isNull(), "missing").otherwise("renamed").alias("state"), F.when(F.col("dir").isNotNull(), F.col("was")).alias("was")),
        named.filter("work_id is null").select("path", "work_id", F.lit("unknown").alias("state"), text.alias("was")),
    ]
    out = verdicts[0]
    for part in verdicts[1:]:
        out = out.unionByName(part)
    return out, placed.unionByName(lost).unionByName(loose)

"""Graph operators: neighbours, paths, the expansion frontier, orphans, communities."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A set of ids is broadcast up to this many rows, and joined by a shuffle beyond.
SMALL = 100_000
#: Works in bins of more links than this are ranked in parts before a shuffle.
CROWD = 100_000
#: Clustering plans its joins adaptively beyond this many links; below, where starting jobs is most of the time, each step is one job of tasks of so many links.
ADAPTIVE, LINKS_OF_A_TASK = 40_000_000, 200_000
#: Clustering broadcasts its state, five whole numbers for each node, up to this many nodes.
NODES = 1_500_000


def id_order(index_id: str = "index_id", work_id: str = "work_id") -> list[Column]:
    """Index ids as text, works without one last, then the work id."""
    return [F.col(index_id).isNull().asc(), F.col(index_id).asc(), F.col(work_id).asc()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quill-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """`df` as a written table in the shared folder: what follows starts from its files, on whichever executor, and knows their size; read by `spark` if given."""
    path = f"{shared_folder(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)


def in_pieces(spark: SparkSession, size: int = 16 << 20) -> SparkSession:
    """A session of its own whose tasks read and fetch at most `size` bytes, files and shuffles alike, so that what one sorts or hashes doesn't grow with the tables."""
    own = spark.newSession()
    for key in ("files.maxPartitionBytes", "adaptive.advisoryPartitionSizeInBytes"):
        own.conf.set(f"spark.sql.{key}", str(size))
    own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "200")  # the most that are written without sorting
    return own


def small(side: DataFrame) -> DataFrame:
    """`side` with a broadcast hint if it has at most `SMALL` rows."""
    return F.broadcast(side) if side.limit(SMALL + 1).count() <= SMALL else side


def neighbours(works: DataFrame, cites: DataFrame, which: DataFrame, forward: bool = True) -> DataFrame:
    """The works that each `which.work_id` cites (or that cite it): fetched ones first, newest first, then by id.

    Returns (origin, rank, the columns of works); an unknown id has no rows.
    """
    near, far = ("from_work", "to_work") if forward else ("to_work", "from_work")
    steps = cites.join(which.select(F.col("work_id").alias("origin")), F.col(near) == F.col("origin")).select("origin", F.col(far).alias("other"))
    found = steps.join(works, steps.other == works.work_id).drop("other")
    order = Window.partitionBy("origin").orderBy(F.col("hydrated").desc(), F.col("year").desc(), *id_order())
    return found.withColumn("rank", F.row_number().over(order))


def citing(works: DataFrame, links: DataFrame, first: int, crowd: int = CROWD) -> DataFrame:
    """The `first` most cited works that cite each work, and how many there are; `links` may repeat a pair, and work_id is the key of `works`.

    Works in bins of up to `crowd` links meet those that cite them in one shuffle, where repeats lie side by side.  Of the others only the
    first places of each task are shuffled, and what cites them is counted apart, so no task holds all works that cite a hub.
    """
    links = links.select("from_work", F.col("to_work").alias("origin"))
    bin_of = F.xxhash64("origin").bitwiseAND(0xFFFF)  # a bin has the links of all works that fall into it: a hub's is crowded, and so may be others
    bins = cut(links.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("bin"))
    some, same = not bins.isEmpty(), bin_of == F.col("bin")
    order, whole = [F.col("cited_by_count").desc(), F.col("work_id")], Window.partitionBy("origin")

    def found(links: DataFrame) -> DataFrame:
        return links.join(works.select("work_id", "cited_by_count").hint("shuffle_hash"), links.from_work == F.col("work_id")).select("origin", "work_id", "cited_by_count")

    rows = found(links.join(F.broadcast(bins), same, "left_anti") if some else links)
    ranked = whole.orderBy(*order)
    rows = rows.withColumns({"place": F.dense_rank().over(ranked), "again": F.lag("work_id").over(ranked).eqNullSafe(F.col("work_id")), "last": F.lead("work_id").over(ranked).isNull()})
    wanted = (F.col("place") <= first) & ~F.col("again")
    rows = rows.filter(wanted | F.col("last")).withColumn("total", F.max("place").over(whole).cast("long")).filter(wanted)  # the last place is the number of places
    out = rows.select("origin", "work_id", "place", "total")
    if not some:
        return out
    crowded = found(links.join(F.broadcast(bins), same, "left_semi").distinct())
    totals = crowded.groupBy(F.col("origin").alias("hub")).agg(F.count("*").alias("total"))
    places = crowded.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= first)
    return out.unionByName(places.join(totals, F.col("origin").eqNullSafe(F.col("hub"))).select("origin", "work_id", "place", "total"))


def frontier(works: DataFrame, cites: DataFrame, limit: int, max_depth: int, max_refs: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """What to fetch next: stubs within the depth that some citing work ranks among its first `max_refs` references.

    in_degree counts all citing works.  Ordered by in_degree, depth and index id; first `limit`.
    """
    ranked = cites.groupBy("to_work").agg(F.count("*").alias("in_degree"), F.min("ref_seq").alias("best"))
    if exclude is not None:
        works = works.join(exclude.select("work_id"), "work_id", "left_anti")
    return _ranked_frontier(works, ranked, limit, max_depth, max_refs)


def _ranked_frontier(works: DataFrame, ranked: DataFrame, limit: int, max_depth: int, max_refs: int) -> DataFrame:
    """`frontier` with the edges counted already: ranked is (to_work, in_degree, best)."""
    stubs = works.filter("not hydrated and not unresolved and index_id is not null").filter(F.col("depth") <= max_depth).select("work_id", "index_id", "depth")
    found = stubs.join(ranked, stubs.work_id == ranked.to_work).select("work_id", "index_id", "depth", "in_degree", "best")
    if max_refs > 0:
        found = found.filter(F.col("best") <= max_refs)
    return found.drop("best").orderBy(F.col("in_degree").desc(), "depth", "index_id").limit(limit)


def beyond(works: DataFrame, cites: DataFrame, max_depth: int) -> DataFrame:
    """How many stubs could be fetched if the depth were larger."""
    cited = cites.select(F.col("to_work").alias("work_id")).distinct()
    return works.filter("not hydrated and not unresolved and index_id is not null").filter(F.col("depth") > max_depth).join(cited, "work_id", "left_semi").agg(F.count("*").alias("n"))


def directed(cites: DataFrame, direction: str) -> DataFrame:
    """(a, b, cites): steps of a traversal; `cites` says that a cites b.  A mutual citation counts as citing."""
    out = cites.select(F.col("from_work").alias("a"), F.col("to_work").alias("b"), F.lit(True).alias("cites"))
    into = cites.select(F.col("to_work").alias("a"), F.col("from_work").alias("b"), F.lit(False).alias("cites"))
    if direction == "backward":
        return out
    if direction == "forward":
        return into
    return out.unionByName(into).groupBy("a", "b").agg(F.max("cites").alias("cites"))


def levels(works: DataFrame, cites: DataFrame, start: DataFrame, max_hops: int, direction: str = "backward", target: str | None = None) -> DataFrame:
    """Breadth-first search: (work_id, hops, parent, cites), each work at its first level.

    The parent is the first of the frontier's works (in id order) with a step to it.  Each level is one
    join against the edges and an anti-join against each level before it, of which there are at most `max_hops`.
    """
    steps = cut(directed(cites, direction))
    keys = works.select("work_id", F.struct(F.col("index_id").isNull(), F.col("index_id"), F.col("work_id")).alias("key"))
    edge = cut(start.select("work_id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("boolean").alias("cites")).distinct())
    found = [edge]  # each level is written once; what has been seen is all of them
    for hop in range(1, max_hops + 1):
        from_ = edge.select(F.col("work_id").alias("a")).join(keys, F.col("a") == keys.work_id).select("a", "key")
        reached = steps.join(small(from_), "a")
        for level in found:
            reached = reached.join(level.select(F.col("work_id").alias("b")), "b", "left_anti")  # a written table: Spark knows its size
        edge = cut(reached.groupBy("b").agg(F.min_by(F.struct("a", "cites"), "key").alias("p")).select(F.col("b").alias("work_id"), F.lit(hop).alias("hops"), F.col("p.a").alias("parent"), F.col("p.cites").alias("cites")))
        if edge.isEmpty():
            break
        found.append(edge)
        if target is not None and not edge.filter(F.col("work_id") == target).isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def shortest_path(works: DataFrame, cites: DataFrame, source: str, target: str, max_hops: int = 6, direction: str = "backward") -> list[tuple[str, bool | None]] | None:
    """[(work, whether its predecessor cites it)] from source to target; None if there is none.  At most `max_hops` rows are fetched."""
    spark = works.sparkSession
    known = {r[0] for r in works.filter(F.col("work_id").isin(source, target)).select("work_id").collect()}
    if {source, target} - known:
        return None
    if source == target:
        return [(source, None)]
    seen = levels(works, cites, spark.createDataFrame([(source,)], "work_id string"), max_hops, direction, target)
    path, at = [], target
    while True:
        row = seen.filter(F.col("work_id") == at).first()
        if row is None:
            return None
        path.append((at, row["cites"]))
        if row["parent"] is None:
            return path[::-1]
        at = row["parent"]


def lineage(works: DataFrame, cites: DataFrame, a: str, b: str, max_hops: int = 6, either: bool = False) -> list[tuple[str, bool | None]] | None:
    """The line of descent: a back to b, else b back to a turned round; with `either` any direction at each step."""
    if either:
        return shortest_path(works, cites, a, b, max_hops, "either")
    if (path := shortest_path(works, cites, a, b, max_hops)) is not None:
        return path
    if (path := shortest_path(works, cites, b, a, max_hops)) is None:
        return None
    ids, flags = [x for x, _ in path][::-1], [f for _, f in path][:0:-1]
    return list(zip(ids, [None, *[not f for f in flags]], strict=True))


def orphans(works: DataFrame, cites: DataFrame, deleted: DataFrame, *keep: DataFrame) -> DataFrame:
    """Stubs that only deleted works cite: not seeds, citing nothing, and in none of the `keep` tables (work_id)."""
    gone, cites = cut(deleted.select("work_id").distinct()), cut(cites.select("from_work", "to_work"))
    cited = cites.join(gone, cites.from_work == gone.work_id, "left_semi").select(F.col("to_work").alias("work_id")).distinct()
    found = works.filter("not hydrated and not is_seed").join(cited, "work_id", "left_semi").join(gone, "work_id", "left_anti")
    others = cites.join(gone, cites.from_work == gone.work_id, "left_anti").select(F.col("to_work").alias("work_id"))
    for table in (others, cites.select(F.col("from_work").alias("work_id")), *(t.select("work_id") for t in keep)):
        found = found.join(table, "work_id", "left_anti")
    return found.select("work_id")


def surroundings(works: DataFrame, cites: DataFrame) -> DataFrame:
    """For each work: references, those that are resolvable stubs, those without a title, and its citing works here."""
    ends = cites.join(works.select(F.col("work_id").alias("to_work"), "hydrated", "unresolved", "title"), "to_work")
    stub = ~F.col("hydrated")
    out = ends.groupBy(F.col("from_work").alias("work_id")).agg(F.count("*").alias("cites"), F.count_if(stub & ~F.col("unresolved")).alias("unfetched"), F.count_if(stub & F.col("title").isNull()).alias("untitled"))
    into = cites.groupBy(F.col("to_work").alias("work_id")).agg(F.count("*").alias("cited_here"))
    zero = {"cites": 0, "unfetched": 0, "untitled": 0, "cited_here": 0}
    return works.select("work_id", "cited_by_count").join(out, "work_id", "left").join(into, "work_id", "left").fillna(zero)


def ego_map(works: DataFrame, cites: DataFrame, centre: str, first: int = 12, second_of: int = 6, second: int = 3) -> list[tuple[str, str, int]]:
    """(parent, work, step): up to `first` neighbours, and up to `second` unseen ones of each of `second_of` fetched ones."""
    spark = works.sparkSession

    def around(ids: list[str]) -> dict[str, list]:
        which = spark.createDataFrame([(i,) for i in ids], "work_id string")
        both = neighbours(works, cites, which).unionByName(neighbours(works, cites, which, False)).dropDuplicates(["origin", "work_id"])
        order = Window.partitionBy("origin").orderBy(F.col("hydrated").desc(), F.col("year").desc(), *id_order())
        rows = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first + second * (second_of + first)).orderBy("origin", "rank").collect()
        out: dict[str, list] = {i: [] for i in ids}
        for r in rows:
            out[r["origin"]].append(r)
        return out

    near = around([centre])[centre][:first]
    seen = {centre, *(r["work_id"] for r in near)}
    found = [(centre, r["work_id"], 1) for r in near]
    parents = [r["work_id"] for r in near if r["hydrated"]][:second_of]
    for parent, rows in (around(parents) if parents else {}).items():
        fresh = [r["work_id"] for r in rows if r["work_id"] not in seen][:second]
        seen.update(fresh)
        found += [(parent, x, 2) for x in fresh]
    return found


def clustered(pairs: DataFrame, resolution: float = 1.0, colours: int = 2, least: float = 0.001, mapped: bool = True) -> DataFrame:
    """(work_id, cluster): modularity clusters of the links (a, b), by local moves, refinement and aggregation as joins; nothing is collected.

    A level has three steps.  Local moves: in a turn the nodes of one colour, a hash of node and sweep, move to the neighbouring cluster of the largest
    gain (ties: the smallest name); a lone node joins another lone one only towards the smaller name, so that the two don't change places.  A sweep
    is a turn of each colour; one that doesn't raise the modularity is undone, and sweeps end with it or with one that raises it by less than `least`.
    Refinement: in each cluster the nodes start alone again and join, in one such sweep, parts of their own cluster only, so a cluster
    whose parts hang together through others falls into them.  Aggregation: parts become nodes, with the clusters that they are in as the
    start of the next level.  Levels end when no node has moved.  Gains are made of whole numbers and rounded, so the result is
    the same on every run and partitioning.  Moves are made over files that tasks map (`moves.Level`), or as joins, with the same results, where
    the shared folder can't be mapped or `mapped` is false.
    """
    from quillgraph.operators.moves import Level, folder_of
    from quillgraph.sources.exports import numbered

    given, spark = pairs.sparkSession, pairs.sparkSession.newSession()  # a session has settings of its own
    ends = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    names = cut(numbered(ends, [F.col("name")], "x").select(F.col("x").cast("long"), "name"))  # numbers in the order of the names
    ids = pairs.select("a", "b").join(names.toDF("xa", "a"), "a").join(names.toDF("xb", "b"), "b")
    both = F.explode(F.array(F.struct(F.col("xa").alias("a"), F.col("xb").alias("b")), F.struct(F.col("xb").alias("a"), F.col("xa").alias("b")))).alias("l")
    links, names = cut(ids.select(both).select("l.*", F.lit(1).cast("long").alias("w")), spark), cut(names, spark)
    total = links.agg(F.sum("w").alias("w")).first()["w"] or 0
    digits = int(62 / math.log2(max(colours, 2)))

    def planned(links: DataFrame) -> None:
        """Settings for steps over `links`: an adaptive plan is a job for each shuffle, a fixed one a single job."""
        n = links.count()
        spark.conf.set("spark.sql.adaptive.enabled", str(n > ADAPTIVE).lower())
        spark.conf.set("spark.sql.shuffle.partitions", str(1 + n // LINKS_OF_A_TASK))

    def tinted(state: DataFrame, sweep: int) -> DataFrame:
        """`state` with its nodes' colours in the next `digits` sweeps as the digits of one number, the first one lowest."""
        colour = lambda i: F.pmod(F.xxhash64("name", i), F.lit(colours))
        tint = F.aggregate(F.sequence(F.lit(sweep + digits - 1), F.lit(sweep)), F.lit(0).cast("long"), lambda s, i: s * colours + colour(i))
        return cut(state.join(names, "x").withColumn("tint", tint).drop("name"))

    planned(links)
    nodes = cut(links.groupBy(F.col("a").alias("x")).agg(F.sum("w").alias("k")))
    state = nodes.withColumn("c", F.col("x"))
    count = state.count()
    member = names.select(F.col("name").alias("work_id"), F.col("x").alias("part"))
    near_all = lambda side: F.broadcast(side) if count <= NODES else side

    def quality(state: DataFrame) -> float:
        ends = links.join(near_all(state.select(F.col("x").alias("a"), F.col("c").alias("ca"))), "a").join(near_all(state.select(F.col("x").alias("b"), F.col("c").alias("cb"))), "b")
        inside = ends.filter("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.lit(None).cast("decimal(38,6)").alias("squares"))
        squares = state.groupBy("c").agg(F.sum("k").cast("double").alias("k")).agg(F.lit(None).cast("long").alias("w"), F.sum(F.round(F.col("k") * F.col("k") / total, 6).cast("decimal(38,6)")).alias("squares"))
        row = inside.unionByName(squares).agg(F.max("w").alias("w"), F.max("squares").alias("squares")).first()
        return round(row["w"] / total - resolution * float(row["squares"] or 0) / total, 9) if total else 0.0

    def turn(state: DataFrame, sweep: int, colour: int, inside: bool) -> tuple[DataFrame, int]:
        """Moves of one colour; with `inside` only of nodes alone in their part, to parts of the same `outer` cluster.

        The state is written with the weight and size of each node's cluster, looked up for both ends of the links; a node's
        own cluster is an option without a link, so that the best options of all nodes are their new places and no join brings them back.
        """
        held = state.groupBy("c").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
        placed = cut(state.join(near_all(held), "c"))
        mine = F.expr(f"tint div {colours ** (sweep % digits)}L % {colours} = {colour}")
        if inside:
            mine = mine & (F.col("size") == 1)
        far = placed.select(F.col("x").alias("b"), "c", "total", "size", *([F.col("outer").alias("far")] if inside else []))
        own = placed.filter(mine).select(F.col("x").alias("a"), "k", F.col("c").alias("own"), F.col("total").alias("own_total"), F.col("size").alias("own_size"), "tint", *(["outer"] if inside else []))
        near = links.filter("a <> b").join(near_all(own), "a").join(near_all(far), "b")
        keys = [*own.columns, "c", "total", "size"]
        stay = own.withColumns({"c": F.col("own"), "total": F.col("own_total"), "size": F.col("own_size"), "w": F.lit(0).cast("long")})
        options = (near.filter("outer = far") if inside else near).select(*keys, "w").unionByName(stay).groupBy(*keys).agg(F.sum("w").alias("w"))
        options = options.filter(~((F.col("own_size") == 1) & (F.col("size") == 1) & (F.col("c") > F.col("own"))))
        without = F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)
        gain = F.round(F.col("w") - resolution * without.cast("double") * F.col("k") / total, 6)
        best = options.groupBy("a", "k", "own", "tint", *(["outer"] if inside else [])).agg(F.min(F.struct((-gain).alias("minus"), (F.col("c") != F.col("own")).alias("other"), "c")).alias("best"))
        seen, columns = Observation(), state.columns
        moved = best.withColumnsRenamed({"a": "x"}).withColumn("c", F.col("best.c")).observe(seen, F.count_if(F.col("c") != F.col("own")).alias("moved"))
        new = cut(moved.select(*columns).unionByName(placed.filter(~mine).select(*columns)))
        return new, seen.get["moved"]

    def settled(state: DataFrame) -> tuple[DataFrame, bool]:
        sweep, moved, best = 0, False, quality(state)
        while True:
            before, count = state, 0
            if sweep % digits == 0:
                state = tinted(state.drop("tint"), sweep)
            for colour in range(colours):
                state, some = turn(state, sweep, colour, False)
                count += some
            sweep += 1
            if count:
                now = quality(state)
                if now <= best:
                    return before, moved
                before_it, best = best, now
            moved = moved or count > 0
            if not count or now - before_it < least:
                return state, moved

    folder = folder_of(shared_folder(spark)) if mapped else None
    while True:
        n = count = state.count()
        if folder and n:
            level = Level(spark, folder, links, links.count(), state, names, total, resolution, colours)
            if not level.settled(least):
                break
            level.refined()
            to = cut(level.table("c", "outer", "k").withColumnRenamed("c", "part"))
            level.keep()
        else:
            state, moved = settled(state)
            if not moved:
                break
            parts = tinted(state.drop("tint").withColumns({"outer": F.col("c"), "c": F.col("x")}), 0)
            for colour in range(colours):
                parts = turn(parts, 0, colour, True)[0]
            to = cut(parts.select("x", F.col("c").alias("part"), "outer", "k"))
        member = cut(member.join(to.select(F.col("x").alias("part"), F.col("part").alias("new")), "part").select("work_id", F.col("new").alias("part")))
        name = lambda side: to.select(F.col("x").alias(side), F.col("part").alias(f"p{side}"))
        links = cut(links.join(name("a"), "a").join(name("b"), "b").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("w").alias("w")))
        planned(links)
        state = cut(to.groupBy("part", "outer").agg(F.sum("k").alias("k")).select(F.col("part").alias("x"), "k", F.col("outer").alias("c")))
        if state.count() == n and state.select("c").distinct().count() == n:
            break
        # The cluster of a part is named by the smallest of its parts, as clusters must be names of nodes.
        heads = state.groupBy("c").agg(F.min("x").alias("least"))
        state = cut(state.join(heads, "c").select("x", "k", F.col("least").alias("c")))
    final = state.select(F.col("x").alias("part"), F.col("c").alias("x")).join(names.withColumnRenamed("name", "cluster"), "x")
    return cut(member.join(final, "part").select("work_id", "cluster"), given)


def groups(cites: DataFrame, resolution: float = 1.0, least: int = 5) -> DataFrame:
    """(anchor, work_id, cited_within, place, size, fringe): communities of the works with two or more neighbours.

    Works with one neighbour follow it as fringe; clusters of fewer than `least` are left out.
    """
    pairs = cut(cites.filter("from_work <> to_work").select(F.least("from_work", "to_work").alias("a"), F.greatest("from_work", "to_work").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("work_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("work_id"), F.col("a").alias("other")))
    degree = cut(ends.groupBy("work_id").agg(F.count("*").alias("n"), F.min("other").alias("only")))
    linked = degree.filter("n >= 2").select("work_id")
    core = pairs.join(linked.withColumnRenamed("work_id", "a"), "a", "left_semi").join(linked.withColumnRenamed("work_id", "b"), "b", "left_semi")
    found = clustered(core, resolution)
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")
    placed = cut(found.join(sizes, "cluster").select("work_id", "cluster"))
    to = placed.withColumnsRenamed({"work_id": "to_work", "cluster": "to_cluster"})
    from_ = placed.withColumnsRenamed({"work_id": "from_work", "cluster": "from_cluster"})
    within = cites.filter("from_work <> to_work").join(to, "to_work").join(from_, "from_work").filter("to_cluster = from_cluster").groupBy(F.col("to_work").alias("work_id")).agg(F.count("*").alias("cited_within"))
    order = Window.partitionBy("cluster").orderBy(F.col("cited_within").desc(), "work_id")
    ranked = placed.join(within, "work_id", "left").fillna({"cited_within": 0}).withColumn("place", F.row_number().over(order))
    heads = ranked.filter("place = 1").select("cluster", F.col("work_id").alias("anchor")).join(placed.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")
    members = ranked.join(heads, "cluster").select("anchor", "work_id", "cited_within", "place", "size", F.lit(False).alias("fringe"))
    single = degree.filter("n = 1").join(placed.withColumnRenamed("work_id", "only"), "only").join(heads, "cluster")
    return members.unionByName(single.select("anchor", "work_id", F.lit(0).cast("long").alias("cited_within"), F.lit(None).cast("int").alias("place"), "size", F.lit(True).alias("fringe")))


def expand(works: DataFrame, cites: DataFrame, index: DataFrame, references: DataFrame, budget: int, max_depth: int = 3, max_refs: int = 100, batch: int = 100, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Best-first expansion under a budget of tried ids: frontier, fetch from `index`, commit, until a stop reason.

    `index` has the columns of works, `references` is (from_work, to_work, ref_seq) of the whole index, `aliases` (alias, work_id)
    the ids that it answers with another work: those fold into it, with the lower depth.  A batch writes what it changes, rows
    of works and new edges, and not the tables; edges are counted once, and after that a batch's own edges change the counts and best
    ranks of the works that they cite.  Returns the new works, the new cites, and {"tried", "fetched", "merged", "missing", "stop"}.
    """
    counts = {"tried": 0, "fetched": 0, "merged": 0, "missing": 0, "stop": "budget-exhausted"}
    rank = lambda t: t.groupBy("to_work").agg(F.count("*").alias("in_degree"), F.min("ref_seq").alias("best"))
    base, ranked = cut(works), cut(rank(cites))
    changed, grown, newer = base.limit(0), cites.limit(0), ranked.limit(0)
    folded = works.sparkSession.createDataFrame([], "alias string, work_id string")
    while counts["tried"] < budget:
        now = base.join(small(changed.select("work_id")), "work_id", "left_anti").select(*base.columns).unionByName(changed)
        cited = ranked.join(small(newer.select("to_work")), "to_work", "left_anti").unionByName(newer)
        wanted = cut(_ranked_frontier(now.join(small(folded.select(F.col("alias").alias("work_id"))), "work_id", "left_anti"), cited, min(batch, budget - counts["tried"]), max_depth, max_refs))
        n = wanted.count()
        if not n:
            counts["stop"] = "max-depth" if beyond(now, cites.unionByName(grown), max_depth).first()["n"] else "frontier-empty"
            break
        ids = wanted.select("work_id", "depth")
        if aliases is not None:
            moved = cut(ids.join(aliases.select(F.col("alias").alias("work_id"), F.col("work_id").alias("target")), "work_id"))
            folded = cut(folded.unionByName(moved.select(F.col("work_id").alias("alias"), F.col("target").alias("work_id"))))
            ids = ids.join(moved.select("work_id"), "work_id", "left_anti").unionByName(moved.select(F.col("target").alias("work_id"), "depth")).groupBy("work_id").agg(F.min("depth").alias("depth"))
            counts["merged"] += moved.count()
        known = now.join(small(ids.select("work_id", F.col("depth").alias("new_depth"))), "work_id")
        found = ids.join(index.drop("depth", "hydrated", "unresolved", "is_seed"), "work_id").join(known.select("work_id", F.col("is_seed").alias("seed"), F.col("depth").alias("old_depth")), "work_id", "left")
        found = cut(found.withColumns({"depth": F.least("depth", "old_depth"), "hydrated": F.lit(True), "unresolved": F.lit(False), "is_seed": F.coalesce("seed", F.lit(False))}).select(*works.columns))
        missing = known.join(found.select("work_id"), "work_id", "left_anti").withColumn("unresolved", F.lit(True)).select(*works.columns)
        new = references.join(small(found.select(F.col("work_id").alias("from_work"), "depth")), "from_work").filter("from_work <> to_work")
        held = cites.unionByName(grown).select("from_work", "to_work").join(small(found.select(F.col("work_id").alias("from_work"))), "from_work", "left_semi")
        fresh = cut(new.select(*cites.columns).join(held, ["from_work", "to_work"], "left_anti"))
        stubs = new.groupBy("to_work").agg((F.min("depth") + 1).cast("int").alias("new_depth")).withColumnRenamed("to_work", "work_id")
        stubs = cut(stubs.join(found.select("work_id"), "work_id", "left_anti").join(missing.select("work_id"), "work_id", "left_anti"))
        lower = now.join(small(stubs), "work_id").filter(F.col("new_depth") < F.col("depth")).withColumn("depth", F.col("new_depth")).select(*works.columns)
        blank = {c: F.lit(None).cast(works.schema[c].dataType) for c in works.columns}
        blank |= {"work_id": F.col("work_id"), "index_id": F.col("work_id"), "hydrated": F.lit(False), "unresolved": F.lit(False), "is_seed": F.lit(False), "depth": F.col("new_depth"), "cited_by_count": F.lit(0).cast(works.schema["cited_by_count"].dataType)}
        unseen = stubs.join(now.select("work_id"), "work_id", "left_anti").select(*[blank[c].alias(c) for c in works.columns])
        step = cut(found.unionByName(missing).unionByName(lower).unionByName(unseen))
        grown = cut(grown.unionByName(fresh))
        more = cut(rank(fresh))
        met = cited.join(small(more.select("to_work")), "to_work", "left_semi").unionByName(more)
        met = met.groupBy("to_work").agg(F.sum("in_degree").alias("in_degree"), F.min("best").alias("best"))
        newer = cut(newer.join(small(more.select("to_work")), "to_work", "left_anti").unionByName(met))
        changed = cut(changed.join(small(step.select("work_id")), "work_id", "left_anti").select(*works.columns).unionByName(step))
        counts["tried"] += n
        counts["missing"] += (gone := missing.count())
        counts["fetched"] += n - gone
    works = base.join(small(changed.select("work_id")), "work_id", "left_anti").select(*base.columns).unionByName(changed)
    cites = cites.unionByName(grown)
    if counts["merged"]:
        from quillgraph.operators.merge import fold

        works, cites, _ = fold(works, cites, folded)
    return works, cites, counts

"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text.  The ledger
holds one row for each (blob, rule version) that has been scanned, with the spans
found; a run scans the pairs that are not in it, each once, however many paths or
versions share the blob, and joins the findings back to all versions.  A rule's version is
the hash of its pattern, so a changed rule is scanned again and the others are not.

`update` keeps the ledger as a table: it scans what the table doesn't know, appends that, and joins
the findings back.  `scan` does the same with a ledger that the caller keeps.

Texts are not shuffled where it can be helped: the blobs of several rows and those that
the ledger knows are broadcast beside the texts if they number at most `BROADCAST_ROWS`
(one row of each blob is scanned), or else the blobs to be scanned are, or else the two are joined by
a shuffle on (blob, id).  Findings are few beside versions: they are broadcast to the versions if
they hold at most `BROADCAST_SPANS` spans; beyond, both sides of the join are written tables, so a blob
with a large share of the versions is split by the adaptive skew join.

Spans come from the JVM's regular expressions: what `split` leaves between the
matches of `regexp_extract_all` gives their positions (code points, end exclusive).  Positions are
sums over all matches before; these are taken in chunks, so a text of very many matches
costs little more than its length, and the same goes for the pieces that a redacted text keeps.

Defined results: a null text is the empty text (`redact` leaves it null); a null id is kept; repeated rows
each return a row, redacted each; equal starts are ordered by the rule's place in the list; an
empty table returns no rows; other columns are not read, and `redact` carries them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import exists, text_of, written

BROADCAST_ROWS = 200_000
BROADCAST_SPANS = 1_000_000
#: Elements of an array that are walked at a time, and code points of a block of a text.
CHUNK, BLOCK = 512, 1024


@dataclass(frozen=True)
class Rule:
    """A match counts if group `group` has at least `least` characters; `base` rules form the base digest."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: Between the lines of a key: white space, or the escapes of line ends in a quoted one; and the last line of a key with its end mark.
_GAP = r"(?:[\x09-\x0D\x20]|\\[nr])+"
_LAST = rf"(?:{_GAP}[A-Za-z0-9+/=]{{1,23}})?(?:{_GAP})?-----END [A-Z ]{{0,20}}PRIVATE KEY-----"
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    # Lines of base64 with what may stand before them, up to the first end mark; prose is never part of a key.  Possessive: a loop, not a recursion for each line.
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----(?:{_GAP}(?:Proc-Type:\x20?4,ENCRYPTED|DEK-Info:\x20?[A-Z0-9-]{{1,20}},[0-9A-Fa-f]{{1,64}}))*(?:(?:{_GAP}[A-Za-z0-9+/=]{{24,}})++(?:{_LAST})?|{_LAST})"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\x09-\x0D\x20/:@\"']+:[^\x09-\x0D\x20/@\"']+@"),
    Rule("prefixed", r"(?:gh[opsu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
)


SPANS = "array<struct<start:bigint,place:int,end:bigint>>"


def before(values: Column, op) -> Column:
    """What `op` (a sum or a maximum of numbers from 0 on) makes of all elements before each one; chunk by chunk, as growing an array copies it."""
    zero = F.lit(0).cast("bigint")

    def inside(chunk: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(chunk, start, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / CHUNK).cast("int"), F.lit(0))), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, op))
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), inside(totals).alias("base")), lambda z: F.transform(inside(z["c"]), lambda v: op(z["base"], v))))


def spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, end>> of one rule in a text."""
    pattern = F.lit(rule.pattern)
    found = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("a"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("b"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("c")),
        lambda x: F.struct(F.length(x["a"]).cast("bigint").alias("gap"), F.coalesce(F.length(x["b"]), F.lit(0)).cast("bigint").alias("len"), F.length(x["c"]).alias("own")),
    )

    def placed(found: Column) -> Column:
        ends = before(F.transform(found, lambda x: x["gap"] + x["len"]), lambda a, b: a + b)
        zipped = F.filter(F.arrays_zip(found.alias("x"), ends.alias("at")), lambda z: z["x"]["own"] >= rule.least)
        return F.transform(zipped, lambda z: F.struct((z["at"] + z["x"]["gap"]).alias("start"), F.lit(place).alias("place"), (z["at"] + z["x"]["gap"] + z["x"]["len"]).alias("end")))

    return F.when(F.rlike(text, pattern), F.get(F.transform(F.array(found), placed), F.lit(0))).otherwise(F.array().cast(SPANS))


def ledger_schema() -> str:
    return "blob binary, kind string, version string, spans array<struct<start:bigint,end:bigint>>"


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger doesn't know.

    Returns (findings, new): findings has (id, blob, spans) for each row of
    `versions`, spans being array<struct<start, place, end>> by start, then place (the rule's
    position in `rules`); new has the rows to append to the ledger.
    """
    source = versions.select(F.col(id_col).cast("long").alias("id"), text_of(versions, text_col).alias("t")).withColumn("blob", F.unhex(F.sha2("t", 256)))
    keyed = written(source.select("id", "blob"), "blobs")
    blobs = keyed.groupBy("blob").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    every = F.array(*[F.lit(f"{r.kind} {r.version}") for r in rules])
    if ledger is None:
        known = None
        pending = blobs.withColumn("due", every)
    else:
        known = ledger.join(F.broadcast(versions.sparkSession.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version string, place int")), ["kind", "version"])
        seen = known.groupBy("blob").agg(F.collect_set(F.concat_ws(" ", "kind", "version")).alias("seen"))
        pending = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen")
    pending = written(pending, "pending")
    # Most blobs have one row, for which every rule is due; only the others need to be known beside the texts.
    other = pending.filter((F.col("n") > 1) | (F.size("due") < len(rules))).select(F.col("blob").alias("b"), "first", "due")
    if other.count() <= BROADCAST_ROWS:
        beside = source.join(F.broadcast(other), F.col("blob") == F.col("b"), "left")
        todo = beside.filter(F.col("b").isNull() | (F.col("id").eqNullSafe(F.col("first")) & (F.size("due") > 0))).withColumn("due", F.coalesce("due", every))
    else:
        keys = pending.filter(F.size("due") > 0).select(F.col("blob").alias("b"), "first", "due")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        todo = source.join(keys, (F.col("blob") == F.col("b")) & F.col("id").eqNullSafe(F.col("first")))
    found = todo.select("blob", F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("place"), F.when(F.array_contains("due", f"{r.kind} {r.version}"), spans(F.col("t"), r, i)).alias("spans")) for i, r in enumerate(rules)]).alias("x"))
    scanned = written(found, "scanned").dropDuplicates(["blob"])
    new = scanned.select("blob", F.explode("x").alias("x")).filter("x.spans is not null").select("blob", "x.kind", "x.version", F.transform("x.spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    hits = scanned.select("blob", F.flatten(F.transform("x", lambda s: F.coalesce(s["spans"], F.array().cast(SPANS)))).alias("spans")).filter(F.size("spans") > 0)
    if known is not None:
        old = known.filter(F.size("spans") > 0).select("blob", F.expr("transform(spans, s -> named_struct('start', s.start, 'place', place, 'end', s.end))").alias("spans"))
        hits = hits.unionByName(old).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return _joined(keyed, hits, "blob").select("id", "blob", F.array_sort(F.coalesce("spans", F.array().cast(SPANS))).alias("spans")), new


def _joined(rows: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """`rows` with the spans (second column) of `hits`, a row for each blob that holds any."""
    hits = written(hits, "hits")
    n = hits.agg(F.coalesce(F.sum(F.size(hits.columns[1])), F.lit(0)).alias("n")).first()["n"]
    return rows.join(F.broadcast(hits) if n <= BROADCAST_SPANS else hits, key, "left")


def update(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`scan` with the ledger table at `path` (made if it isn't there): the findings of all versions; what was scanned is appended."""
    spark = versions.sparkSession
    ledger = spark.read.schema(ledger_schema()).parquet(path) if exists(spark, path) else None
    findings, new = scan(versions, ledger, rules, id_col, text_col)
    new.write.mode("append").parquet(path)
    return findings


def spelt(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base rules, the hash of their spans, and all spans as text."""
    base = [i for i, r in enumerate(rules) if r.base]

    def of(place: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["place"] == place)).cast("long")

    counted = {f"n_{rules[i].kind}": of(i) for i in base}
    mine = F.filter("spans", lambda s: reduce(lambda a, b: a | b, [s["place"] == i for i in base]))
    return findings.select(F.col("id").alias("doc_id"), *[c.alias(n) for n, c in counted.items()], F.sha2(spelt(mine, rules), 256).alias("base_sha256"), spelt(F.col("spans"), rules).alias("spans"))


MARK = "[SECRET]"


def redacted(text: Column, found: Column, mark: str = MARK) -> Column:
    """The text with each run of overlapping spans (sorted by start) replaced by `mark`."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))  # a place in a block is found without counting from the text's start

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        one = F.transform(F.sequence(F.floor(a / BLOCK), F.floor((b - 1) / BLOCK)), lambda j: F.substr(F.get(blocks, j.cast("int")), (F.greatest(a - j * BLOCK, F.lit(0)) + 1).cast("int"), (F.least(b - j * BLOCK, F.lit(BLOCK)) - F.greatest(a - j * BLOCK, F.lit(0))).cast("int")))
        return F.when(b > a, F.array_join(one, "")).otherwise(F.lit(""))

    def walked(blocks: Column) -> Column:
        ends = before(F.transform(found, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        heads = F.filter(F.arrays_zip(F.transform(found, lambda x: x["start"]).alias("start"), ends.alias("from")), lambda z: z["start"] >= z["from"])
        last = F.array_max(F.transform(found, lambda x: x["end"]))
        return F.concat(F.array_join(F.transform(heads, lambda z: F.concat(piece(blocks, z["from"], z["start"]), F.lit(mark))), ""), piece(blocks, last, F.length(text).cast("bigint")))

    return F.when(F.size(found) > 0, F.get(F.transform(F.array(blocks), walked), F.lit(0))).otherwise(text)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with the secrets of all rules replaced; `chars_col` (if there) follows the text of changed rows."""
    keyed = scan(docs, None, rules, id_col, text_col)[0].filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    joined = _joined(docs.withColumn("quill_blob", F.unhex(F.sha2(text_of(docs, text_col), 256))), keyed.withColumnsRenamed({"blob": "quill_blob", "spans": "quill_spans"}), "quill_blob")
    found = F.coalesce(F.col("quill_spans"), F.array().cast(SPANS))
    done = joined.withColumn("quill_text", redacted(F.col(text_col), found))
    changed = {text_col: F.col("quill_text")}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(F.size(found) > 0, F.length("quill_text").cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return done.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])

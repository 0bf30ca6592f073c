"""Weighted rendezvous sharding, in DataFrame operations only.

A record goes to the shard with the largest score -weight / ln(u), u being a uniform
hash of (record key, shard).  Scores of different shards are independent, so one more
shard takes records only into itself, about its share of the weights, and a changed
weight moves only what that shard wins or loses.

Slots number the records of a shard without gaps.  A shard may hold any number of
rows, so a slot is counted in two steps: rows are numbered within (shard, bucket),
where the bucket is a hash of the key and the text's checksum, and the bucket's first slot is the
sum of the smaller buckets' counts, which is a table of shards x `BUCKETS` rows whatever the input.
Equal rows are added up to one row with their number before anything is sorted, and dealt out
again at the end, those of a number beyond `BLOCK` by many tasks.  The texts are read once; what
is written to the shared folder and shuffled are ids, sizes and checksums.

Defined results: the key decides alone, so rows with equal keys share a shard, null keys
among them; repeated rows get slots of their own; a null text has size 1 (no bytes, plus
one) and the checksum of no bytes; an empty table returns no rows; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import written

#: Buckets are three hexadecimal digits of a hash.
BUCKETS = 16**3
#: Equal rows that one task deals out.
BLOCK = 100_000


def uniform(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) from 52 bits of the MD5 of "key:shard"."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a record; on equal scores the smaller one (weights of zero never win)."""
    scored = [F.struct((F.lit(float(w)) / -F.log(uniform(key, s))).alias("score"), F.lit(-s).alias("minus")) for s, w in enumerate(weights) if w > 0]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["minus"]).cast("int")


def assign(records: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard): `grown` are the weights after one more shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = records.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    placed = named.withColumn("shard", rendezvous(key, weights)).withColumn("grown_shard", rendezvous(key, grown) if grown else F.lit(None).cast("int"))
    marked = F.concat(key, F.lit(":"), F.col("text_crc32").cast("string"), F.lit(":slot"))
    placed = placed.withColumn("bucket", F.conv(F.substring(F.md5(marked.cast("binary")), 1, 3), 16, 10).cast("int"))
    equal = written(placed.groupBy("shard", "bucket", "id", "text_crc32", "size", "grown_shard").agg(F.count("*").alias("n")), "placed")
    counted = equal.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = equal.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), ["shard", "bucket"])
    numbered = numbered.select("id", "size", "text_crc32", "shard", "grown_shard", (F.col("start") + F.col("rank")).alias("first"), "n")
    many = F.col("n") > BLOCK
    blocks = numbered.filter(many).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    blocks = blocks.select("id", "size", "text_crc32", "shard", "grown_shard", (F.col("first") + F.col("at")).alias("first"), F.least(F.lit(BLOCK), F.col("n") - F.col("at")).alias("n"))
    dealt = numbered.filter(~many).unionByName(blocks.repartition("shard", "first")) if equal.filter(many).limit(1).count() else numbered
    return dealt.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1))).select("id", "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(records: DataFrame, weights: list[float], path: str, id_col: str = "doc_id") -> None:
    """Write whole records under `path`/shard=N, without a shuffle."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    records.withColumn("shard", rendezvous(key, weights)).write.partitionBy("shard").parquet(path)

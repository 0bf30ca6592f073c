"""Works that arrive as a stream: each micro-batch is committed like a fetched batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quillgraph.operators import merge


def commit(works: DataFrame, cites: DataFrame, batch: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of fetched works with `references`: the last row of each work counts."""
    latest = Window.partitionBy("work_id").orderBy(F.col("arrival").desc())
    one = batch.withColumn("k", F.row_number().over(latest)).filter("k = 1").drop("k")
    works = merge.upsert_works(works, one.drop("references"))
    return merge.record_references(works, cites, one.select("work_id", "references"), tombstones)


def ingest(stream: DataFrame, folder: str, tombstones: DataFrame) -> StreamingQuery:
    """Commit a stream of works into `folder`/works-N and cites-N, one version for each batch.

    A batch that is run again writes its own version again, from the version before it.
    """

    def step(batch: DataFrame, number: int) -> None:
        read = batch.sparkSession.read.parquet
        works, cites = commit(read(f"{folder}/works-{number}"), read(f"{folder}/cites-{number}"), batch, tombstones)
        works.write.mode("overwrite").parquet(f"{folder}/works-{number + 1}")
        cites.write.mode("overwrite").parquet(f"{folder}/cites-{number + 1}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

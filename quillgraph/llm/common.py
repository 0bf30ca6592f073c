"""Shared plumbing: written cuts of lineage, record ids, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; where that is unset, a folder set as the
    checkpoint folder counts, and in a local session (tests, a laptop) a temporary folder is set as one.  A
    cluster that names neither is an error: a machine's own folder would lose what other machines write.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quill-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


#: Where `written` notes its folders, if a `scratch` is open.
_scope: ContextVar[list[str] | None] = ContextVar("quill_scope", default=None)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what `written` has written in it; nothing made in it may be read later but what `stored` has written."""
    paths: list[str] = []
    before = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in paths:
            delete(spark, path)


def place_for(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quill/{name}-{uuid.uuid4().hex}"


def mapped_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder whose files driver and workers open themselves; the open `scratch` will delete it."""
    path = note(place_for(spark, name))
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise RuntimeError(f"workers can't open files of {path}: spark.checkpoint.dir must be a path of a mounted folder")
    return path


def note(path: str) -> str:
    """The open `scratch`, if there is one, will delete the path."""
    if (noted := _scope.get()) is not None:
        noted.append(path)
    return path


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write `df` as Parquet to `path` and read it back; no `scratch` deletes it."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    What follows starts from the files: a lost executor costs a read of them and
    never the work before them, and a result that is used twice is made once.
    """
    return stored(df, note(place_for(df.sparkSession, name)), **options)


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(df[text], F.lit(""))


def arrow_map(df: DataFrame, make, schema: str) -> DataFrame:
    """`df.mapInArrow(make)`; `make` gets the iterator of record batches of a partition."""
    return df.mapInArrow(make, schema)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def trim() -> None:
    """Give freed memory back to the machine: a worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `chars` bytes, so that long texts don't add up in memory."""
    for whole in batches:
        rows = whole.num_rows
        if rows == 0:
            continue
        step = max(1, int(rows * chars / max(whole.nbytes, 1)))
        for start in range(0, rows, step):
            yield whole.slice(start, step)
    trim()


#: A set of ids is broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`docs` without the rows whose `key` is in the one column of `gone` (non-null, distinct); null keys stay."""
    name = "quill_gone"
    gone = gone.toDF(name)
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs[key] == side[name], "left_anti")


def kept_rows(docs: DataFrame, verdict, chars: int = 1_000_000) -> DataFrame:
    """The rows for which `verdict(batch)` is true, all columns as they are; one pass, nothing shuffled.

    A batch holds about `chars` bytes.
    """
    import numpy as np

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in pieces([whole], chars):
                yield rows.filter(pa.array(np.asarray(verdict(rows), bool)))

    return docs.mapInArrow(make, docs.schema)

"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

T = TypeVar("T")
_LASTING: dict[Hashable, object] = {}
_SCRATCH: ContextVar[list[Callable[[], None]] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session has it.

    Only where it is unset and all of Spark runs in this process (tests, a laptop) a temporary
    folder is chosen; elsewhere executors would not see one.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = held.get() if held.isDefined() else None
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    held = _SCRATCH.get()
    if held is not None:
        held.append(lambda: deleted(spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written and values broadcast inside go at its end: nothing that is read later may rest
    on them."""
    held: list[Callable[[], None]] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for release in held:
            release()


def broadcast(spark: SparkSession, value: T) -> Broadcast[T]:
    """`value` sent to all executors, until the scratch around it ends."""
    sent = spark.sparkContext.broadcast(value)
    held = _SCRATCH.get()
    if held is not None:
        held.append(sent.destroy)
    return sent


def deleted(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(names: Iterable[str], *wanted: str) -> list[str]:
    """Column names made of those wanted that clash with none of `names`, in whatever case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lasting(key: Hashable, build: Callable[[], T]) -> T:
    """What `build` makes, held by this Python worker for the tasks to come. One thing is held at a
    time, so an operator's memos take the place of those that another one left behind."""
    if key not in _LASTING:
        _LASTING.clear()
        _LASTING[key] = build()
    return _LASTING[key]


def returned() -> None:
    """Gives memory that is free back to the machine; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut into slices of about `most` bytes of `column`, so that memory stays
    bounded however long the texts are (one row is never cut)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
        pa.default_memory_pool().release_unused()
    returned()

"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from fraylens import session

#: Texts that a task holds as Python strings at once.
ROWS = 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the executors' Python, once per application."""
    context = spark.sparkContext
    if getattr(context, "_fraylens_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    handle, path = tempfile.mkstemp(prefix="fraylens-", suffix=".zip")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(path)
    context._fraylens_shipped = True


#: Forgets what one kind of worker cache holds, by its name.
CACHES: dict[str, Callable[[], None]] = {}


def worker_cache(fn: Callable) -> Callable:
    """A cache of large objects that a worker process keeps between tasks, until tasks that don't use it need the memory."""
    cached = lru_cache(maxsize=1)(fn)
    CACHES[f"{fn.__module__}.{fn.__name__}"] = cached.cache_clear
    return cached


def release(but: str = "") -> None:
    """Empties this worker's caches except one and gives their memory back, with what the C library keeps of earlier tasks (glibc)."""
    for name, clear in CACHES.items():
        if name != but:
            clear()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def extended(docs: DataFrame, keep: tuple[str, ...], fields: str, make: Callable[[], Callable[[list[str]], dict]], cache: str = "") -> DataFrame:
    """``keep`` columns of ``docs`` unchanged (nulls and large ids included) and new ``fields`` computed from batches of whole texts.

    ``make()`` runs once per task and returns a function from texts (null: empty) to columns. A key ``None`` in its result lists the
    row that each output row belongs to, where they aren't one to one. ``cache``: the worker cache it uses; all others are emptied.
    """
    schema = StructType([docs.schema[c] for c in keep] + _parse_datatype_string(fields).fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(cache)
        compute = make()
        types = [to_arrow_type(f.dataType) for f in schema.fields[len(keep):]]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                new = compute(part.column(len(keep)).to_pylist())
                rows = new.pop(None, None)
                if rows is not None:
                    part = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *(pa.array(new[n], t) for n, t in zip(names[len(keep):], types))], names)

    return docs.select(*keep, text_of().alias("__whole_text")).mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it again: cuts lineage, survives lost executors. ``discard`` deletes it."""
    path = session.work_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fraylens_folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of ``stored`` frames that nothing reads any more: what was made from them must be stored itself."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._fraylens_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str | Column = "text") -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo ``divisor``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % divisor


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(path: str) -> str:
    """A path that tasks can open as a file: the shared folder must be mounted on every executor.

    Memory-mapped models live in files; a scheme other than ``file:`` can't be mapped and is refused.
    """
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped models need spark.checkpoint.dir on a mounted file system")
    return path


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows with the smallest hashes of ``key``: repeatable and the same for any partitioning."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, drawn by a hash of ``key``: repeatable, the same for any partitioning, and a task sends on its share of them only.

    A count first gives the share of hashes that holds about ``rows`` rows; if rows that share a key make it more, the smallest hashes stay.
    """
    total = df.count()
    if total <= rows:
        return df
    bound = int(rows / total * (1 << 64)) - (1 << 63)
    return df.where(F.xxhash64(F.lit(7), key) < F.lit(bound)).orderBy(F.xxhash64(F.lit(7), key), key).limit(rows)

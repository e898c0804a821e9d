"""Helpers shared by the text operators: the shared folder, cut lineage, small expressions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a fresh one where that is unset, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_owner, _kept = "", {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps between tasks for one operator; another operator's is let go first."""
    global _owner
    if owner != _owner:
        let_go()
        _owner = owner
    return _kept


def let_go() -> None:
    """Give back the memory of what this worker keeps, which other processes of the executor may need."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shrunk(values: np.ndarray) -> bytes:
    """Compressed: the first bytes of all values, then the second ones and so on, as most values are far below their type's largest."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return values.dtype.str.encode().ljust(8) + len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def grown(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:8].decode().strip()), int.from_bytes(data[8:16], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[16:], n * kind.itemsize, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind)[:, 0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a small side that are sent to all tasks (about 40 bytes each).
MAX_BROADCAST_ROWS = 500_000
SALTS = 16


def spread_join(rows: DataFrame, small: DataFrame, key: str, spread_by: Column, how: str = "inner") -> DataFrame:
    """Join on ``key``, unique in ``small``, where a few keys may hold most of ``rows``.

    A small side of at most MAX_BROADCAST_ROWS is sent to all tasks; a larger one is copied SALTS times, and the rows
    of a key are dealt over the copies by the hash ``spread_by``.
    """
    if small.count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(spread_by, F.lit(SALTS)).cast("int")).join(copies, [key, "__salt"], how).drop("__salt")


#: Bounds of a batch of texts on its way to and from a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of bounded size: the session's bounds are lowered, as texts are longer than its defaults assume."""
    conf = rows.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return rows.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def one_of_five(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: the fold that the contracts name. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5

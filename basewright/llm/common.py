"""Shared plumbing: table access, shared-folder tables, guarded broadcasts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a guarded broadcast may hold, and the bytes one of them may take.
BROADCAST_ROWS = 50_000

#: Bytes of one Arrow batch sent to Python.
BATCH_BYTES = 8 << 20

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset (tests, one
    machine) a temporary folder of this process stands in.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="basewright-")
    return _own_dirs[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a
    recomputation, and keeps columns prunable (checkpoint() stores whole rows).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/basewright/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it has at most ``rows``.

    Beyond that the join that follows is a shuffled one, whose skewed
    partitions adaptive execution splits. ``df`` should be a stored table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Ids that a broadcast may hold (16 bytes each and the hash table around them).
ID_ROWS = 500_000


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_between(text: Column, gap: str) -> Column:
    """The non-empty pieces of ``text`` between matches of ``gap``; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != "")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_BYTES``.

    A batch is buffered outside the heap on its way to Python, twice while a
    buffer grows; long texts fill the default of 64 MB in every running task.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)\s*([kmg]?)b?", conf.get(name).strip().lower())
    if size and int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]] > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory of this worker to the system: workers live on beside others' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)

"""Pieces that the training-data operators share: tables kept between jobs, words, hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import math
import os
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Set for Python workers, which live on between tasks: memory that is free goes back to the system.
RETURN_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2"}
#: Rows of a file that in_batches() counts as one.
BATCH_ROWS = 1024
#: Rows of a batch that Spark hands to Python; texts can be long.
BATCH = 1024
MASK = (1 << 64) - 1
GOLD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidebar-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and everything runs in one process, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _local_dir()
    return path.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so that its lineage ends there.

    A lost executor then costs a reread, not the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidebar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidebar_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by keep() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tidebar_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Kept tables of one computation, forgotten at its end."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.frames.append(keep(df))
        return self.frames[-1]

    def __exit__(self, *failed) -> None:
        forget(*self.frames)


def workers_find_us(spark: SparkSession) -> None:
    """Send this package to the Python workers, once, and let Spark hand them small batches unless the session says otherwise."""
    sc, size = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, str(BATCH))
    if not getattr(sc, "_tidebar_sent", False):
        for name, value in RETURN_MEMORY.items():
            sc.environment.setdefault(name, value)
        path = os.path.join(tempfile.mkdtemp(prefix="tidebar-package-"), "tidebar_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(PACKAGE):
                for name in sorted(names):
                    if name.endswith(".py"):
                        at = os.path.join(folder, name)
                        out.write(at, os.path.relpath(at, os.path.dirname(PACKAGE)))
        sc.addPyFile(path)
        sc._tidebar_sent = True


def frugal(run):
    """A function for mapInArrow that ends by giving memory that is free back to the system: Python workers live on, and
    later stages run beside what earlier ones have kept."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_us(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word (bytes) -> its 64-bit hash as 8 raw bytes; emptied when it has grown to `limit` words."""

    def __init__(self, limit: int = 150_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh3_64_intdigest(word, self.seed).to_bytes(8, "little")
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive entries."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(k, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + k]
    return mix(out + np.uint64((n * int(GOLD)) & MASK))


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, whatever else the table has."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def _numbers_its_rows(docs: DataFrame) -> bool:
    """Whether a table is a plain scan of files whose format tells the number of a row in its file."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or "_metadata" in docs.columns:
        return False
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def in_batches(docs: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text, bid (of a batch of rows), row (of the row in its batch's file), and more columns: {new name: name}.

    Tables that are anything but a plain scan of Parquet files are written first, so that file and row number name a row.
    """
    wanted = [F.col("doc_id"), F.col("text"), *(F.col(f"`{c}`").alias(n) for n, c in (more or {}).items())]
    if _numbers_its_rows(docs):
        docs = docs.select(*wanted, F.col("_metadata").alias("_where"))
    else:
        docs = keep(docs.select(*wanted))
        docs = docs.select(*docs.columns, F.col("_metadata").alias("_where"))
    batch = F.xxhash64("_where.file_path", F.floor(F.col("_where.row_index") / BATCH_ROWS))
    return docs.select("doc_id", "text", batch.alias("bid"), F.col("_where.row_index").alias("row"), *(more or {}))


#: Up to so many rows of a few numbers (some 40 bytes each) are sent to all executors; beyond, texts and sets are shuffled to them.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A kept table of short rows, marked to be sent to all executors if it has no more than BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Vectors that one task of sum_blobs adds up in the rounds after the first.
FAN = 32


def sum_blobs(df: DataFrame, width: int) -> np.ndarray:
    """Sum of a table of binary rows (column blob), each `width` doubles.

    Partitions stream their rows into one vector each; rounds of FAN vectors a task follow until one is left, so no
    task, and not the driver either, ever holds more than one vector and a batch.
    """

    def total(batches):
        acc = np.zeros(width)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                acc += np.frombuffer(blob, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], type=pa.binary())], ["blob"])

    some = df.rdd.getNumPartitions()
    sums = df.mapInArrow(total, "blob binary")
    while some > 1:
        some = math.ceil(some / FAN)
        sums = sums.repartition(some).mapInArrow(total, "blob binary")
    got = sums.collect()  # one vector of a fixed width; none from a table without partitions
    return np.frombuffer(got[0]["blob"], dtype=np.float64).copy() if got else np.zeros(width)

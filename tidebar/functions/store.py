"""What operators with several jobs share: tables kept in the shared folder, this package on the workers, sums by a tree."""

from __future__ import annotations

import functools
import math
import os
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Bytes and rows of what Spark hands to Python at once, unless the session says otherwise.
BATCH_BYTES, BATCH_ROWS = 32 << 20, 1024
CODEC = "spark.sql.parquet.compression.codec"
#: Vectors that one task of tree_sum adds up in the rounds after the first.
FAN = 32


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
    """df written to the shared folder and read back: a lost executor costs a reread, not the work before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidebar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidebar_path = path
    return out


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def forget(*frames: DataFrame) -> None:
    """Delete tables made by keep() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_tidebar_path", None):
            files, p = _at(df.sparkSession, path)
            files.delete(p, True)


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


def finished(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers n of the tables `prefix` n in a folder that were written to their end, in order."""
    files, p = _at(spark, folder)
    if not files.exists(p):
        return []
    names = [s.getPath().getName() for s in files.listStatus(p)]
    numbers = [int(n.removeprefix(prefix)) for n in names if re.fullmatch(re.escape(prefix) + r"\d+", n)]
    return sorted(n for n in numbers if files.exists(_at(spark, f"{folder}/{prefix}{n}/_SUCCESS")[1]))


def delete(spark: SparkSession, path: str) -> None:
    files, p = _at(spark, path)
    files.delete(p, True)


def workers_find_us(spark: SparkSession) -> None:
    """Send this package to the Python workers, once, and let Spark hand them batches of bounded size."""
    sc = spark.sparkContext
    for name, default, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", str(2**31 - 1), BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, str(ours))
    if not getattr(sc, "_tidebar_sent", False):
        path = os.path.join(tempfile.mkdtemp(prefix="tidebar-package-"), "tidebar_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(PACKAGE):
                for name in sorted(names):
                    if name.endswith(".py"):
                        at = os.path.join(folder, name)
                        out.write(at, os.path.relpath(at, os.path.dirname(PACKAGE)))
        sc.addPyFile(path)
        sc._tidebar_sent = True


def fold_far_repeats(spark: SparkSession) -> None:
    """Let this session write Parquet with zstd, which finds what repeats within a page of 1 MB; Spark's default looks back
    64 KB. A codec that the session names stays."""
    if CODEC not in spark.conf.getAll:
        spark.conf.set(CODEC, "zstd")


def tree_sum(df: DataFrame, width: int, maxima: int = 0) -> np.ndarray:
    """Of a table of binary rows (column blob), each width + maxima doubles: sums of the first, maxima of the others.

    Partitions stream their rows into one vector each; rounds of FAN vectors a task follow until one is left. No task, and
    not the driver, ever holds more than a vector and a batch.
    """

    def none():
        return np.concatenate([np.zeros(width), np.full(maxima, -np.inf)])

    def total(batches):
        acc = none()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                v = np.frombuffer(blob, dtype=np.float64)
                acc[:width] += v[:width]
                np.maximum(acc[width:], v[width:], out=acc[width:])
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], type=pa.binary())], ["blob"])

    sums = df.mapInArrow(total, "blob binary")
    some = sums.rdd.getNumPartitions()
    while some > 1:
        some = math.ceil(some / FAN)
        sums = sums.repartition(some).mapInArrow(total, "blob binary")
    got = sums.collect()  # one vector of a fixed width; none from a table without partitions
    return np.frombuffer(got[0]["blob"], dtype=np.float64).copy() if got else none()

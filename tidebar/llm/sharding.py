"""Sharding by proportional stratified interleaving (operator 12); DataFrame functions only.

Rows of a source are shuffled by a seeded hash and ranked; a row's fractional rank is its rank over the rows of its
source. Rows of all sources sorted by fractional rank and cut into equal runs make shards of which each has the mixture
of the whole table, and whose row counts are at most one apart (law `rows`).

No rank is counted over a whole source or table in one task: a source is dealt into buckets of its hash, the table into
buckets of the fractional rank, both of some BUCKET rows on average, and a row's rank is what the buckets before its own
hold (a table of counts) and its rank in its bucket. Texts are read for their size and checksum and never shuffled.
Repeated rows are counted before the first shuffle and numbered, by lots over many tasks; each number has its own hash.

Defined cases: a null source is a source of its own; null and empty texts have size 1 and checksum 0; rows alike in
doc_id, size and checksum are interchangeable; an empty table gives an empty one; with fewer rows than shards some shards
are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, keep

#: Rows of a bucket, on average.
BUCKET = 1024
#: Copies of a row that one task writes out.
LOT = 1024
#: Buckets whose counts are summed up in one go.
RUN = 1024


def _before(counts: DataFrame, keys: list[str], at: str, n: str, name: str) -> DataFrame:
    """counts with the sum of n over the rows of smaller `at` (from 0, dense or not), by keys, in two levels."""
    run = F.floor(F.col(at) / RUN)
    counts = counts.withColumn("_run", run)
    past = lambda *k: Window.partitionBy(*k).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy(*keys, "_run").agg(F.sum(n).alias("_of")).withColumn("_far", F.coalesce(F.sum("_of").over(past(*keys).orderBy("_run")), F.lit(0)))
    near = F.coalesce(F.sum(n).over(past(*keys, "_run").orderBy(at)), F.lit(0))
    return counts.withColumn("_near", near).join(runs.drop("_of"), [*keys, "_run"]).withColumn(name, F.col("_far") + F.col("_near")).drop("_run", "_far", "_near")


def _share(hexes: Column, of: int) -> Column:
    """Bucket 0 ... of - 1 of a hexadecimal hash, in the order of the hash."""
    return F.floor(F.conv(F.substring(hexes, 1, 12), 16, 10).cast("long") * F.lit(of) / F.lit(1 << 48)).cast("long")


def shards(docs: DataFrame, count: int = 8, by: str = "source", seed: int = 12, bucket: int = BUCKET) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, the stratum `by`, shard (0 ... count - 1), slot (from 0 in its shard)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col(f"`{by}`").cast("string").alias("stratum"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.when(F.col("stratum").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "stratum"))
    with Scratch() as scratch:
        alike = scratch.keep(rows.groupBy("doc_id", "stratum", "size", "text_crc32").agg(F.count("*").alias("copies")))
        total = alike.agg(F.sum("copies")).first()[0] or 0
        buckets = max(1, -(-total // bucket))
        lots = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LOT)))
        many = alike.where(F.col("copies") > LOT).withColumn("lot", lots).repartition("doc_id", "size", "text_crc32", "lot")
        each = alike.where(F.col("copies") <= LOT).withColumn("lot", F.lit(0).cast("long")).unionByName(many)
        copy = F.explode(F.sequence(F.col("lot") * LOT, F.least("copies", (F.col("lot") + 1) * LOT) - 1))
        name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32", F.when(F.col("copy") > 0, F.col("copy")))
        each = each.withColumn("copy", copy).withColumns({"key": key, "chance": F.md5(name)}).withColumn("bucket", _share(F.col("chance"), buckets))
        held = each.groupBy("key", "bucket").agg(F.count("*").alias("held"))
        starts = _before(held, ["key"], "bucket", "held", "start").join(held.groupBy("key").agg(F.sum("held").alias("of")), "key")
        order = Window.partitionBy("key", "bucket").orderBy("chance", "doc_id", "size", "text_crc32")
        ranked = each.withColumn("inside", F.row_number().over(order)).join(starts.drop("held"), ["key", "bucket"])
        ranked = ranked.withColumn("part", (F.col("start") + F.col("inside") - 0.5) / F.col("of")).withColumn("bucket", F.floor(F.col("part") * buckets))
        ranked = scratch.keep(ranked.select("doc_id", "stratum", "size", "text_crc32", "key", "chance", "part", "bucket"))
        starts = _before(ranked.groupBy("bucket").agg(F.count("*").alias("held")), [], "bucket", "held", "start")
        order = Window.partitionBy("bucket").orderBy("part", "chance", "key", "doc_id", "size", "text_crc32")
        place = F.col("start") + F.row_number().over(order) - 1
        placed = ranked.join(starts.drop("held"), "bucket").withColumn("place", place)
        shard = F.floor(F.col("place") * count / F.lit(max(total, 1))).cast("int")
        begins = F.ceil(F.col("shard") * F.lit(total) / count).cast("long")
        placed = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - begins)
        return keep(placed.select("doc_id", "size", "text_crc32", F.col("stratum").alias(by), "shard", "slot"))

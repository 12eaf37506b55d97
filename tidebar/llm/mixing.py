"""Mixing of sources to target weights by pivotal dependent rounding (operator 1); DataFrame functions only.

Every document of a source wants the same fractional number of copies. Its whole part is given to each document;
the fractional parts are rounded in pairs: mass moves between two documents, at random and fairly, such that the
sum of size times probability stays as it is, until one of them is 0 or 1. What remains of a group of documents
is at most one fractional document, which goes up to the next level of a reduction tree. The last one of a source has
nothing to pair with and is rounded; the words that this adds or costs are given back by settled documents of the source,
the largest that fit first, so that a source's taken words miss its target by less than a small document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, keep

#: Documents that meet in one node of the reduction tree.
FAN = 32
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`: places where a word starts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target. A row for each source; the window is over these rows only.

    The total, share times all sizes, is dealt by weight. A source gets at most `most` times its size; sources in
    the order of cap / weight reach their caps first, so running sums over that order give the level at which the
    rest share by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight")))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _chance(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


ENTRY = ["size", "doc_id", "text_hash", "ref", "p"]


def _meet(items: Column, level: int, seed: int, ref: str) -> Column:
    """Fold an array of documents with p into {cur: the one that is left, out: [those with p 0 or 1]}."""
    entry = f"struct<size:bigint,doc_id:bigint,text_hash:bigint,ref:{ref},p:double>"
    start = F.struct(F.lit(None).cast(entry).alias("cur"), F.array().cast(f"array<{entry}>").alias("out"))

    def with_p(x: Column, p: Column) -> Column:
        p = F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)
        return F.struct(*[x[c].alias(c) for c in ENTRY[:-1]], p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        a, b = cur["size"].cast("double"), x["size"].cast("double")
        up = F.least(a * (1 - cur["p"]), b * x["p"])  # words to the one that is held
        down = F.least(a * cur["p"], b * (1 - x["p"]))
        move = F.when(_chance(cur["doc_id"], cur["text_hash"], x["doc_id"], x["text_hash"], F.lit(seed + level)) * (up + down) < down, up).otherwise(-down)
        held, come = with_p(cur, cur["p"] + move / a), with_p(x, x["p"] - move / b)
        settled = (held["p"] == 0.0) | (held["p"] == 1.0)
        moved = F.struct(
            F.when(settled, come).otherwise(held).alias("cur"),
            F.concat(acc["out"], F.array(F.when(settled, held).otherwise(come))).alias("out"),
        )
        swap = F.struct(x.alias("cur"), F.concat(acc["out"], F.array(cur)).alias("out"))
        first = F.struct(x.alias("cur"), acc["out"].alias("out"))
        return F.when(cur.isNull(), first).when((cur["p"] == 0.0) | (cur["p"] == 1.0), swap).otherwise(moved)

    return F.aggregate(items, start, step)


def _picks(settled: DataFrame) -> DataFrame:
    """source, up, size, m, n: of the n documents of a size that can go up (or down) by a copy, m shall.

    A source's miss is filled with the largest sizes that fit first. Sizes of a source, up to the miss itself, form an
    array: no more than the words of its longest document.
    """
    words = F.sum(F.col("size") * (F.col("base") + F.col("p")))
    miss = settled.groupBy("source").agg(F.floor(F.first("target") + 0.5 - words).cast("long").alias("miss"))
    miss = miss.select(F.col("source").alias("s"), (F.col("miss") > 0).alias("up"), F.abs("miss").alias("miss"))
    can = settled.where("free and size > 0").join(miss, F.col("source").eqNullSafe(F.col("s")))
    can = can.where((F.col("size") <= F.col("miss")) & (F.col("up") == (F.col("p") == 0.0)))
    each = can.groupBy("source", "up", "miss", "size").agg(F.count("*").alias("n"))
    each = each.groupBy("source", "up", "miss").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    start = F.struct(F.col("miss").alias("left"), F.array().cast("array<struct<size:bigint,m:bigint,n:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        m = F.least(F.floor(acc["left"] / x["size"]), x["n"])
        taken = F.struct((acc["left"] - m * x["size"]).alias("left"), F.concat(acc["out"], F.array(F.struct(x["size"].alias("size"), m.alias("m"), x["n"].alias("n")))).alias("out"))
        return F.when(m > 0, taken).otherwise(acc)

    return each.select("source", "up", F.explode(F.aggregate("sizes", start, step)["out"]).alias("x")).select("source", "up", "x.*")


def _close(settled: DataFrame, seed: int) -> DataFrame:
    """settled (p 0 or 1) with the miss of each source given back.

    Of the n documents of a size, those with the least chances are m. Only about twice as many of them and a few
    more, told by their chance alone, are ranked, so a common size isn't one task's.
    """
    picks = _picks(settled).select(F.col("source").alias("s"), F.col("size").alias("z"), "up", "m", "n")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & F.col("free") & (F.col("up") == (F.col("p") == 0.0))
    told = settled.join(picks, same, "left").withColumn("chance", _chance(F.col("doc_id"), F.col("text_hash"), F.lit(seed - 1)))
    told = told.withColumn("near", F.coalesce(F.col("chance") * F.col("n") < 2 * F.col("m") + 64, F.lit(False)))
    order = Window.partitionBy("source", "size").orderBy("chance", "doc_id", "text_hash")
    ranked = told.where("near").withColumn("p", F.when(F.row_number().over(order) <= F.col("m"), 1 - F.col("p")).otherwise(F.col("p")))
    return ranked.unionByName(told.where("not near")).select(*settled.columns)


def decide_copies(slim: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """copies of each row of slim (doc_id, source, size, text_hash, ref); slim is read more than once."""
    targets = keep(source_targets(slim, weights, share, most))
    undecided = targets.agg(F.max("n_docs")).first()[0] or 0  # of any source
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(want + EPS)
    of_source = targets.select(F.col("source").alias("s"), "source_size", "target", base.cast("int").alias("base"), F.greatest(want - base, F.lit(0.0)).alias("p"))
    nodes = slim.join(of_source, slim["source"].eqNullSafe(F.col("s"))).drop("s")
    same = ["source", "source_size", "target", "base"]
    ref = slim.schema["ref"].dataType.simpleString()
    whole = (F.col("p") < EPS) | (F.col("size") == 0)
    fixed = nodes.where(whole).select(*same, *ENTRY).withColumn("p", F.lit(0.0)).withColumn("free", F.lit(False))
    settled = []
    nodes = nodes.where(~whole).select(*same, *ENTRY)
    level = 0
    while undecided > 0:
        # Documents of like size meet first: ranked by size within buckets that one task can sort.
        buckets = math.ceil(undecided / (128 * FAN))
        bucket = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(level)), F.lit(buckets))
        order = Window.partitionBy(*same, "bucket").orderBy(F.desc("size"), "doc_id", "text_hash")
        leaf = F.floor((F.row_number().over(order) - 1) / FAN)
        groups = (
            nodes.withColumn("bucket", bucket).withColumn("leaf", leaf)
            .groupBy(*same, "bucket", "leaf")
            .agg(F.sort_array(F.collect_list(F.struct(*ENTRY)), asc=False).alias("items"))
            .select(*same, _meet(F.col("items"), level, seed, ref).alias("met"))
        )
        groups = keep(groups.select(*same, "met.cur", "met.out"))
        settled.append(groups.select(*same, F.explode("out").alias("x")).select(*same, "x.*"))
        nodes = groups.select(*same, "cur.*")
        last = undecided <= FAN
        undecided = undecided // FAN + buckets if buckets > 1 else math.ceil(undecided / FAN)
        level += 1
        if last:
            settled.append(nodes.withColumn("p", F.round("p")))  # one document of a source is left: the nearer of the two
            break
        whole = (F.col("p") == 0.0) | (F.col("p") == 1.0)
        settled.append(nodes.where(whole))
        nodes = nodes.where(~whole)
    out = fixed
    if settled:
        free = settled[0]
        for part in settled[1:]:
            free = free.unionByName(part)
        out = out.unionByName(_close(keep(free.withColumn("free", F.lit(True))), seed))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("p").cast("int")).otherwise(0)
    return out.select("doc_id", "text_hash", "ref", "size", "source", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def slim_rows(docs: DataFrame, ref: Column) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), ref.alias("ref"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """How often a mix of `share` times all words takes each document, with sources weighing as `weights`.

    Returns doc_id, text_hash, size, source, source_size, target, copies, taken (copies * size). Sources are
    ordered by code point, null last, and take the weights in turn; a source's target stops at `most` times its
    size and the excess is shared anew by weight. Sources must be few: one row each is sorted in one task. A null text
    has size 0; documents of size 0 are not taken. No document gets more than ceil(most) copies. Repeated rows are
    documents of their own; null doc_id and source are allowed; other columns are ignored; an empty table gives no
    rows. Reruns agree: chances are hashes of what meets, and rows that are equal in all that is read are interchangeable.
    """
    return decide_copies(keep(slim_rows(docs, F.lit(None).cast("int"))), weights, share, most, seed).drop("ref")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each document as many times as mix_plan takes it, with the columns of docs, whatever their names.

    Rows are told apart by file and row number; what mix_plan says of nulls, empty texts, repeated rows and empty tables
    holds here too.
    """
    named = in_batches(docs, {"_source": "source", **{f"_{i}": c for i, c in enumerate(docs.columns)}})
    slim = named.select("doc_id", F.col("_source").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), F.struct("bid", "row").alias("ref"))
    copies = keep(decide_copies(keep(slim), weights, share, most, seed).where("copies > 0").select("ref.bid", "ref.row", "copies"))
    taken = named.join(copies.hint("merge"), ["bid", "row"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])

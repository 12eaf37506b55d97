"""Queries that read and write tables and train models, and SQL for those whose result SQL can tell."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch, delete, keep, shared_dir
from ..operators import evaluate as E
from ..operators import leafwise
from ..operators import prepare as P
from ..operators import sequence_training as S
from ..operators.features import features
from ..operators.labels import class_of, fixed_horizon
from ..sources.bars import read_bars, write_table
from . import oracle
from .bar_queries import Query, bars_of, rounded
from .pipeline import Config, run_train, run_walk_forward

#: Features of the queries that train, and a network and trees that a small machine trains in a minute.
NAMES = [*P.CORE, "macd_histogram", "volume_zscore", "bollinger_width", "hour_sin"]
QUICK = Config(folds=2, sequence_length=20, width=8, heads=2, layers=1, inner=16, training=S.Training(epochs=3, rate=0.01), growth=leafwise.Growth(trees=4, leaves=6, rate=0.2, bins=32))
#: Ends of the bins of the query with one split.
EDGES = {"close": [101.0, 105.0, 110.0, 115.0, 120.0, 130.0, 150.0], "volume": [10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 250.0], "width": [1.0, 5.0, 10.0, 20.0, 40.0, 80.0]}


def bars_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as CSV under other names and read again."""
    path = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    bars = bars_of(spark, sf_dir)
    write_table(bars.select(F.col("ts").alias("UTC"), F.col("open").alias("Open"), F.col("high").alias("HIGH"), "low", "close", F.col("volume").alias("Volume")), path, "csv")
    out = keep(read_bars(spark, path))
    delete(spark, path)
    return rounded(out)


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """close, volume and width of each bar, whether the close rises next, and whether the bar is among the last fifth."""
    df = E.next_return(bars_of(spark, sf_dir)).withColumns({"width": F.col("high") - F.col("low"), "y_meta": (F.col("ret") > 0).cast("int")})
    return P.time_split(df.where(~F.isnan("ret")), 0.8, 0.0).withColumn("held", F.col("part") != "train")


def one_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of one tree with one split, whose bins are given: the best of all cuts of all features."""
    how = leafwise.Growth(trees=1, leaves=2, rate=1.0, least_rows=40, feature_share=1.0, row_share=1.0, patience=9)
    with Scratch() as scratch:
        df = scratch.keep(_moves(spark, sf_dir))
        made = leafwise.fit(df.withColumn("held", F.lit(False)).where("part = 'train'"), list(EDGES), how=how, edges=list(EDGES.values()))
        return rounded(keep(made.predict(df).select("seq", "meta_prob")))


def window_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the window network on the rows that it and its folds were not trained on."""
    df, names = P.clean(keep(features(bars_of(spark, sf_dir), NAMES)))
    df = fixed_horizon(df).withColumn("y", class_of(F.col("label_primary")))
    parts, shape = S.with_folds(QUICK.train, QUICK.val, QUICK.folds), QUICK.shape(len(names))
    stored = S.blocks(df, names, length=shape.length)
    return S.fit(stored, names, shape, parts, QUICK.training).predict(stored, parts)


def trained_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages trained on the bars' features, and the report on the last part."""
    return run_train(keep(features(bars_of(spark, sf_dir), NAMES)), QUICK)[1]


def walk_forward_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_walk_forward(keep(features(bars_of(spark, sf_dir), NAMES)), QUICK, windows=2, least_train=100, least_test=20)


QUERIES: dict[str, Query] = {f.__name__: f for f in (bars_from_csv, one_split, window_network, trained_report, walk_forward_report)}


def oracle_sql() -> dict[str, str]:
    r = lambda x, n: f"(round({x}, 6) + 0.0)::DOUBLE AS {n}"
    worth = lambda g, h: f"greatest(abs({g}) - 0.1, 0) ** 2 / ({h} + 0.1)"
    value = lambda g, h: f"-sign({g}) * greatest(abs({g}) - 0.1, 0) / ({h} + 0.1)"
    cuts = " UNION ALL ".join(f"SELECT {i} AS f, {b} AS b, {n} <= {e!r} AS goes_left, * FROM t" for i, (n, edges) in enumerate(EDGES.items()) for b, e in enumerate(edges))
    goes = " ".join(f"WHEN f = {i} AND b = {b} THEN {n} <= {e!r}" for i, (n, edges) in enumerate(EDGES.items()) for b, e in enumerate(edges))
    return {
        "bars_from_csv": f"WITH {oracle.BARS} SELECT series_id, seq, ts, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars",
        "one_split": f"""WITH {oracle.BARS}, m AS (SELECT *, high - low AS width, lead(close) OVER (ORDER BY seq) - close AS ret FROM bars),
          a AS (SELECT *, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS y, seq < floor(0.8::DOUBLE * (SELECT count(*) - 1 FROM bars)) AS train FROM m WHERE ret IS NOT NULL),
          k AS (SELECT count(*) AS n, sum(y) AS ones FROM a WHERE train),
          t AS (SELECT seq, close, volume, width, (0.5::DOUBLE - y) * w AS g, w * 0.25::DOUBLE AS h FROM (SELECT a.*, CASE WHEN y = 1 THEN n / (2.0::DOUBLE * ones) ELSE n / (2.0::DOUBLE * (n - ones)) END AS w FROM a, k WHERE train)),
          c AS (SELECT f, b, count(*) FILTER (goes_left) AS nl, count(*) FILTER (NOT goes_left) AS nr, sum(g) FILTER (goes_left) AS gl, sum(g) FILTER (NOT goes_left) AS gr, sum(h) FILTER (goes_left) AS hl, sum(h) FILTER (NOT goes_left) AS hr FROM ({cuts}) GROUP BY f, b),
          s AS (SELECT *, round({worth('gl', 'hl')} + {worth('gr', 'hr')} - {worth('(gl + gr)', '(hl + hr)')}, 9) AS gain FROM c WHERE nl >= 40 AND nr >= 40),
          x AS (SELECT * FROM s ORDER BY gain DESC, f, b LIMIT 1)
          SELECT seq, {r(f"1 / (1 + exp(-(CASE WHEN CASE {goes} END THEN {value('gl', 'hl')} ELSE {value('gr', 'hr')} END)))", 'meta_prob')} FROM a, x""",
    }

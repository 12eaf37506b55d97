"""Rolling frames over ordered bars.

Bars are ordered by (sup, blk, seq) within a series: blk and sup are blocks of 32 and of 1,024 rows of seq, so
this is the order of seq, and windows over a series, a block or a superblock all share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

B = 32
KEY = "series_id"


def with_blocks(df: DataFrame) -> DataFrame:
    return df.withColumns({"blk": F.floor(F.col("seq") / B), "sup": F.floor(F.col("seq") / (B * B))})


#: Rows of a stretch of a series, the rows that one task works on.
STRETCH = 65_536


def in_stretches(df: DataFrame, rows: int = STRETCH, back: int = 0, ahead: int = 0) -> DataFrame:
    """Rows of each stretch of `rows`, with the `back` rows before it and the `ahead` rows behind it.

    series_id becomes (series, stretch), so that windows over it are of a stretch; seq stays. _own is false for the rows
    around a stretch. seq must number a series without gaps; back and ahead may be longer than a stretch.
    """
    at = F.floor(F.col("seq") / rows)
    spread = F.sequence(F.greatest(F.floor((F.col("seq") - ahead) / rows), F.lit(0).cast("long")), F.floor((F.col("seq") + back) / rows))
    df = df.withColumn("_at", F.explode(spread))
    key = F.struct(F.col(KEY).alias("series"), F.col("_at").alias("stretch"))
    return df.select(key.alias(KEY), *[c for c in df.columns if c not in (KEY, "_at")], F.col(KEY).alias("_series"), (at == F.col("_at")).alias("_own"))


def of_series(df: DataFrame, *columns: str) -> DataFrame:
    """The own rows of stretches as rows of their series, without what in_stretches() and with_blocks() add, or the named columns."""
    names = list(columns) or [c for c in df.columns if c not in (KEY, "_series", "_own", "blk", "sup")]
    return df.where("_own").select(*[F.col("_series").alias(KEY) if c == KEY else F.col(c) for c in ([KEY] if not columns else []) + names])


def series() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy("sup", "blk", "seq")


def superblock() -> WindowSpec:
    return Window.partitionBy(KEY, "sup").orderBy("blk", "seq")


def block() -> WindowSpec:
    return Window.partitionBy(KEY, "sup", "blk").orderBy("seq")


def rows(n: int, until: int = 0) -> WindowSpec:
    """The n rows that end `until` rows after the current one."""
    return series().rowsBetween(until - n + 1, until)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(x, k).over(series())


def lead(x: str | Column, k: int = 1) -> Column:
    return F.lead(x, k).over(series())


def full(agg: Column, x: str | Column, n: int, until: int = 0) -> Column:
    """agg over n rows, null unless all n of x are there."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(rows(n, until)) == n, agg.over(rows(n, until)))


def mean(x: str | Column, n: int) -> Column:
    return full(F.avg(x), x, n)


def sd(x: str | Column, n: int) -> Column:
    return full(F.stddev_samp(x), x, n)


def total(x: str | Column, n: int) -> Column:
    return full(F.sum(x), x, n)


def highest(x: str | Column, n: int, until: int = 0) -> Column:
    return full(F.max(x), x, n, until)


def lowest(x: str | Column, n: int, until: int = 0) -> Column:
    return full(F.min(x), x, n, until)


def corr(x: str, y: str, n: int) -> Column:
    """Correlation over n rows; null where one of the two doesn't vary, for there is none. Gaps leave out their row."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(v)) for v in (x, y))
    varied = (F.max(a).over(rows(n)) > F.min(a).over(rows(n))) & (F.max(b).over(rows(n)) > F.min(b).over(rows(n)))
    spread = F.nullif(F.stddev_pop(a).over(rows(n)) * F.stddev_pop(b).over(rows(n)), F.lit(0.0))
    return F.when(varied, F.covar_pop(a, b).over(rows(n)) / spread)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return a / F.nullif(b, F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 or 0; what can't be told is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ln(x: Column) -> Column:
    """Natural logarithm; null where x is not positive."""
    return F.when(x > 0, F.log(x))

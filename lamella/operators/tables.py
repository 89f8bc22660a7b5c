"""Table operators: deliveries, upserts, completeness, guards, imputation, joins with checks, set assertions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns, so that aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def latest(df: DataFrame, keys: Sequence[str], arrived: str, *tie: str) -> DataFrame:
    """One row a key: the delivery that arrived last (SRC-6 and AGG-6 with an explicit order)."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(arrived), *tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recomputed keys replace old rows, the rest is kept."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def gaps(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without a finished row."""
    return expected.select(*keys).distinct().join(done.select(*keys).distinct(), list(keys), "left_anti")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that fails if a key stands twice on either side; the check runs in the same job."""

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"key is not unique on the {side}")).cast("boolean")).otherwise(True)).drop("_n")

    return checked(left, "left").join(checked(right, "right"), list(keys), how)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is missing."""
    return F.when(b != 0, a / b)


def impute(df: DataFrame, cols: Sequence[str], how: str = "mean") -> DataFrame:
    """Missing values become the column's mean or median: one aggregation, joined back as a single row."""
    agg = {"mean": F.avg, "median": F.median}[how]
    fill = df.agg(*[agg(c).alias(f"_{c}") for c in cols])
    return df.join(F.broadcast(fill)).withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(cols), name, value)


def complete_names(long: DataFrame, name: str = "name", value: str = "value", eps: float = 1e-12) -> DataFrame:
    """Names whose values are all finite and not constant (PRJ-7, PRJ-8)."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return long.groupBy(name).agg(F.bool_and(ok).alias("finite"), F.stddev_pop(value).alias("sd")).where(F.col("finite") & (F.col("sd") > eps)).select(name)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def band(c: Column, inner: tuple[float, float], outer: tuple[float, float]) -> Column:
    """inside, extrapolated, outside or missing."""
    return F.when(c.isNull(), "missing").when(c.between(*inner), "inside").when(c.between(*outer), "extrapolated").otherwise("outside")


def worst(states: DataFrame, key: str, state: str) -> DataFrame:
    """The worst state a key: missing, outside, extrapolated, inside."""
    rank = F.when(F.col(state) == "missing", 3).when(F.col(state) == "outside", 2).when(F.col(state) == "extrapolated", 1).otherwise(0)
    return states.groupBy(key).agg(F.max_by(state, rank).alias("status"))


def symmetric(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """Both directions of each edge between known nodes, once."""
    both = edges.select(src, dst).union(edges.select(dst, src)).where(F.col(src) != F.col(dst)).distinct()
    return both.join(nodes.select(F.col(node).alias(src)), src, "left_semi").join(nodes.select(F.col(node).alias(dst)), dst, "left_semi").select(src, dst)


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, alias: str) -> DataFrame:
    """The last value of right at or before each row of left: one union and one window, no range join."""
    l = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_s", F.lit(1))
    r = right.select(by, ts, F.col(value).alias("_v")).withColumn("_s", F.lit(0))
    w = Window.partitionBy(by).orderBy(ts, "_s").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r, allowMissingColumns=True).withColumn(alias, F.last("_v", ignorenulls=True).over(w)).where("_s = 1").drop("_v", "_s")


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points within [start, end): spans are cut into bins of ``width``, so it stays an equi-join."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(s, "_bin").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")

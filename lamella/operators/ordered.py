"""Weighted and ordered aggregates, ranks, runs, crossings and dealing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.session import cut


def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str, q: float, form: str = "right") -> DataFrame:
    """Quantile of weighted values by linear interpolation of the cumulative share (``right``: cum/W, ``mid``: (cum - w/2)/W)
    or the first value whose cumulative weight reaches q W (``left``). Equal values are added up first."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    part, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(value)
    rows = rows.withColumns({"cum": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(part)})
    if form == "left":
        return rows.where(F.col("cum") >= F.col("total") * q).groupBy(*keys).agg(F.min(value).alias("quantile"))
    p = F.col("cum") / F.col("total") if form == "right" else (F.col("cum") - F.col("w") / 2) / F.col("total")
    rows = rows.withColumn("p", p).withColumns({"p0": F.lag("p").over(order), "v0": F.lag(value).over(order)})
    at = F.when(F.col("p0").isNull() | (F.col("p") == F.col("p0")), F.col(value)).otherwise(F.col("v0") + (F.col(value) - F.col("v0")) * (q - F.col("p0")) / (F.col("p") - F.col("p0")))
    hit = rows.where(F.col("p") >= q).groupBy(*keys).agg(F.min_by(at, "p").alias("quantile"))
    top = rows.groupBy(*keys).agg(F.max(value).alias("_top"))
    return top.join(hit, list(keys), "left").select(*keys, F.coalesce("quantile", "_top").alias("quantile")) if keys else hit


def capped_mean(value: Column, weight: Column, cap: float) -> Column:
    return F.sum(weight * F.least(value, F.lit(cap))) / F.sum(weight)


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.min(value).alias("low"), q.alias("q"), F.max(value).alias("high")).select(*keys, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("q3"), "high")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, alias: str = "rank") -> DataFrame:
    """Rank with ties sharing the mean, by counts of distinct values: a hot value is one row, not a window of them."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn(alias, F.sum("_n").over(w) - (F.col("_n") - 1) / 2)
    return df.join(n.drop("_n"), [*keys, value])


def mid_rank_cdf(df: DataFrame, value: str, alias: str = "cdf") -> DataFrame:
    """Value to (cum - n/2)/N over the whole table, by its counts."""
    n = df.groupBy(value).agg(F.count("*").alias("_n"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return n.select(value, F.col("_n").alias("n"), ((F.sum("_n").over(w) - F.col("_n") / 2) / F.sum("_n").over(all_)).alias(alias))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Runs of equal state along an ordered line: (keys, run, state, length)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(1))
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "run", state).agg(F.count("*").alias("length"))


def lag_products(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Mean of v(t) v(t + k), demeaned per line: (lag, product, n)."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    cols = [F.struct(F.lit(k).alias("lag"), F.col(f"_p{k}").alias("p")) for k in lags]
    pairs = d.withColumns({f"_p{k}": F.col("_d") * F.lead("_d", k).over(w) for k in lags}).select(F.explode(F.array(*cols)).alias("e"))
    return pairs.where("e.p IS NOT NULL").groupBy(F.col("e.lag").alias("lag")).agg(F.avg("e.p").alias("product"), F.count("*").alias("n"))


def first_crossing(df: DataFrame, keys: Sequence[str], x: str, value: str, level: float) -> DataFrame:
    """Where the value first falls below the level, interpolated between the two places."""
    w = Window.partitionBy(*keys).orderBy(x)
    d = df.withColumns({"_x0": F.lag(x).over(w), "_v0": F.lag(value).over(w)})
    at = F.col("_x0") + (F.col("_v0") - level) / (F.col("_v0") - F.col(value)) * (F.col(x) - F.col("_x0"))
    return d.where((F.col(value) < level) & (F.col("_v0") >= level)).groupBy(*keys).agg(F.min_by(at, x).alias("crossing"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def md5_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the joined parts; the same in every engine and at every partitioning."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)


def global_rank(df: DataFrame, order: Sequence[str], alias: str = "rank") -> DataFrame:
    """Position (from 1) of each row in the order of columns that have no ties, without bringing all rows into one task: rows
    are range-partitioned and written, counted by part, and ranked within their part from the part's offset."""
    d = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = d.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return d.withColumn("_r", within).join(F.broadcast(offsets), "_p").withColumn(alias, F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")


def successive(df: DataFrame, order: str, value: str) -> DataFrame:
    """(order, step): the difference of each value from the one before it; ranges of rows at a time, their last values handed on."""
    d = cut(df.select(order, value).repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    last = d.groupBy("_p").agg(F.max_by(value, order).alias("_v")).select("_p", F.lag("_v").over(Window.orderBy("_p")).alias("_last"))  # one row a partition
    before = F.coalesce(F.lag(value).over(Window.partitionBy("_p").orderBy(order)), F.col("_last"))
    return d.join(F.broadcast(last), "_p").select(order, (F.col(value) - before).alias("step"))


def deal(df: DataFrame, key: str, klass: str, folds: int, seed: str) -> DataFrame:
    """Keys dealt round robin into folds, class by class, in hash order."""
    d = df.select(key, klass).distinct().withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    return global_rank(d, [klass, "_h", key], "_g").select(key, klass, ((F.col("_g") - 1) % folds).alias("fold"))


def shuffle_split(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """train or test by hash order of the keys, an exact share of them."""
    n = df.select(key).distinct().withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    r = global_rank(n, ["_h", key], "_g")
    total = r.agg(F.floor(F.count("*") * share).alias("_t"))
    return r.join(F.broadcast(total)).select(key, F.when(F.col("_g") <= F.col("_t"), "train").otherwise("test").alias("role"))

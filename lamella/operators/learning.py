"""Vectors, neighbours, kernels, folds, metrics and resampling, on tables of (id, group, label, array)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import average_rank, md5_uniform


def doubles(c: str) -> Column:
    return F.transform(c, lambda v: v.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(c: str) -> Column:
    """The array at length one; null where it is all zero."""
    n = F.sqrt(dot(c, c))
    return F.when(n > 0, F.transform(c, lambda v: v / n))


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def standardise(df: DataFrame, vec: str, train: Column) -> DataFrame:
    """Columns at mean 0 and SD 1 of the training rows (SD under 1e-8 counts as 1): one aggregation, one broadcast row."""
    stats = df.where(train).select(F.posexplode(vec).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    row = stats.agg(F.array_sort(F.collect_list(F.struct("j", "m", F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s")).alias("s")))).alias("_st"))
    return df.join(F.broadcast(row)).withColumn(vec, F.zip_with(vec, "_st", lambda v, s: (v - s["m"]) / s["s"])).drop("_st")


def robust_scale(df: DataFrame, vec: str, train: Column, limit: float = 10.0) -> DataFrame:
    """Columns less their median, over IQR / 1.349 (SD where that is 0, dropped to 0 where both are), clipped."""
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    st = df.where(train).select(F.posexplode(vec).alias("j", "v")).groupBy("j").agg(q.alias("q"), F.stddev_pop("v").alias("sd"))
    scale = F.when(F.col("q")[2] > F.col("q")[0], (F.col("q")[2] - F.col("q")[0]) / 1.349).when(F.col("sd") > 1e-12, F.col("sd"))
    row = st.agg(F.array_sort(F.collect_list(F.struct("j", F.col("q")[1].alias("m"), scale.alias("s")))).alias("_st"))
    return df.join(F.broadcast(row)).withColumn(vec, F.zip_with(vec, "_st", lambda v, s: F.coalesce(F.greatest(F.least((v - s["m"]) / s["s"], F.lit(limit)), F.lit(-limit)), F.lit(0.0)))).drop("_st")


def pooled(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Mean and SD of each coordinate over the rows of a key, as arrays."""
    m = df.select(*keys, F.posexplode(vec).alias("j", "v")).groupBy(*keys, "j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    m = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", "m", "s"))).alias("e"))
    return m.select(*keys, F.transform("e", lambda e: e["m"]).alias("mean"), F.transform("e", lambda e: e["s"]).alias("sd"))


def nearest_rows(df: DataFrame, key: str, vec: str, k: int, differ: str | None = None, keep: Sequence[str] = (), block: int = 1024) -> DataFrame:
    """The k most similar rows (cosine of unit vectors to 9 places; equal: smaller key) of every row, exactly.

    For evaluation sets: the work is quadratic, done in pairs of blocks of about ``block`` rows whose best k are merged; the
    approximate search is an operator of its own. With ``differ``, only rows of another value of that column count.
    """
    import numpy as np
    import pandas as pd

    blocks = max(1, -(-df.count() // block))
    kinds = dict(df.dtypes)
    cols = [key, vec, *dict.fromkeys([*keep, *([differ] if differ else [])])]
    rows = df.select(*cols).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    asks = rows.withColumn("_o", F.explode(every)).select((F.col("_b") * blocks + F.col("_o")).alias("_p"), F.lit(True).alias("_ask"), *cols)
    gives = rows.withColumn("_o", F.explode(every)).select((F.col("_o") * blocks + F.col("_b")).alias("_p"), F.lit(False).alias("_ask"), *cols)
    out = ["a", "b", "sim", *[f"{c}_{s}" for c in keep for s in "ab"]]
    schema = f"a {kinds[key]}, b {kinds[key]}, sim double" + "".join(f", {c}_{s} {kinds[c]}" for c in keep for s in "ab")

    def best(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part[part["_ask"]].reset_index(drop=True), part[~part["_ask"]].sort_values(key).reset_index(drop=True)
        if not len(x) or not len(y):
            return pd.DataFrame(columns=out)
        sim = np.round(np.stack(x[vec]) @ np.stack(y[vec]).T, 9)
        sim[x[key].to_numpy()[:, None] == y[key].to_numpy()[None, :]] = -9
        if differ:
            sim[x[differ].to_numpy()[:, None] == y[differ].to_numpy()[None, :]] = -9
        at = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        i, j = np.repeat(np.arange(len(x)), at.shape[1]), at.ravel()
        ok = sim[i, j] > -9
        i, j = i[ok], j[ok]
        got = {"a": x[key].to_numpy()[i], "b": y[key].to_numpy()[j], "sim": sim[i, j]}
        for c in keep:
            got |= {f"{c}_a": x[c].to_numpy()[i], f"{c}_b": y[c].to_numpy()[j]}
        return pd.DataFrame(got)[out]

    near = asks.unionByName(gives).groupBy("_p").applyInPandas(best, schema)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("rank") <= k)


def votes(neighbours: DataFrame, label: str, k: int) -> DataFrame:
    """(a, label, share) of the neighbours' labels, and the winning one (equal: smaller label)."""
    v = neighbours.groupBy("a", F.col(label).alias("label")).agg((F.count("*") / k).alias("share"))
    return v.groupBy("a").agg(F.min_by("label", F.struct(-F.col("share"), F.col("label"))).alias("call"), F.max("share").alias("share"))


def group_folds(df: DataFrame, key: str, group: str) -> DataFrame:
    """Leave one group out: (fold, key, role); a group is never on both sides."""
    folds = df.select(F.col(group).alias("fold")).distinct()
    return folds.join(df.select(key, group)).select("fold", key, F.when(F.col("fold") == F.col(group), "test").otherwise("train").alias("role"))


def held_out_centroids(df: DataFrame, key: str, group: str, label: str, vec: str) -> DataFrame:
    """Nearest class centroid by cosine with the row's own group left out of the training rows.

    Class sums less the group's own sums give every fold's centroids in one aggregation, without a fold table.
    """
    x = df.select(key, group, label, F.posexplode(vec).alias("j", "v"))
    sums = x.groupBy(group, label, "j").agg(F.sum("v").alias("_s"))
    total = sums.groupBy(label, "j").agg(F.sum("_s").alias("_t"))
    groups = df.select(group).distinct()
    left = groups.join(total).join(sums, [group, label, "j"], "left").withColumn("c", F.col("_t") - F.coalesce("_s", F.lit(0.0)))
    cen = left.groupBy(group, label).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda e: e["c"]).alias("c"))
    cen = cen.where(dot("c", "c") > 1e-18).withColumn("c", unit("c"))
    s = df.select(key, group, F.col(label).alias("y"), unit(vec).alias("u")).join(cen.withColumnRenamed(label, "class"), group)
    s = s.withColumn("sim", F.round(dot("u", "c"), 9))
    return s.groupBy(key, group, "y").agg(F.min_by("class", F.struct(-F.col("sim"), F.col("class"))).alias("call"))


def balanced_accuracy(calls: DataFrame, y: str, call: str) -> DataFrame:
    r = calls.groupBy(y).agg(F.avg((F.col(y) == F.col(call)).cast("double")).alias("recall"))
    return r.agg(F.avg("recall").alias("balanced_accuracy"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = hits / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by average ranks, ties counting half."""
    r = average_rank(df.select(score, positive), [], score, "_r")
    pos = F.sum(F.when(F.col(positive), 1.0).otherwise(0.0))
    return r.agg(((F.sum(F.when(F.col(positive), F.col("_r"))) - pos * (pos + 1) / 2) / (pos * (F.count("*") - pos))).alias("auc"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    c2 = lambda c: c * (c - 1) / 2
    one = lambda c: n.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(c2(F.col("m"))).alias("s"), F.sum("m").alias("t"))
    both = n.agg(F.sum(c2(F.col("n"))).alias("i"))
    r = both.join(F.broadcast(one(a).select(F.col("s").alias("sa"), "t"))).join(F.broadcast(one(b).select(F.col("s").alias("sb"))))
    chance = F.col("sa") * F.col("sb") / c2(F.col("t"))
    return r.select(((F.col("i") - chance) / ((F.col("sa") + F.col("sb")) / 2 - chance)).alias("ari"))


def bootstrap_mean(df: DataFrame, group: str, value: str, draws: int, seed: str) -> DataFrame:
    """Percentile interval of the mean over resampled whole groups.

    Groups are summed first, so a draw touches one row a group; the n-th pick of a draw is a hashed group number.
    """
    g = df.groupBy(group).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    g = g.withColumn("i", F.row_number().over(Window.orderBy(group)) - 1)
    size = g.agg(F.count("*").alias("g"))
    picks = size.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "g").select("draw", "g", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("slot"))
    picks = picks.select("draw", F.floor(md5_uniform(F.lit(seed), "draw", "slot") * F.col("g")).alias("i"))
    m = picks.join(g, "i").groupBy("draw").agg((F.sum("_sum") / F.sum("_n")).alias("m"))
    return m.agg(F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.95)).alias("high"), F.stddev_samp("m").alias("se"))


def permutation_p(df: DataFrame, key: str, value: str, flag: str, draws: int, seed: str) -> DataFrame:
    """Two-sided p of the difference of means when flags are dealt anew, with the +1 correction; the keys' hash order deals."""
    base = df.select(key, value, F.col(flag).cast("int").alias("f"))
    n1 = base.agg(F.sum("f").alias("n1"), F.count("*").alias("n"), F.sum(value).alias("t"), F.sum(F.col(value) * F.col("f")).alias("s1"))
    d = base.join(F.broadcast(n1)).select(key, value, "n1", "n", "t", "s1", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col(key).cast("string"))), key)))
    gap = lambda s: F.abs(s / F.col("n1") - (F.col("t") - s) / (F.col("n") - F.col("n1")))
    per = d.groupBy("draw", "n1", "n", "t", "s1").agg(F.sum(F.when(F.col("r") <= F.col("n1"), F.col(value)).otherwise(0.0)).alias("s"))
    return per.agg(((F.count_if(gap(F.col("s")) >= gap(F.col("s1")) - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def adjusted_p(df: DataFrame, key: str, p: str) -> DataFrame:
    """Holm and Benjamini-Hochberg values of a bounded family of tests; null and NaN take no part."""
    t = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    up = Window.orderBy(p, key)
    t = t.withColumns({"r": F.row_number().over(up), "m": F.count("*").over(Window.partitionBy(F.lit(1)))})
    holm = F.max(F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("r") + 1))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.least(F.lit(1.0), F.col(p) * F.col("m") / F.col("r"))).over(up.rowsBetween(0, Window.unboundedFollowing))
    return t.withColumns({"holm": holm, "bh": bh}).select(key, p, "holm", "bh")

"""Probabilities, calls and folds: softmax with a floor, log-loss, ensembles, call changes, nested folds, novelty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(scores: DataFrame, keys: Sequence[str], score: str, temperature: float = 1.0, floor: float = 1e-6) -> DataFrame:
    """Adds ``p``: softmax of score / temperature within keys, floored and made to add up to 1 again."""
    w = Window.partitionBy(*keys)
    s = scores.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    s = s.withColumn("_q", F.greatest(F.col("_e") / F.sum("_e").over(w), F.lit(floor)))
    return s.withColumn("p", F.col("_q") / F.sum("_q").over(w)).drop("_e", "_q")


def log_loss(p: Column, floor: float = 1e-6) -> Column:
    """Mean negative log of the true class's probability."""
    return -F.avg(F.log(F.greatest(p, F.lit(floor))))


def best_temperature(scores: DataFrame, keys: Sequence[str], klass: str, truth: str, score: str, grid: Sequence[float]) -> DataFrame:
    """(temperature, loss) over a grid; one pass, as the grid is an array exploded by row."""
    g = scores.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in grid]))).withColumn("_s", F.col(score) / F.col("temperature"))
    p = softmax(g, [*keys, "temperature"], "_s")
    return p.where(F.col(klass) == F.col(truth)).groupBy("temperature").agg(log_loss(F.col("p")).alias("loss"))


def ensemble(members: DataFrame, keys: Sequence[str], klass: str, p: str) -> DataFrame:
    """Mean probability of the members and the call (equal: smaller class)."""
    m = members.groupBy(*keys, klass).agg(F.avg(p).alias("p"))
    return m.groupBy(*keys).agg(F.min_by(klass, F.struct(-F.col("p"), F.col(klass))).alias("call"), F.max("p").alias("p"))


def changed_calls(a: DataFrame, b: DataFrame, key: str, y: str, call: str) -> DataFrame:
    """Rows gained, lost, kept right and kept wrong from one set of calls to the other."""
    j = a.select(key, y, F.col(call).alias("_a")).join(b.select(key, F.col(call).alias("_b")), key)
    ok_a, ok_b = F.col("_a") == F.col(y), F.col("_b") == F.col(y)
    state = F.when(ok_b & ~ok_a, "gained").when(ok_a & ~ok_b, "lost").when(ok_a, "right").otherwise("wrong")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def nested_folds(df: DataFrame, key: str, group: str, inner: int) -> DataFrame:
    """Outer folds by group; the rest dealt by group into inner folds: (fold, inner, key, role), groups never parted."""
    g = df.select(F.col(group).alias("_g")).distinct()
    pairs = g.select(F.col("_g").alias("fold")).join(g, F.col("fold") != F.col("_g"))
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.md5(F.concat_ws("|", F.col("fold").cast("string"), F.col("_g").cast("string")))))
    dealt = pairs.withColumn("_i", (rank - 1) % inner).withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
    dealt = dealt.select("fold", "inner", "_g", F.when(F.col("_i") == F.col("inner"), "val").otherwise("train").alias("role"))
    return dealt.join(df.select(key, F.col(group).alias("_g")), "_g").select("fold", "inner", key, "role")


def without_neighbours(folds: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Training rows of a fold that touch one of its test rows are taken out; edges hold both directions (src, dst)."""
    test = folds.where("role = 'test'").select("fold", F.col(key).alias("src")).join(edges, "src").select("fold", F.col("dst").alias(key)).distinct()
    return folds.where("role = 'test'").unionByName(folds.where("role = 'train'").join(test, ["fold", key], "left_anti"))


def reliable_columns(halves: DataFrame, name: str, left: str, right: str, least: float = 0.5) -> DataFrame:
    """Columns whose two halves agree: correlation by name, and whether it passes."""
    r = halves.groupBy(name).agg(F.corr(left, right).alias("r"))
    return r.withColumn("trusted", F.coalesce(F.col("r") >= least, F.lit(False)))

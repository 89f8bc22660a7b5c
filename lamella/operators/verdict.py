"""Lot verdicts: variance components by session, comparison with margins, matched contrasts, tolerance counts, rule scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import cut


def variance_components(rows: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way random effects by key: mean squares, n0, the two SDs, ICC, group weight sum n^2 / N^2 and Satterthwaite df.

    From sums by group alone; negative between-variance counts as 0.
    """
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    t = t.where("k > 1 AND n > k").withColumns({"msb": (F.col("q") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("k") - 1), "msw": F.col("ssw") / (F.col("n") - F.col("k")), "n0": (F.col("n") - F.col("n2") / F.col("n")) / (F.col("k") - 1)})
    t = t.withColumn("vb", F.greatest((F.col("msb") - F.col("msw")) / F.col("n0"), F.lit(0.0)))
    w = F.col("n2") / (F.col("n") * F.col("n"))
    a, b = F.col("msb") * w / F.col("n0"), F.col("msw") * (1 / F.col("n") - w / F.col("n0"))
    df = F.pow(a + b, 2) / (a * a / (F.col("k") - 1) + b * b / (F.col("n") - F.col("k")))
    return t.select(*keys, "k", "n", "mean", "msb", "msw", "n0", F.sqrt("vb").alias("sd_between"), F.sqrt("msw").alias("sd_within"), (F.col("vb") / (F.col("vb") + F.col("msw"))).alias("icc"), w.alias("weight"), df.alias("df"))


def compare(rows: DataFrame, lot: str, baseline: str, session: str, value: str, alpha: float = 0.05, margin_sd: float = 1.5) -> DataFrame:
    """Each lot against the baseline lot, one row a lot: difference, error, degrees of freedom, interval, margin, zone and the
    p value against a difference as large as the margin.

    The variance of the difference comes from the baseline's components by session (a lot whose own variance of the mean is larger
    keeps its own), its degrees of freedom by Satterthwaite; where every baseline row has a session of its own it is Welch's form
    with the baseline's SD. The interval is one of level 1 - 2 alpha. Only sums by lot and session are made; the t quantiles are
    taken on one row a lot.
    """
    from lamella.functions.distributions import t_quantile, t_survival

    r = rows.where(F.col(value).isNotNull())
    g = r.groupBy(F.col(lot).alias("lot"), F.col(session).alias("s")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.groupBy("lot").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    t = t.withColumns({"ssb": F.col("q") - F.col("n") * F.col("mean") * F.col("mean"), "w": F.col("n2") / (F.col("n") * F.col("n"))}).withColumn("var", (F.col("ssw") + F.col("ssb")) / (F.col("n") - 1))
    t = cut(t)  # one row a lot, read twice below
    b = t.where(F.col("lot") == baseline).select(*[F.col(c).alias(f"b_{c}") for c in ("k", "n", "n2", "mean", "ssw", "ssb", "w", "var")])
    x = t.where(F.col("lot") != baseline).select("lot", "n", "mean", "w", "var").join(F.broadcast(b))
    c = {c: F.col(c) for c in ("n", "w", "var", "b_k", "b_n", "b_w", "b_var")}
    aware = (c["b_n"] > c["b_k"]) & (c["b_k"] > 1)
    dfw, dfb = c["b_n"] - c["b_k"], c["b_k"] - 1
    x = x.withColumns({"msw": F.when(aware, F.col("b_ssw") / dfw), "msb": F.when(aware, F.col("b_ssb") / dfb), "n0": F.when(aware, (c["b_n"] - F.col("b_n2") / c["b_n"]) / dfb)})
    x = x.withColumn("vs", F.greatest((F.col("msb") - F.col("msw")) / F.col("n0"), F.lit(0.0)))
    v_lot, own = F.col("msw") / c["n"] + F.col("vs") * c["w"], F.when(c["n"] > 1, c["var"] / c["n"])
    x = x.withColumn("own", F.coalesce(own > v_lot, F.lit(False)))
    some = F.col("vs") > 0
    part = lambda weight: F.when(some, weight / F.col("n0")).otherwise(0.0)
    cw = 1 / c["b_n"] - part(c["b_w"]) + F.when(F.col("own"), 0.0).otherwise(1 / c["n"] - part(c["w"]))
    cb = part(c["b_w"]) + F.when(F.col("own"), 0.0).otherwise(part(c["w"]))
    tw, tb, to = cw * F.col("msw"), cb * F.col("msb"), F.when(F.col("own"), own).otherwise(0.0)
    df = F.pow(tw + tb + to, 2) / (tw * tw / dfw + tb * tb / dfb + F.when(F.col("own"), to * to / (c["n"] - 1)).otherwise(0.0))
    var = F.col("msw") / c["b_n"] + F.col("vs") * c["b_w"] + F.when(F.col("own"), own).otherwise(v_lot)
    x = x.withColumns({
        "delta": F.col("mean") - F.col("b_mean"), "margin": margin_sd * F.sqrt(c["b_var"]), "mode": F.when(aware, "session-aware").otherwise("welch"),
        "se": F.when(aware, F.sqrt(var)).otherwise(F.sqrt(c["b_var"] * (1 / c["n"] + 1 / c["b_n"]))), "df": F.when(aware, df).otherwise(c["b_n"] - 1.0)})
    x = cut(x.select("lot", "delta", "margin", "mode", "se", "df"))  # else the formulas above are written out many times over
    x = x.withColumn("t", t_quantile(F.lit(1 - alpha), F.col("df")))
    x = x.withColumns({"low": F.col("delta") - F.col("t") * F.col("se"), "high": F.col("delta") + F.col("t") * F.col("se"), "over": (F.abs("delta") - F.col("margin")) / F.col("se")})
    two = t_survival(F.col("over"), F.col("df"))
    zone = F.when((F.col("low") > -F.col("margin")) & (F.col("high") < F.col("margin")), "EQUIV").when((F.col("low") > F.col("margin")) | (F.col("high") < -F.col("margin")), "BEYOND").otherwise("INCONCL")
    return x.select(F.col("lot").alias(lot), "mode", "delta", "se", "df", "low", "high", "margin", F.when(F.col("over") > 0, two / 2).otherwise(1 - two / 2).alias("p_margin"), zone.alias("zone"))


def matched_contrasts(rows: DataFrame, lot: str, baseline: str, session: str, value: str) -> DataFrame:
    """Differences to the baseline within sessions that hold both: pooled by harmonic weights, and the share of equal signs."""
    g = rows.where(F.col(value).isNotNull()).groupBy(lot, session).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    b = g.where(F.col(lot) == baseline).select(session, F.col("m").alias("m0"), F.col("n").alias("nb"))
    d = g.where(F.col(lot) != baseline).join(b, session).withColumns({"d": F.col("m") - F.col("m0"), "w": F.col("n") * F.col("nb") / (F.col("n") + F.col("nb"))})
    return d.groupBy(lot).agg(F.count("*").alias("sessions"), (F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("pooled"), F.abs(F.avg(F.signum("d"))).alias("agreement"))


def tolerance(rows: DataFrame, lot: str, baseline: str, value: str, width: float = 2.86, need: float = 0.857) -> DataFrame:
    """How many rows of a lot lie within mean +- width SD of the baseline, and whether they are enough."""
    b = rows.where(F.col(lot) == baseline).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    x = rows.where((F.col(lot) != baseline) & F.col(value).isNotNull()).join(F.broadcast(b))
    inside = F.count_if(F.abs(F.col(value) - F.col("m")) <= width * F.col("s"))
    return x.groupBy(lot).agg(F.count("*").alias("n"), inside.alias("inside"), (inside >= F.ceil(F.count("*") * need)).alias("passed"))


def rule_scores(long: DataFrame, rules: DataFrame, keys: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Weighted signed clipped composite per key and property: rules (property, feature, sign, weight) join features (name, z)."""
    j = long.join(rules, F.col("name") == F.col("feature"))
    term = F.col("weight") * F.col("sign") * F.greatest(F.least("z", F.lit(limit)), F.lit(-limit))
    s = j.groupBy(*keys, "property").agg((F.sum(term) / F.sum("weight")).alias("score"))
    label = F.when(F.col("score") >= 1, "likely higher").when(F.col("score") >= 0.5, "possibly higher").when(F.col("score") <= -1, "likely lower").when(F.col("score") <= -0.5, "possibly lower").otherwise("similar")
    return s.withColumn("label", label)

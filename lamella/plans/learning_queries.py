"""Queries of the vector, evaluation, inference and verdict operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import learning as l
from lamella.operators import verdict as v
from lamella.operators.ordered import md5_uniform
from lamella.operators.tables import unpivot
from lamella.sources.tables import table

from .registry import query

VEC = "vec AS (SELECT vec_id, label AS y, vec_id % 13 AS s, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
UNIT = VEC + ", u AS (SELECT vec_id, y, s, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u FROM vec)"
NEAR = "WITH " + UNIT + ", p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.s AS sa, b.s AS sb, a.y AS ya, b.y AS yb, round(list_dot_product(a.u, b.u), 9) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id{where}), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM p)"
LOTS = "t AS (SELECT l_returnflag AS lot, l_orderkey AS spot, l_orderkey % 13 AS session, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2, 3)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), (F.col("vec_id") % 13).alias("s"), l.doubles("embedding").alias("x"))


def lots(spark: SparkSession, d: str) -> DataFrame:
    """Spots of three lots with their session: means of tiles."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("lot"), F.col("l_orderkey").alias("spot"), (F.col("l_orderkey") % 13).alias("session")).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))


@query(f"WITH {VEC}, e AS (SELECT vec_id, s, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec), m AS (SELECT j, avg(v) AS m, stddev_pop(v) AS sd FROM e WHERE s <> 0 GROUP BY j) SELECT vec_id, e.j, round((v - m) / sd, 6) AS z FROM e JOIN m ON e.j = m.j")
def vec_standardise(spark, d):
    """VEC-1: fitted on the training sessions only."""
    return l.standardise(vectors(spark, d), "x", F.col("s") != 0).select("vec_id", F.posexplode("x").alias("j", "z")).withColumn("z", F.round("z", 6))


@query(f"WITH {VEC}, e AS (SELECT vec_id, s, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec), m AS (SELECT j, median(v) AS m, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 AS sd FROM e WHERE s <> 0 GROUP BY j) SELECT vec_id, e.j, round(greatest(least((v - m) / sd, 10), -10), 6) AS z FROM e JOIN m ON e.j = m.j")
def vec_robust_scale(spark, d):
    """VEC-3."""
    return l.robust_scale(vectors(spark, d), "x", F.col("s") != 0).select("vec_id", F.posexplode("x").alias("j", "z")).withColumn("z", F.round("z", 6))


@query(f"WITH {UNIT} SELECT vec_id, round(u[1], 9) AS first, round(sqrt(list_dot_product(u, u)), 9) AS norm FROM u")
def vec_unit(spark, d):
    """VEC-4."""
    return vectors(spark, d).select("vec_id", l.unit("x").alias("u")).select("vec_id", F.round(F.col("u")[0], 9).alias("first"), F.round(F.sqrt(l.dot("u", "u")), 9).alias("norm"))


@query(f"WITH {VEC}, e AS (SELECT y, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec) SELECT y, j, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS sd FROM e GROUP BY 1, 2")
def vec_pooled(spark, d):
    """VEC-5, VEC-8."""
    p = l.pooled(vectors(spark, d), ["y"], "x").select("y", F.posexplode(F.arrays_zip("mean", "sd")).alias("j", "e"))
    return p.select("y", "j", F.round("e.mean", 9).alias("mean"), F.round("e.sd", 9).alias("sd"))


@query(NEAR.format(where="") + " SELECT a, b, rank FROM n WHERE rank <= 3")
def knn_top(spark, d):
    """KNN-1: exact neighbours of an evaluation set."""
    return l.nearest_rows(vectors(spark, d).withColumn("u", l.unit("x")), "vec_id", "u", 3).select("a", "b", "rank")


@query(NEAR.format(where=" AND a.s <> b.s") + ", v AS (SELECT a, yb, count(*) / 5 AS share FROM n WHERE rank <= 5 GROUP BY 1, 2) SELECT a, call, share FROM (SELECT a, yb AS call, share, row_number() OVER (PARTITION BY a ORDER BY share DESC, yb) AS r FROM v) WHERE r = 1")
def knn_vote(spark, d):
    """KNN-1, KNN-4: votes of neighbours from other sessions."""
    u = vectors(spark, d).withColumn("u", l.unit("x"))
    return l.votes(l.nearest_rows(u, "vec_id", "u", 5, "s", ["s", "y"]), "y_b", 5)


@query(NEAR.format(where="") + ", c AS (SELECT s, count(*) AS n FROM vec GROUP BY s) SELECT round(avg((sa = sb)::INT), 9) AS rate, (SELECT round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 9) FROM c) AS chance FROM n WHERE rank = 1")
def knn_session_rate(spark, d):
    """KNN-2 in part, without the label permutation: how often the nearest one shares the session, and what chance gives."""
    x = vectors(spark, d)
    n = l.nearest_rows(x.withColumn("u", l.unit("x")), "vec_id", "u", 1, None, ["s"])
    c = x.groupBy("s").agg(F.count("*").alias("n")).agg(F.round(F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1)), 9).alias("chance"))
    return n.agg(F.round(F.avg((F.col("s_a") == F.col("s_b")).cast("int")), 9).alias("rate")).join(F.broadcast(c))


@query(f"WITH {VEC}, c AS (SELECT y, j, avg(v) AS m FROM (SELECT y, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec) GROUP BY 1, 2), k AS (SELECT y, list(m ORDER BY j) AS c FROM c GROUP BY y) SELECT a.y AS a, b.y AS b, round(list_dot_product(a.c, b.c), 9) AS linear, round(exp(0 - (list_distance(a.c, b.c) ** 2) / 2), 9) AS rbf FROM k a JOIN k b ON a.y <= b.y")
def ker_class_kernels(spark, d):
    """KER-1, KER-2, KNN-5: linear and RBF kernels between class means."""
    m = l.pooled(vectors(spark, d), ["y"], "x")
    a, b = m.select(F.col("y").alias("a"), F.col("mean").alias("p")), m.select(F.col("y").alias("b"), F.col("mean").alias("q"))
    return a.join(b, F.col("a") <= F.col("b")).select("a", "b", F.round(l.dot("p", "q"), 9).alias("linear"), F.round(F.exp(-l.squared_distance("p", "q") / 2), 9).alias("rbf"))


@query(f"WITH {VEC}, f AS (SELECT DISTINCT s AS fold FROM vec) SELECT fold, vec_id, CASE WHEN fold = s THEN 'test' ELSE 'train' END AS role FROM f, vec")
def cv_group_folds(spark, d):
    """CV-1: leave one session out."""
    return l.group_folds(vectors(spark, d), "vec_id", "s")


_CENT = f"""WITH {UNIT}, e AS (SELECT s, y, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec), g AS (SELECT DISTINCT s FROM vec),
c AS (SELECT g.s, e.y, e.j, sum(e.v) AS c FROM g JOIN e ON e.s <> g.s GROUP BY 1, 2, 3), k AS (SELECT s, y, list(c ORDER BY j) AS c FROM c GROUP BY 1, 2),
n AS (SELECT s, y AS class, list_transform(c, lambda v: v / sqrt(list_dot_product(c, c))) AS c FROM k),
p AS (SELECT u.vec_id, u.s, u.y, class, round(list_dot_product(u.u, n.c), 9) AS sim FROM u JOIN n ON u.s = n.s),
calls AS (SELECT vec_id, s, y, class AS call FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS r FROM p) WHERE r = 1)"""


@query(_CENT + " FROM calls")
def cv_centroid_calls(spark, d):
    """CV-8, CV-17: nearest centroid with the row's session left out."""
    return l.held_out_centroids(vectors(spark, d), "vec_id", "s", "y", "x")


@query(_CENT + " SELECT round(avg(r), 9) AS balanced_accuracy FROM (SELECT y, avg((y = call)::INT) AS r FROM calls GROUP BY y)")
def met_balanced_accuracy(spark, d):
    """MET-1."""
    c = l.held_out_centroids(vectors(spark, d), "vec_id", "s", "y", "x")
    return l.balanced_accuracy(c, "y", "call").withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@query(_CENT + ", r AS (SELECT y, count(*) AS n, count(*) FILTER (y = call) AS hits FROM calls GROUP BY y) SELECT y, n, hits, round((hits / n + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(hits / n * (1 - hits / n) / n + 3.8414588206941236 / (4 * n * n))) / (1 + 3.8414588206941236 / n), 8) AS low, round((hits / n + 3.8414588206941236 / (2 * n) + 1.959963984540054 * sqrt(hits / n * (1 - hits / n) / n + 3.8414588206941236 / (4 * n * n))) / (1 + 3.8414588206941236 / n), 8) AS high FROM r")
def met_recall_wilson(spark, d):
    """MET-4, AGG-20 in part."""
    c = l.held_out_centroids(vectors(spark, d), "vec_id", "s", "y", "x").groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("call")).alias("hits"))
    low, high = l.wilson(F.col("hits"), F.col("n"))
    return c.select("y", "n", "hits", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query(_CENT + " SELECT y, call, count(*) AS n FROM calls GROUP BY 1, 2")
def met_confusion(spark, d):
    """AGG-20, SEG-14."""
    return l.held_out_centroids(vectors(spark, d), "vec_id", "s", "y", "x").groupBy("y", "call").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT l_linestatus = 'O' AS pos, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem), s AS (SELECT sum(r) FILTER (pos) AS sr, count(*) FILTER (pos) AS p, count(*) AS n FROM r) SELECT round((sr - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc FROM s")
def met_auc(spark, d):
    """MET-3, STA-14, HIS-11."""
    li = table(spark, d, "lineitem").select("l_quantity", (F.col("l_linestatus") == "O").alias("pos"))
    return l.auc(li, "l_quantity", "pos").withColumn("auc", F.round("auc", 9))


@query("WITH n AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS i, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM n GROUP BY a)) AS sa, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM n GROUP BY b)) AS sb, (SELECT sum(n) FROM n) AS t) SELECT round((i - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 8) AS ari FROM s")
def met_adjusted_rand(spark, d):
    """MET-9."""
    return l.adjusted_rand(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumn("ari", F.round("ari", 8))


@query("WITH m AS (SELECT l_suppkey, l_quantity, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS g, avg(l_quantity) OVER () AS a FROM lineitem) SELECT round(1 - sum((l_quantity - g) ** 2) / sum((l_quantity - a) ** 2), 9) AS r2 FROM m")
def met_one_way_r2(spark, d):
    """MET-7, from sums by group."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.var_pop("l_quantity").alias("v"))
    t = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("a"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum("n").alias("n"))
    return t.select(F.round(1 - F.col("w") / (F.col("w") + F.col("q") - F.col("n") * F.col("a") * F.col("a")), 9).alias("r2"))


_U = "(('0x' || substr(md5('{seed}' || {text}), 1, 12))::BIGINT / 281474976710656.0)"


@query("WITH g AS (SELECT l_orderkey % 13 AS s, sum(l_quantity) AS v, count(*) AS n, row_number() OVER (ORDER BY l_orderkey % 13) - 1 AS i FROM lineitem GROUP BY 1), z AS (SELECT count(*) AS g FROM g), p AS (SELECT draw, floor(" + _U.format(seed="b|", text="draw || '|' || slot") + " * g)::BIGINT AS i FROM z, range(0, 200) d(draw), range(0, 13) s(slot) WHERE slot < g), m AS (SELECT draw, sum(v) / sum(n) AS m FROM p JOIN g ON p.i = g.i GROUP BY draw) SELECT round(quantile_cont(m, 0.05), 6) AS low, round(quantile_cont(m, 0.95), 6) AS high, round(stddev_samp(m), 6) AS se FROM m")
def sta_bootstrap(spark, d):
    """STA-1, STA-2: resampling whole sessions with a hash generator that both engines share."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 13).alias("s"), "l_quantity")
    return l.bootstrap_mean(li, "s", "l_quantity", 200, "b").select(*[F.round(c, 6).alias(c) for c in ("low", "high", "se")])


@query("WITH b AS (SELECT c_custkey AS k, c_acctbal AS v, (c_nationkey < 8)::INT AS f FROM customer), t AS (SELECT sum(f) AS n1, count(*) AS n, sum(v) AS t, sum(v * f) AS s1 FROM b), r AS (SELECT draw, v, n1, row_number() OVER (PARTITION BY draw ORDER BY md5('p|' || draw || '|' || k), k) AS r FROM b, t, range(1, 51) d(draw)), s AS (SELECT draw, sum(CASE WHEN r <= n1 THEN v ELSE 0 END) AS s FROM r GROUP BY draw) SELECT round((count(*) FILTER (abs(s / n1 - (t - s) / (n - n1)) >= abs(s1 / n1 - (t - s1) / (n - n1)) - 1e-12) + 1) / (count(*) + 1), 9) AS p FROM s, t")
def sta_permutation(spark, d):
    """STA-4: labels dealt anew by hash order."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") < 8).alias("f"))
    return l.permutation_p(c, "c_custkey", "c_acctbal", "f", 50, "p").withColumn("p", F.round("p", 9))


@query("WITH t AS (SELECT space, perm_p AS p FROM (SELECT id AS space, perm_p FROM versions) WHERE perm_p IS NOT NULL AND perm_p::VARCHAR <> 'nan'), r AS (SELECT *, row_number() OVER (ORDER BY p, space) AS r, count(*) OVER () AS m FROM t) SELECT space AS id, p AS perm_p, round(max(least(1, p * (m - r + 1))) OVER (ORDER BY p, space), 9) AS holm, round(min(least(1, p * m / r)) OVER (ORDER BY p, space ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS bh FROM r")
def sta_adjusted_p(spark, d):
    """STA-11: Holm and Benjamini-Hochberg."""
    return l.adjusted_p(table(spark, d, "versions").select("id", "perm_p"), "id", "perm_p").withColumns({"holm": F.round("holm", 9), "bh": F.round("bh", 9)})


@query("SELECT c_custkey, round(" + _U.format(seed="u|", text="c_custkey") + ", 9) AS u FROM customer")
def sta_hash_uniform(spark, d):
    """STA-17: the counter generator."""
    return table(spark, d, "customer").select("c_custkey", F.round(md5_uniform(F.lit("u"), "c_custkey"), 9).alias("u"))


_VC = f"""WITH {LOTS}, g AS (SELECT lot, session, count(*) AS n, avg(q) AS m, var_pop(q) AS v FROM t GROUP BY 1, 2),
a AS (SELECT lot, count(*) AS k, sum(n) AS n, sum(n * n) AS n2, sum(n * m) / sum(n) AS mean, sum(n * v) AS ssw, sum(n * m * m) AS q FROM g GROUP BY lot),
b AS (SELECT *, (q - n * mean * mean) / (k - 1) AS msb, ssw / (n - k) AS msw, (n - n2 / n) / (k - 1) AS n0 FROM a WHERE k > 1 AND n > k),
c AS (SELECT lot, k, n, mean, msb, msw, n0, greatest((msb - msw) / n0, 0) AS vb, n2 / (n * n) AS weight FROM b)"""


@query(_VC + " SELECT lot, k, n::BIGINT AS n, round(mean, 6) AS mean, round(msb, 5) AS msb, round(msw, 5) AS msw, round(n0, 5) AS n0, round(sqrt(vb), 5) AS sd_between, round(sqrt(msw), 5) AS sd_within, round(vb / (vb + msw), 6) AS icc, round(weight, 8) AS weight, round((msb * weight / n0 + msw * (1 / n - weight / n0)) ** 2 / ((msb * weight / n0) ** 2 / (k - 1) + (msw * (1 / n - weight / n0)) ** 2 / (n - k)), 4) AS df FROM c")
def ver_components(spark, d):
    """VER-1, VER-2, VER-3."""
    c = v.variance_components(lots(spark, d), ["lot"], "session", "q")
    return c.select("lot", "k", "n", F.round("mean", 6).alias("mean"), *[F.round(x, 5).alias(x) for x in ("msb", "msw", "n0", "sd_between", "sd_within")], F.round("icc", 6).alias("icc"), F.round("weight", 8).alias("weight"), F.round("df", 4).alias("df"))


_LOT_SUMS = """, g AS (SELECT lot, session, count(*) AS n, avg(q) AS m, var_pop(q) AS v FROM t GROUP BY 1, 2),
a AS (SELECT lot, count(*) AS k, sum(n) AS n, sum(n * n) AS n2, sum(n * m) / sum(n) AS mean, sum(n * v) AS ssw, sum(n * m * m) AS q FROM g GROUP BY lot),
l AS (SELECT *, q - n * mean * mean AS ssb, n2 / (n * n) AS w, (ssw + q - n * mean * mean) / (n - 1) AS var FROM a),
b AS (SELECT * FROM l WHERE lot = 'N')"""
#: Quantile and upper tail of Student's t by bisection and Simpson's rule, as the engine has neither.
_T_DIST = """, tq AS (
  WITH RECURSIVE s(lot, df, lo, hi, i) AS (
    SELECT lot, df, 0.0::DOUBLE, 40.0::DOUBLE, 0 FROM x
    UNION ALL
    SELECT lot, df, CASE WHEN f < 0.95 THEN mid ELSE lo END, CASE WHEN f < 0.95 THEN hi ELSE mid END, i + 1 FROM (
      SELECT s.lot, s.df, lo, hi, i, (lo + hi) / 2 AS mid, 0.5 + exp(lgamma((s.df + 1) / 2) - lgamma(s.df / 2)) / sqrt(s.df * pi()) * (lo + hi) / 2 / 2400
        * sum(CASE WHEN k IN (0, 800) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * (1 + ((lo + hi) / 2 * k / 800) ** 2 / s.df) ** (-(s.df + 1) / 2)) AS f
      FROM s, range(0, 801) r(k) WHERE i < 48 GROUP BY s.lot, s.df, lo, hi, i)
  ) SELECT lot, (lo + hi) / 2 AS t FROM s WHERE i = 48),
pm AS (SELECT x.lot, 0.5 - exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * o / 6000
    * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * (1 + (o * k / 2000) ** 2 / df) ** (-(df + 1) / 2)) AS p
  FROM (SELECT *, (abs(delta) - margin) / se AS o FROM x) x, range(0, 2001) r(k) GROUP BY x.lot, df, o)
SELECT x.lot, mode, round(delta, 6) AS delta, round(se, 6) AS se, round(df, 4) AS df, round(delta - t * se, 5) AS low, round(delta + t * se, 5) AS high, round(margin, 6) AS margin, round(p, 6) AS p_margin,
  CASE WHEN delta - t * se > -margin AND delta + t * se < margin THEN 'EQUIV' WHEN delta - t * se > margin OR delta + t * se < -margin THEN 'BEYOND' ELSE 'INCONCL' END AS zone
FROM x JOIN tq ON tq.lot = x.lot JOIN pm ON pm.lot = x.lot"""


def _compared(rows):
    c = v.compare(rows, "lot", "N", "session", "q")
    return c.select("lot", "mode", *[F.round(x, 6).alias(x) for x in ("delta", "se", "margin", "p_margin")], F.round("df", 4).alias("df"), *[F.round(x, 5).alias(x) for x in ("low", "high")], "zone")


@query(f"WITH {LOTS}" + _LOT_SUMS + """, c AS (SELECT *, ssw / (n - k) AS msw, ssb / (k - 1) AS msb, (n - n2 / n) / (k - 1) AS n0, greatest(0, (ssb / (k - 1) - ssw / (n - k)) / ((n - n2 / n) / (k - 1))) AS vs FROM b),
y AS (SELECT l.lot, l.n, l.mean - c.mean AS delta, 1.5 * sqrt(c.var) AS margin, c.msw / l.n + c.vs * l.w AS v_lot, l.var / l.n AS own, l.w, c.n AS bn, c.k AS bk, c.w AS bw, msw, msb, n0, vs FROM l, c WHERE l.lot <> 'N'),
z AS (SELECT *, own > v_lot AS o, (1.0 / bn - CASE WHEN vs > 0 THEN bw / n0 ELSE 0 END + CASE WHEN own > v_lot THEN 0 ELSE 1.0 / n - CASE WHEN vs > 0 THEN w / n0 ELSE 0 END END) * msw AS tw,
  (CASE WHEN vs > 0 THEN bw / n0 ELSE 0 END + CASE WHEN own <= v_lot AND vs > 0 THEN w / n0 ELSE 0 END) * msb AS tb FROM y),
x AS (SELECT lot, 'session-aware' AS mode, delta, margin, sqrt(msw / bn + vs * bw + greatest(own, v_lot)) AS se,
  (tw + tb + CASE WHEN o THEN own ELSE 0 END) ** 2 / (tw ** 2 / (bn - bk) + tb ** 2 / (bk - 1) + CASE WHEN o THEN own ** 2 / (n - 1) ELSE 0 END) AS df FROM z)""" + _T_DIST)
def ver_kpi(spark, d):
    """VER-4, VER-5: by sessions, with Student's quantile at Satterthwaite's degrees of freedom."""
    return _compared(lots(spark, d))


@query(f"WITH {LOTS.replace('l_orderkey % 13 AS session', 'l_orderkey AS session')}" + _LOT_SUMS + """,
x AS (SELECT l.lot, 'welch' AS mode, l.mean - b.mean AS delta, 1.5 * sqrt(b.var) AS margin, sqrt(b.var * (1.0 / l.n + 1.0 / b.n)) AS se, (b.n - 1)::DOUBLE AS df FROM l, b WHERE l.lot <> 'N')""" + _T_DIST)
def ver_welch(spark, d):
    """VER-10: every row a session of its own."""
    return _compared(lots(spark, d).withColumn("session", F.col("spot")))


@query(f"WITH {LOTS}, g AS (SELECT lot, session, avg(q) AS m, count(*) AS n FROM t GROUP BY 1, 2), d AS (SELECT a.lot, a.m - b.m AS d, a.n * b.n / (a.n + b.n) AS w FROM g a JOIN g b ON a.session = b.session AND b.lot = 'N' WHERE a.lot <> 'N') SELECT lot, count(*) AS sessions, round(sum(w * d) / sum(w), 6) AS pooled, round(abs(avg(sign(d))), 6) AS agreement FROM d GROUP BY lot")
def ver_matched(spark, d):
    """VER-6."""
    return v.matched_contrasts(lots(spark, d), "lot", "N", "session", "q").withColumns({"pooled": F.round("pooled", 6), "agreement": F.round("agreement", 6)})


@query(f"WITH {LOTS}, b AS (SELECT avg(q) AS m, stddev_samp(q) AS s FROM t WHERE lot = 'N') SELECT lot, count(*) AS n, count(*) FILTER (abs(q - m) <= 2.86 * s) AS inside, count(*) FILTER (abs(q - m) <= 2.86 * s) >= ceil(count(*) * 0.857) AS passed FROM t, b WHERE lot <> 'N' GROUP BY lot")
def ver_tolerance(spark, d):
    """VER-7."""
    return v.tolerance(lots(spark, d), "lot", "N", "q")


@query(f"WITH {LOTS}, b AS (SELECT avg(q) AS mq, stddev_samp(q) AS sq, avg(p) AS mp, stddev_samp(p) AS sp FROM t WHERE lot = 'N'), z AS (SELECT lot, spot, (q - mq) / sq AS q, (p - mp) / sp AS p FROM t, b), s AS (SELECT lot, spot, 'capacity' AS property, (0.7 * greatest(least(q, 3), -3) - 0.3 * greatest(least(p, 3), -3)) / 1.0 AS score FROM z UNION ALL SELECT lot, spot, 'resistance', -greatest(least(q, 3), -3) FROM z) SELECT lot, spot, property, round(score, 6) AS score, CASE WHEN score >= 1 THEN 'likely higher' WHEN score >= 0.5 THEN 'possibly higher' WHEN score <= -1 THEN 'likely lower' WHEN score <= -0.5 THEN 'possibly lower' ELSE 'similar' END AS label FROM s")
def imp_rule_scores(spark, d):
    """IMP-1, IMP-2, IMP-3, IMP-6: spots scored by a table of rules."""
    rules = spark.createDataFrame([("capacity", "q", 1, 0.7), ("capacity", "p", -1, 0.3), ("resistance", "q", -1, 1.0)], "property string, feature string, sign int, weight double")
    t = lots(spark, d)
    b = t.where("lot = 'N'").agg(*[f(c).alias(f"{n}{c}") for c in "qp" for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = t.join(F.broadcast(b)).select("lot", "spot", ((F.col("q") - F.col("mq")) / F.col("sq")).alias("q"), ((F.col("p") - F.col("mp")) / F.col("sp")).alias("p"))
    return v.rule_scores(unpivot(z, ["lot", "spot"], ["q", "p"], "name", "z"), F.broadcast(rules), ["lot", "spot"]).withColumn("score", F.round("score", 6))

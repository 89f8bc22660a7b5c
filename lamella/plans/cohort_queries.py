"""Queries of evaluation, kernels, resampling, outlook and phases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.operators import cohort as h
from lamella.operators import kernels as k
from lamella.operators import learning as l
from lamella.operators import ordered as o
from lamella.operators import raster as r
from lamella.sources.tables import table

from .learning_queries import _CENT, LOTS, NEAR, UNIT, VEC, lots, vectors
from .raster_queries import PX, image
from .registry import query
from .table_queries import TILES, tiles


def calls(spark, d):
    return l.held_out_centroids(vectors(spark, d), "vec_id", "s", "y", "x")


@query(_CENT + ", p2 AS (SELECT x.y AS a, z.y AS b FROM (SELECT DISTINCT y FROM calls) x, (SELECT DISTINCT y FROM calls) z WHERE x.y < z.y), t AS (SELECT y, avg((y = call)::INT) AS r FROM calls GROUP BY y) SELECT a, b, round(avg((calls.y = call)::INT), 9) AS pairwise, round(any_value(t.r), 9) AS one_vs_rest FROM p2 JOIN calls ON calls.y IN (a, b) AND call IN (a, b) JOIN t ON t.y = a GROUP BY a, b")
def met_pairwise(spark, d):
    """MET-6."""
    return h.pairwise_accuracies(calls(spark, d), "y", "call").select("a", "b", F.round("pairwise", 9).alias("pairwise"), F.round("one_vs_rest", 9).alias("one_vs_rest"))


_DIST = f"WITH {VEC}, m AS (SELECT y, j, avg(v) AS m FROM (SELECT y, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec) GROUP BY 1, 2), k AS (SELECT y AS class, list(m ORDER BY j) AS c FROM m GROUP BY y), d AS (SELECT vec_id, y, class, round(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 8) AS d FROM vec, k)"


@query(_DIST + " SELECT vec_id, class, d FROM d")
def ker_class_distance(spark, d):
    """KER-6: distances to the classes in the kernel's space."""
    return h.class_distances(vectors(spark, d), "vec_id", "y", "x").select("vec_id", "class", F.round("d", 8).alias("d"))


@query(_DIST + ", n AS (SELECT vec_id, y, class FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, class) AS r FROM d) WHERE r = 1) SELECT y, round(avg((y = class)::INT), 9) AS fixed FROM n GROUP BY y")
def met_fixed_point(spark, d):
    """MET-10: the share of rows whose own class centroid is the nearest."""
    x = vectors(spark, d)
    n = h.class_distances(x, "vec_id", "y", "x").withColumn("d", F.round("d", 8)).groupBy("vec_id").agg(F.min_by("class", F.struct("d", "class")).alias("class"))
    return n.join(x.select("vec_id", "y"), "vec_id").groupBy("y").agg(F.round(F.avg((F.col("y") == F.col("class")).cast("int")), 9).alias("fixed"))


@query("WITH v AS (SELECT vec_id, label AS y, vec_id % 13 AS s FROM embeddings), f AS (SELECT DISTINCT s AS fold FROM v), n AS (SELECT fold, y, count(*) AS n FROM f JOIN v ON s <> fold GROUP BY 1, 2) SELECT fold, count(*) AS classes, min(n) AS rarest, count(*) > 1 AND min(n) >= 40 AS learnable FROM n GROUP BY fold")
def cv_fold_report(spark, d):
    """CV-5."""
    v = vectors(spark, d)
    return h.fold_report(l.group_folds(v, "vec_id", "s"), v, "vec_id", "y", 40)


@query("WITH v AS (SELECT vec_id, vec_id % 13 AS s FROM embeddings), f AS (SELECT unnest(range(0, 26)) AS fold), t AS (SELECT fold, count(*) AS n, sum(vec_id) AS t FROM f JOIN v ON s <> fold % 13 GROUP BY fold) SELECT min(fold) AS job, count(*) AS folds, n FROM t GROUP BY n, t")
def cv_training_sets(spark, d):
    """CV-4: folds that train on the same rows are planned once."""
    f = spark.range(26).select(F.col("id").alias("fold"))
    v = vectors(spark, d).select("vec_id", "s")
    return h.training_sets(f.join(F.broadcast(v), F.col("s") != F.col("fold") % 13).withColumn("role", F.lit("train")), "vec_id")


@query("WITH v AS (SELECT vec_id, label AS y, vec_id % 13 AS s FROM embeddings), c AS (SELECT DISTINCT y AS class FROM v) SELECT vec_id, class, round((SELECT count(*) FILTER (o.y = class) / count(*) FROM v o WHERE o.vec_id <> v.vec_id), 9) AS majority, round((SELECT (count(*) FILTER (o.y = class AND o.s = v.s) + 2 * count(*) FILTER (o.y = class) / count(*)) / (count(*) FILTER (o.s = v.s) + 2) FROM v o WHERE o.vec_id <> v.vec_id), 9) AS oracle FROM v, c")
def cv_baselines(spark, d):
    """CV-18: majority shares and the provenance oracle."""
    p = h.provenance_oracle(vectors(spark, d), "vec_id", "s", "y", 2.0)
    return p.select("vec_id", "class", F.round("majority", 9).alias("majority"), F.round("oracle", 9).alias("oracle"))


@query(_CENT + ", b AS (SELECT vec_id, y, y % 5 AS call FROM calls), nn AS (SELECT (SELECT count(*) FILTER (y = call) FROM calls) AS n_a, (SELECT count(*) FILTER (y = call) FROM b) AS n_b) SELECT n_a, n_b, CASE WHEN abs(n_a - n_b) <= 2 THEN 'B' WHEN n_a > n_b THEN 'A' ELSE 'B' END AS chosen FROM nn")
def cv_blind_rule(spark, d):
    """CV-19."""
    a = calls(spark, d)
    return h.blind_choice(a, a.withColumn("call", F.col("y") % 5), "vec_id", "y", "call", 2, "B")


@query(_CENT + f", a AS (SELECT y AS class, list(c ORDER BY j) AS c FROM (SELECT y, j, sum(v) AS c FROM e GROUP BY 1, 2) GROUP BY y), f AS (SELECT vec_id, arg_min(class, (-round(list_dot_product(u.u, list_transform(c, lambda v: v / sqrt(list_dot_product(c, c)))), 9), class)) AS call FROM u, a GROUP BY vec_id) SELECT f.call, count(*) AS n, round(avg((f.call = calls.call)::INT), 9) AS stable FROM calls JOIN f ON f.vec_id = calls.vec_id GROUP BY f.call")
def cv_stability(spark, d):
    """CV-22: how often the call of a held-out fit is that of the whole fit."""
    x = vectors(spark, d)
    whole = x.select(F.col("y").alias("class"), F.posexplode("x").alias("j", "v")).groupBy("class", "j").agg(F.sum("v").alias("c")).groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda e: e["c"]).alias("c"))
    s = x.select("vec_id", l.unit("x").alias("u")).join(F.broadcast(whole.select("class", l.unit("c").alias("c")))).withColumn("sim", F.round(l.dot("u", "c"), 9))
    one = s.groupBy("vec_id").agg(F.min_by("class", F.struct(-F.col("sim"), F.col("class"))).alias("call"))
    return h.stability(calls(spark, d), one, "vec_id").withColumn("stable", F.round("stable", 9))


@query(f"WITH {VEC}, p AS (SELECT vec_id, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec), q AS (SELECT vec_id, j, round(v * ((j * 37 % 11) - 5) / 5.0, 9) AS part FROM p) SELECT vec_id, j, part, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(part) DESC, j) AS rank FROM q) WHERE rank <= 3")
def cv_contributions(spark, d):
    """CV-27."""
    c = h.contributions(vectors(spark, d), "vec_id", "x", [((j * 37 % 11) - 5) / 5 for j in range(64)], 3)
    return c.withColumn("part", F.round("part", 9))


@query("WITH e AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) SELECT src || '-' || dst AS fold, unnest([src, dst]) AS k FROM e WHERE dst IS NOT NULL")
def cv_pair_holdout(spark, d):
    """CV-7: both ends of a join are held out together."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst IS NOT NULL")
    return h.pair_folds(e, table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k")


_KC = f"WITH {VEC}, c AS (SELECT y, j, avg(v) AS m FROM (SELECT y, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec) GROUP BY 1, 2), k AS (SELECT y, list(m ORDER BY j) AS c FROM c GROUP BY y)"


@query(_KC + ", r AS (SELECT a.y AS a, b.y AS b, list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c)) / sqrt(list_dot_product(b.c, b.c)) AS k FROM k a, k b), m AS (SELECT a, avg(k) AS m FROM r WHERE b < 7 GROUP BY a), t AS (SELECT avg(m) AS t FROM m WHERE a < 7), z AS (SELECT r.a, r.b, k - x.m - w.m + t AS k FROM r JOIN m x ON x.a = r.a JOIN m w ON w.a = r.b, t) SELECT a, b, round(k / (SELECT avg(k) FROM z WHERE a = b AND a < 7), 7) AS k FROM z")
def ker_finish(spark, d):
    """KER-4: a kernel of class means, made ready on classes 0 to 6."""
    m = l.pooled(vectors(spark, d), ["y"], "x")
    a, b = m.select(F.col("y").alias("a"), F.col("mean").alias("p")), m.select(F.col("y").alias("b"), F.col("mean").alias("q"))
    return h.finished_kernel(a.join(F.broadcast(b)).select("a", "b", l.dot("p", "q").alias("k")), F.col("b") < 7).withColumn("k", F.round("k", 7))


@query(_KC + ", d AS (SELECT a.y AS a, b.y AS b, list_distance(a.c, b.c) AS d FROM k a, k b), s AS (SELECT median(d) AS s FROM d WHERE a < b AND a < 7 AND b < 7) SELECT a, b, round(exp(0 - d * d / (2 * s * s)), 8) AS k FROM d, s WHERE a <= b")
def ker_rbf_median(spark, d):
    """KER-2: the bandwidth is the median distance of the training rows."""
    m = l.pooled(vectors(spark, d), ["y"], "x")
    a, b = m.select(F.col("y").alias("a"), F.col("mean").alias("p")), m.select(F.col("y").alias("b"), F.col("mean").alias("q"))
    x = a.join(F.broadcast(b), F.col("a") <= F.col("b")).select("a", "b", F.sqrt(l.squared_distance("p", "q")).alias("d"))
    s = x.where("a < b AND b < 7").agg(F.percentile("d", F.lit(0.5)).alias("s"))
    return x.join(F.broadcast(s)).select("a", "b", F.round(F.exp(-F.col("d") * F.col("d") / (2 * F.col("s") * F.col("s"))), 8).alias("k"))


@query(NEAR.format(where=" AND a.s <> b.s") + ", m AS (SELECT a, round(avg(sqrt(greatest(2 - 2 * sim, 0) / 64)), 8) AS novelty FROM n WHERE rank <= 3 GROUP BY a) SELECT a, novelty, novelty > (SELECT quantile_cont(novelty, 0.95) FROM m) AS flagged FROM m")
def knn_novelty(spark, d):
    """KNN-3: mean RMS distance to the three nearest of other groups, flagged over the 95th percentile."""
    n = l.nearest_rows(vectors(spark, d).withColumn("u", l.unit("x")), "vec_id", "u", 3, "s")
    m = n.groupBy("a").agg(F.round(F.avg(F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0)) / 64)), 8).alias("novelty"))
    return m.join(F.broadcast(m.agg(F.percentile("novelty", F.lit(0.95)).alias("q")))).select("a", "novelty", (F.col("novelty") > F.col("q")).alias("flagged"))


_U2 = "(('0x' || substr(md5('{s}|' || {t}), 1, 12))::BIGINT / 281474976710656.0)"


@query("WITH g AS (SELECT l_orderkey % 13 AS g, sum(l_quantity) AS a, sum(l_linenumber * 6.5) AS b, count(*) AS n, row_number() OVER (ORDER BY l_orderkey % 13) - 1 AS i FROM lineitem GROUP BY 1), m AS (SELECT count(*) AS m FROM g), p AS (SELECT draw, floor(" + _U2.format(s="d", t="draw || '|' || slot") + " * m)::BIGINT AS i FROM m, range(0, 200) x(draw), range(0, 13) y(slot) WHERE slot < m), d AS (SELECT draw, (sum(a) - sum(b)) / sum(n) AS d FROM p JOIN g ON g.i = p.i GROUP BY draw) SELECT round(quantile_cont(d, 0.05), 6) AS low, round(quantile_cont(d, 0.95), 6) AS high, round(avg((d > 0)::INT), 6) AS p FROM d")
def sta_paired_delta(spark, d):
    """STA-3."""
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 13).alias("s"), F.col("l_quantity").alias("a"), (F.col("l_linenumber") * 6.5).alias("b"))
    return h.paired_delta(x, "s", "a", "b", 200, "d").select(*[F.round(c, 6).alias(c) for c in ("low", "high", "p")])


@query("WITH g AS (SELECT DISTINCT c_nationkey AS g, c_custkey % 4 AS y FROM customer), d AS (SELECT draw, g, y FROM g, range(1, 6) x(draw)), a AS (SELECT *, row_number() OVER (PARTITION BY draw, g ORDER BY y) AS r, row_number() OVER (PARTITION BY draw, g ORDER BY md5('r|' || draw || '|' || g || '|' || y), y) AS q FROM d) SELECT a.draw, a.g, a.y, b.y AS \"as\" FROM a JOIN a b ON a.draw = b.draw AND a.g = b.g AND a.r = b.q")
def sta_null_rename(spark, d):
    """STA-6: the classes of every group renamed among themselves."""
    x = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 4).alias("y"))
    return h.renamed_classes(x, "g", "y", 5, "r")


@query("WITH v AS (SELECT c_nationkey AS f, draw, round(avg(CASE WHEN draw = 0 THEN c_acctbal ELSE c_acctbal * (2 * " + _U2.format(s="m", t="draw || '|' || c_custkey") + " - 1) END), 6) AS v FROM customer, range(0, 41) x(draw) GROUP BY 1, 2), t AS (SELECT draw, max(v) AS top FROM v WHERE draw > 0 GROUP BY draw) SELECT f, v, round((count(*) FILTER (top >= v) + 1) / (count(*) + 1), 9) AS p FROM v, t WHERE v.draw = 0 GROUP BY f, v")
def sta_max_statistic(spark, d):
    """STA-9: family-wise p by the largest statistic of each draw."""
    x = table(spark, d, "customer").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(40))))
    v = F.when(F.col("draw") == 0, F.col("c_acctbal")).otherwise(F.col("c_acctbal") * (2 * o.md5_uniform(F.lit("m"), "draw", "c_custkey") - 1))
    s = x.groupBy(F.col("c_nationkey").alias("f"), "draw").agg(F.round(F.avg(v), 6).alias("v"))
    return h.max_statistic(s, "f", "draw", "v").withColumn("p", F.round("p", 9))


@query("WITH b AS (SELECT c_nationkey AS g, c_custkey AS k, c_acctbal AS v, (c_custkey % 3 = 0)::INT AS f FROM customer), n AS (SELECT g, sum(f) AS n1 FROM b GROUP BY g), r AS (SELECT draw, b.g, v, n1, row_number() OVER (PARTITION BY draw, b.g ORDER BY md5('w|' || draw || '|' || k), k) AS r FROM b JOIN n ON n.g = b.g, range(1, 31) x(draw)), s AS (SELECT draw, round(sum(v) FILTER (r <= n1), 6) AS s FROM r GROUP BY draw) SELECT round((count(*) FILTER (s >= (SELECT round(sum(v * f), 6) FROM b)) + 1) / (count(*) + 1), 9) AS p FROM s")
def sta_within_permutation(spark, d):
    """STA-5: flags dealt anew within each group only."""
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 3 == 0).cast("int").alias("f"))
    n = b.groupBy("g").agg(F.sum("f").alias("n1"))
    dealt = F.row_number().over(Window.partitionBy("draw", "g").orderBy(F.md5(F.concat_ws("|", F.lit("w"), F.col("draw").cast("string"), F.col("k").cast("string"))), "k"))
    x = b.join(n, "g").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("r", dealt)
    s = x.groupBy("draw").agg(F.round(F.sum(F.when(F.col("r") <= F.col("n1"), F.col("v"))), 6).alias("s"))
    seen = b.agg(F.round(F.sum(F.col("v") * F.col("f")), 6).alias("seen"))
    return s.join(F.broadcast(seen)).agg(F.round((F.count_if(F.col("s") >= F.col("seen")) + 1) / (F.count("*") + 1), 9).alias("p"))


@query(f"WITH {VEC}, e AS (SELECT y, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec), m AS (SELECT y, j, avg(sign(v) * abs(v) ** 3) AS m FROM e GROUP BY 1, 2) SELECT y, j, round(sign(m) * abs(m) ** (1 / 3.0::DOUBLE), 8) AS v FROM m")
def vec_generalised_mean(spark, d):
    """VEC-6."""
    return h.generalised_mean(vectors(spark, d), ["y"], "x").withColumn("v", F.round("v", 8))


@query(f"WITH {VEC}, e AS (SELECT vec_id, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec) SELECT vec_id, i, round(sum(v * CASE WHEN substr(md5('k|' || i || '|' || j), 1, 1) < '8' THEN 1 ELSE -1 END) / sqrt(8), 8) AS v FROM e, range(0, 8) r(i) GROUP BY 1, 2")
def vec_sketch(spark, d):
    """VEC-9: hashed signs."""
    s = h.sign_sketch(vectors(spark, d), "vec_id", "x", 64, 8, "k")
    return s.select("vec_id", F.posexplode("sketch").alias("i", "v")).withColumn("v", F.round("v", 8))


@query(f"WITH {VEC}, e AS (SELECT vec_id, s, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec), m AS (SELECT j, avg(v) AS m, stddev_pop(v) AS sd FROM e WHERE s <> 0 GROUP BY j) SELECT vec_id, e.j, round((v - m) / sd / sqrt(CASE WHEN e.j < 16 THEN 16 ELSE 48 END), 7) AS z FROM e JOIN m ON e.j = m.j")
def vec_blocks(spark, d):
    """VEC-2: two blocks of 16 and 48 columns, standardised and weighted by their width."""
    z = l.standardise(vectors(spark, d), "x", F.col("s") != 0).select("vec_id", F.posexplode("x").alias("j", "z"))
    return z.withColumn("z", F.round(F.col("z") / F.sqrt(F.when(F.col("j") < 16, 16).otherwise(48)), 7))


@query("WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem) SELECT g, round(corr(a, b), 8) AS rho FROM r GROUP BY g")
def xch_spearman(spark, d):
    """XCH-2: rank correlation through ranks of the distinct values."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_discount")
    x = o.average_rank(o.average_rank(li, ["g"], "l_quantity", "a"), ["g"], "l_discount", "b")
    return x.groupBy("g").agg(F.round(F.corr("a", "b"), 8).alias("rho"))


@query(f"WITH {PX}, q AS (SELECT img, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM px GROUP BY img) SELECT px.img, CASE WHEN v < -0.1 THEN 'void' WHEN v > 0.15 THEN 'bright' ELSE 'grey' END AS phase, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS sd, round(avg((v >= hi)::INT), 9) AS top, round(avg((v <= lo)::INT), 9) AS bottom FROM px JOIN q ON q.img = px.img GROUP BY 1, 2")
def xch_phase_stats(spark, d):
    """XCH-5, SEG-5: phases by precedence; mean, SD and the share in the top and bottom tenth of the image."""
    px = image(spark, d)
    q = px.groupBy("img").agg(F.percentile("v", F.lit(0.1)).alias("lo"), F.percentile("v", F.lit(0.9)).alias("hi"))
    phase = F.when(F.col("v") < -0.1, "void").when(F.col("v") > 0.15, "bright").otherwise("grey")
    return px.join(q, "img").groupBy("img", phase.alias("phase")).agg(F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_pop("v"), 9).alias("sd"), F.round(F.avg((F.col("v") >= F.col("hi")).cast("int")), 9).alias("top"), F.round(F.avg((F.col("v") <= F.col("lo")).cast("int")), 9).alias("bottom"))


@query(_KC + " SELECT a.y AS a, b.y AS b, round(list_cosine_similarity(a.c, b.c), 8) AS cosine FROM k a, k b WHERE a.y < b.y")
def xch_pooled_cosine(spark, d):
    """XCH-8: cosine between pooled vectors."""
    m = l.pooled(vectors(spark, d), ["y"], "x").select("y", l.unit("mean").alias("u"))
    return m.select(F.col("y").alias("a"), F.col("u").alias("p")).join(F.broadcast(m.select(F.col("y").alias("b"), F.col("u").alias("q"))), F.col("a") < F.col("b")).select("a", "b", F.round(l.dot("p", "q"), 8).alias("cosine"))


@query(f"WITH {PX} SELECT img, count(*) FILTER (v > 0.05) AS low, count(*) FILTER (v > 0.1) AS mid, count(*) FILTER (v > 0.15) AS high FROM px GROUP BY img")
def seg_bands(spark, d):
    """SEG-3: a mask at its lower, middle and upper threshold."""
    return image(spark, d).groupBy("img").agg(*[F.count_if(F.col("v") > t).alias(n) for n, t in (("low", 0.05), ("mid", 0.1), ("high", 0.15))])


@query(f"WITH {PX}, f AS (SELECT img, y, avg((abs(v) > 0.2)::INT) AS s FROM px GROUP BY 1, 2), k AS (SELECT img, min(y) AS a, max(y) AS b FROM f WHERE s < 0.3 GROUP BY img) SELECT px.img, count(*) AS n, any_value(a) AS first, any_value(b) AS last FROM px JOIN k ON k.img = px.img AND y BETWEEN a AND b GROUP BY px.img")
def src_border_trim(spark, d):
    """SRC-3: lines at the border go while too many of their pixels are extreme."""
    px = image(spark, d)
    f = px.groupBy("img", "y").agg(F.avg((F.abs("v") > 0.2).cast("int")).alias("s")).where("s < 0.3").groupBy("img").agg(F.min("y").alias("first"), F.max("y").alias("last"))
    return px.join(f, "img").where("y BETWEEN first AND last").groupBy("img", "first", "last").agg(F.count("*").alias("n"))


@query(f"WITH {PX}, t AS (SELECT img, y // 8 AS ty, x // 8 AS tx, avg((abs(v) > 0.2)::INT) AS extreme, stddev_pop(v) AS sd FROM px GROUP BY 1, 2, 3) SELECT img, ty, tx, extreme >= 0.2 OR sd < 0.1 AS blank FROM t")
def prj_blank_tiles(spark, d):
    """PRJ-18: tiles that are mostly extreme or flat."""
    x = image(spark, d).groupBy("img", F.floor(F.col("y") / 8).alias("ty"), F.floor(F.col("x") / 8).alias("tx")).agg(F.avg((F.abs("v") > 0.2).cast("int")).alias("e"), F.stddev_pop("v").alias("sd"))
    return x.select("img", "ty", "tx", ((F.col("e") >= 0.2) | (F.col("sd") < 0.1)).alias("blank"))


@query(f"WITH {PX}, s AS (SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM px, range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE v > 0.35 AND abs(dy) + abs(dx) <= 2) SELECT img, count(*) AS n FROM (SELECT img, y, x FROM px EXCEPT SELECT img, y, x FROM s) GROUP BY img")
def prj_valid_mask(spark, d):
    """PRJ-17: pixels that are neither saturated nor within two steps of one that is."""
    px = image(spark, d)
    halo = r.dilate(px.where("v > 0.35").select("img", "y", "x"), 2)
    return px.join(halo, ["img", "y", "x"], "left_anti").groupBy("img").agg(F.count("*").alias("n"))


@query(f"WITH {PX}, m AS (SELECT img, y, x FROM px WHERE v > 0.3), q AS (SELECT px.img, px.y, px.x, any_value(v) AS v, sqrt(min((px.y - m.y) ** 2 + (px.x - m.x) ** 2)) AS dist FROM px JOIN m ON px.img = m.img GROUP BY 1, 2, 3) SELECT img, count(*) FILTER (dist BETWEEN 1 AND 2) AS shell, round(avg((v > 0.1)::INT) FILTER (dist BETWEEN 1 AND 2) / avg((v > 0.1)::INT) FILTER (dist > 0), 8) AS enrichment FROM q GROUP BY img")
def dis_shell(spark, d):
    """DIS-4: the shell around a mask and how much of a phase it holds against chance."""
    px = image(spark, d)
    q = k.distance_to(px.select("img", "y", "x", (F.col("v") > 0.3).alias("m")), "m").join(px, ["img", "y", "x"])
    hit, shell = (F.col("v") > 0.1).cast("int"), F.col("dist").between(1, 2)
    return q.groupBy("img").agg(F.count_if(shell).alias("shell"), F.round(F.avg(F.when(shell, hit)) / F.avg(F.when(F.col("dist") > 0, hit)), 8).alias("enrichment"))


@query(f"WITH {PX}, m AS (SELECT img, y, x FROM px WHERE v > 0.3), q AS (SELECT px.img, px.y, px.x, any_value(v) AS v, round(sqrt(min((px.y - m.y) ** 2 + (px.x - m.x) ** 2)), 6) AS dist FROM px JOIN m ON px.img = m.img GROUP BY 1, 2, 3) SELECT ceil(dist)::BIGINT AS step, round(avg(v), 9) AS mean, count(*) AS n FROM q GROUP BY 1")
def dis_profile(spark, d):
    """DIS-3: the mean of a value against the distance from a boundary."""
    px = image(spark, d)
    q = k.distance_to(px.select("img", "y", "x", (F.col("v") > 0.3).alias("m")), "m").join(px, ["img", "y", "x"])
    return q.groupBy(F.ceil(F.round("dist", 6)).alias("step")).agg(F.round(F.avg("v"), 9).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {PX}, t AS (SELECT img, y // 4 AS ty, x // 4 AS tx, avg(v) AS m, var_pop(v) AS s FROM px GROUP BY 1, 2, 3) SELECT img, round(regr_slope(s, m), 8) AS gain FROM t GROUP BY img")
def tex_noise_gain(spark, d):
    """TEX-17: slope of the variance of small tiles against their level."""
    t = image(spark, d).groupBy("img", F.floor(F.col("y") / 4), F.floor(F.col("x") / 4)).agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    return t.groupBy("img").agg(F.round(F.regr_slope("s", "m"), 8).alias("gain"))


@query(f"WITH {PX}, c AS (SELECT img, count(*) FILTER (v > 0.3) AS n FROM px GROUP BY img), n AS (SELECT img, n, n / 1024.0 AS p FROM c) SELECT img, round(n / 40.96, 8) AS density, round(1.96 * sqrt(p * (1 - p) / 1024), 9) AS half FROM n")
def spa_density(spark, d):
    """SPA-2, SPA-11: pixels of a phase per 1000 square micrometres (0.2 um a pixel) and the half-width of its share."""
    n = image(spark, d).groupBy("img").agg(F.count_if(F.col("v") > 0.3).alias("n")).withColumn("p", F.col("n") / 1024)
    return n.select("img", F.round(F.col("n") / (1024 * 0.04) * 1, 8).alias("density"), F.round(1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / 1024), 9).alias("half"))


_HB = f"WITH {PX}, h AS (SELECT img, img % 2 AS side, least(greatest(floor((v + 0.5) * 32), 0), 31)::BIGINT AS bin FROM px), n AS (SELECT side, bin, count(*) AS n FROM h GROUP BY 1, 2)"


@query(_HB + ", a AS (SELECT sum(x.n * z.n * CASE WHEN x.bin > z.bin THEN 1 WHEN x.bin = z.bin THEN 0.5 ELSE 0 END) AS u FROM n x, n z WHERE x.side = 1 AND z.side = 0) SELECT round(u / ((SELECT sum(n) FROM n WHERE side = 1) * (SELECT sum(n) FROM n WHERE side = 0)), 9) AS auc FROM a")
def his_auc(spark, d):
    """HIS-11: area under the curve from two histograms, ties half."""
    b = r.histogram(image(spark, d).withColumn("side", F.col("img") % 2), ["side"], -0.5, 0.5, 32)
    x = b.groupBy("bin").pivot("side", [0, 1]).agg(F.sum("n")).na.fill(0)
    below = F.coalesce(F.sum("0").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a bin
    return x.withColumn("below", below).agg(F.round(F.sum(F.col("1") * (F.col("below") + F.col("0") / 2)) / (F.sum("1") * F.sum("0")), 9).alias("auc"))


@query(f"WITH {PX}, h AS (SELECT img, least(greatest(floor((v + 0.5) * 64), 0), 63)::BIGINT AS bin, count(*) AS n FROM px GROUP BY 1, 2), g AS (SELECT i.img, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT img FROM h) i CROSS JOIN range(16, 48) b(bin) LEFT JOIN h ON h.img = i.img AND h.bin = b.bin), w AS (SELECT *, lag(n) OVER o AS a, lead(n) OVER o AS c FROM g WINDOW o AS (PARTITION BY img ORDER BY bin)) SELECT img, round(avg((n = 0)::INT), 9) AS empty, round(avg((2 * n < a + c)::INT), 9) AS low, round(sum(abs(2 * n - a - c)) / sum(n), 9) AS ragged FROM w WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY img")
def his_comb(spark, d):
    """HIS-7: empty, low and ragged levels of a histogram between two codes."""
    n = r.histogram(image(spark, d), ["img"], -0.5, 0.5, 64)
    every = n.select("img").distinct().withColumn("bin", F.explode(F.sequence(F.lit(16).cast("bigint"), F.lit(47).cast("bigint"))))
    w = Window.partitionBy("img").orderBy("bin")
    g = every.join(n.select("img", F.col("bin").cast("bigint").alias("bin"), "n"), ["img", "bin"], "left").na.fill(0, ["n"]).withColumns({"a": F.lag("n").over(w), "c": F.lead("n").over(w)}).dropna(subset=["a", "c"])
    two, side = 2 * F.col("n"), F.col("a") + F.col("c")
    return g.groupBy("img").agg(F.round(F.avg((F.col("n") == 0).cast("int")), 9).alias("empty"), F.round(F.avg((two < side).cast("int")), 9).alias("low"), F.round(F.sum(F.abs(two - side)) / F.sum("n"), 9).alias("ragged"))


@query("WITH r AS (SELECT c_nationkey AS feature, c_custkey % 3 AS rule, CASE c_custkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' ELSE 'other' END AS kind FROM customer GROUP BY ALL), m AS (SELECT s_nationkey AS feature, round(avg(s_acctbal) / 10000, 6) AS trust FROM supplier WHERE s_nationkey < 12 GROUP BY 1) SELECT r.feature, rule, coalesce(trust, CASE kind WHEN 'strong' THEN 1.0 WHEN 'weak' THEN 0.3 END, 0.5)::DOUBLE AS trust FROM r LEFT JOIN m ON m.feature = r.feature")
def imp_trust(spark, d):
    """IMP-5: measured trust before the default of the kind."""
    k_ = F.col("c_custkey") % 3
    rules = table(spark, d, "customer").select(F.col("c_nationkey").alias("feature"), k_.alias("rule"), F.when(k_ == 0, "strong").when(k_ == 1, "weak").otherwise("other").alias("kind")).distinct()
    m = table(spark, d, "supplier").where("s_nationkey < 12").groupBy(F.col("s_nationkey").alias("feature")).agg(F.round(F.avg("s_acctbal") / 10000, 6).alias("trust"))
    return h.trust_weights(rules, m, "feature", {"strong": 1.0, "weak": 0.3}, "kind").select("feature", "rule", "trust")


_SC = "s AS (SELECT l_returnflag AS batch, l_linenumber AS concept, round(avg(l_quantity) / 25 - 1, 9) AS score FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_SC}, e AS (SELECT o_custkey % 7 + 1 AS concept, o_orderpriority AS outcome, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 9) AS consensus, CASE WHEN (o_custkey % 7) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM orders GROUP BY ALL), j AS (SELECT batch, outcome, CASE WHEN s.concept % 3 = 0 THEN -score ELSE score END * sign AS v, consensus * least(1, n / 5) AS w FROM s JOIN e ON e.concept = s.concept) SELECT batch, outcome, round(sum(v * w) / sum(w), 8) AS outlook FROM j GROUP BY 1, 2")
def imp_outlook(spark, d):
    """IMP-7: concept scores, inverse ones turned, times what the literature says and how sure it is."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("batch"), F.col("l_linenumber").alias("concept")).agg(F.round(F.avg("l_quantity") / 25 - 1, 9).alias("score"))
    c = F.col("o_custkey") % 7
    e = table(spark, d, "orders").groupBy((c + 1).alias("concept"), F.col("o_orderpriority").alias("outcome"), F.when(c % 2 == 0, 1).otherwise(-1).alias("sign")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 9).alias("consensus"))
    concepts = spark.range(1, 8).select(F.col("id").alias("concept"), (F.col("id") % 3 == 0).alias("inverse"))
    return h.outlook(s, concepts, e).withColumn("outlook", F.round("outlook", 8))


@query(f"WITH {LOTS}, m AS (SELECT lot, avg(q) AS m, stddev_samp(q) / sqrt(count(*)) AS s FROM t GROUP BY lot), d AS (SELECT draw, lot, round(m + s * sqrt(-2 * ln(" + _U2.format(s="x", t="draw || '|' || lot") + " + 1e-15)) * cos(2 * pi() * " + _U2.format(s="y", t="draw || '|' || lot") + "), 8) AS v FROM m, range(1, 401) z(draw)), b AS (SELECT draw, arg_min(lot, (-v, lot)) AS lot FROM d GROUP BY draw) SELECT lot, round(count(*) / 400, 9) AS p_best FROM b GROUP BY lot")
def imp_best_of(spark, d):
    """IMP-8: how often each lot is the best over shared draws."""
    from lamella.operators.records import hash_normal

    m = lots(spark, d).groupBy("lot").agg(F.avg("q").alias("m"), (F.stddev_samp("q") / F.sqrt(F.count("*"))).alias("s")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(400))))
    v = F.round(F.col("m") + F.col("s") * hash_normal(o.md5_uniform(F.lit("x"), "draw", "lot"), o.md5_uniform(F.lit("y"), "draw", "lot")), 8)
    return h.best_of(m.withColumn("v", v), "draw", "lot", "v").withColumn("p_best", F.round("p_best", 9))


@query(f"WITH {_SC}, p AS (SELECT * FROM (VALUES ('all', 0, 1.0), ('without 3', 3, 1.0), ('half of 1', 0, 0.5)) v(scenario, dropped, weight)) SELECT scenario, batch, round(sum(score * CASE WHEN concept = 1 THEN weight ELSE 1 END) / sum(CASE WHEN concept = 1 THEN weight ELSE 1 END), 8) AS score FROM s, p WHERE concept <> dropped GROUP BY 1, 2")
def imp_scenarios(spark, d):
    """IMP-9: the same scores under scenarios that drop a concept or weight one anew."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("batch"), F.col("l_linenumber").alias("concept")).agg(F.round(F.avg("l_quantity") / 25 - 1, 9).alias("score"))
    p = spark.createDataFrame([("all", 0, 1.0), ("without 3", 3, 1.0), ("half of 1", 0, 0.5)], "scenario string, dropped int, weight double")
    w = F.when(F.col("concept") == 1, F.col("weight")).otherwise(1.0)
    return s.join(F.broadcast(p)).where("concept <> dropped").groupBy("scenario", "batch").agg(F.round(F.sum(F.col("score") * w) / F.sum(w), 8).alias("score"))


@query(f"WITH {TILES}, t AS (SELECT batch, avg(porosity_frac) AS p, avg(si_solid_frac) AS s FROM tiles GROUP BY batch) SELECT batch, round(372 * (1 - s) + 3579 * s, 5) AS capacity, round((1 - p) * p ** -1.5, 6) AS resistance FROM t")
def imp_estimates(spark, d):
    """IMP-4: a capacity by mixture and a resistance by a power law, per batch; the constants are given ones."""
    t = tiles(spark, d).groupBy("batch").agg(F.avg("porosity_frac").alias("p"), F.avg("si_solid_frac").alias("s"))
    return t.select("batch", F.round(372 * (1 - F.col("s")) + 3579 * F.col("s"), 5).alias("capacity"), F.round((1 - F.col("p")) * F.pow("p", F.lit(-1.5)), 6).alias("resistance"))


@query("WITH c AS (SELECT DISTINCT event_type AS class FROM events), r AS (SELECT class, event_type = class AS pos, value * CASE WHEN event_type = class THEN 1.1 ELSE 1 END AS s FROM events, c), q AS (SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2 AS r FROM r), a AS (SELECT class, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc FROM q GROUP BY class) SELECT round(avg(auc), 9) AS macro_auc FROM a")
def met_macro_auc(spark, d):
    """MET-3: one class against the rest, ties half, averaged over the classes."""
    ev = table(spark, d, "events")
    x = ev.join(F.broadcast(ev.select(F.col("event_type").alias("class")).distinct())).withColumn("pos", F.col("event_type") == F.col("class"))
    x = o.average_rank(x.select("class", "pos", (F.col("value") * F.when(F.col("pos"), 1.1).otherwise(1)).alias("s")), ["class"], "s", "r")
    p = F.count_if("pos")
    a = x.groupBy("class").agg(((F.sum(F.when(F.col("pos"), F.col("r"))) - p * (p + 1) / 2) / (p * (F.count("*") - p))).alias("auc"))
    return a.agg(F.round(F.avg("auc"), 9).alias("macro_auc"))


_CROSS = "(VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dy, dx)"


@query(f"WITH {PX}, m AS (SELECT img, y, x FROM px WHERE v > 0.0), e AS (SELECT img, y + dy AS y, x + dx AS x FROM m, {_CROSS} GROUP BY 1, 2, 3 HAVING count(*) = 5) SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM e, {_CROSS}")
def mor_opening(spark, d):
    """MOR-1: erosion, then dilation."""
    return r.dilate(r.erode(image(spark, d).where("v > 0.0").select("img", "y", "x")))


@query(f"WITH {PX}, m AS (SELECT img, y, x FROM px WHERE v > 0.0), e AS (SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM m, {_CROSS}) SELECT img, y + dy AS y, x + dx AS x FROM e, {_CROSS} GROUP BY 1, 2, 3 HAVING count(*) = 5")
def mor_closing(spark, d):
    """MOR-1: dilation, then erosion."""
    return r.erode(r.dilate(image(spark, d).where("v > 0.0").select("img", "y", "x")))


@query(f"WITH {PX}, m AS (SELECT img, y, x, (v > 0.1)::INT AS m FROM px), c AS (SELECT img, abs(m - lag(m) OVER (PARTITION BY img, y ORDER BY x)) AS dx, abs(m - lag(m) OVER (PARTITION BY img, x ORDER BY y)) AS dy FROM m) SELECT img, round(pi() / 4 * (sum(dx) + sum(dy)) / count(*) / 0.2, 8) AS density FROM c GROUP BY img")
def spa_interface_density(spark, d):
    """SPA-3, SPA-4: interface length per area from line crossings times pi / 4, at 0.2 um a pixel."""
    c = r.crossings(image(spark, d), F.col("v") > 0.1)
    return c.select("img", F.round(F.pi() / 4 * (F.col("nx") + F.col("ny")) / F.col("n") / 0.2, 8).alias("density"))


@query(f"WITH {PX}, s AS (SELECT img, v * lead(v, 1) OVER w AS p1, v * lead(v, 3) OVER w AS p3, v FROM (SELECT img, y, x, v - avg(v) OVER (PARTITION BY img) AS v FROM px) WINDOW w AS (PARTITION BY img, y ORDER BY x)) SELECT img, round(avg(p1) / avg(v * v), 9) AS r1, round(avg(p3) / avg(v * v), 9) AS r3 FROM s GROUP BY img")
def tex_residual_correlation(spark, d):
    """TEX-15, SPA-9: autocorrelation of what is left of the image mean at two lags."""
    w, line = Window.partitionBy("img"), Window.partitionBy("img", "y").orderBy("x")
    x = image(spark, d).withColumn("d", F.col("v") - F.avg("v").over(w))
    x = x.withColumns({"p1": F.col("d") * F.lead("d", 1).over(line), "p3": F.col("d") * F.lead("d", 3).over(line)})
    q = F.avg(F.col("d") * F.col("d"))
    return x.groupBy("img").agg(F.round(F.avg("p1") / q, 9).alias("r1"), F.round(F.avg("p3") / q, 9).alias("r3"))


@query(f"WITH {PX}, s AS (SELECT a.img, g AS lag, avg(a.v * b.v) AS p FROM px a, range(-3, 4) l(g) JOIN px b ON b.img = a.img + 1 AND b.y = a.y AND b.x = a.x + g GROUP BY 1, 2) SELECT img, arg_max(lag, (round(p, 12), -lag)) AS shift, round(max(p), 9) AS peak FROM s GROUP BY img")
def xch_displacement(spark, d):
    """XCH-6: the shift of one image against the next at the peak of their products."""
    px = image(spark, d)
    a = px.select("img", "y", "x", F.col("v").alias("a")).withColumn("lag", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("xb", F.col("x") + F.col("lag"))
    b = px.select((F.col("img") - 1).alias("img"), "y", F.col("x").alias("xb"), F.col("v").alias("b"))
    s = a.join(b, ["img", "y", "xb"]).groupBy("img", "lag").agg(F.avg(F.col("a") * F.col("b")).alias("p"))
    return s.groupBy("img").agg(F.max_by("lag", F.struct(F.round("p", 12), -F.col("lag"))).alias("shift"), F.round(F.max("p"), 9).alias("peak"))


@query("WITH a AS (SELECT user_id, event_id, value, event_type, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT CASE WHEN b IS NULL THEN 'first' WHEN abs(value - b) < 50 THEN 'touching' WHEN sign(value - 100) = sign(b - 100) THEN 'same' ELSE 'other' END AS kind, count(*) AS n FROM a GROUP BY 1")
def joi_pair_kinds(spark, d):
    """JOI-8: neighbouring pairs by kind."""
    b = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = table(spark, d, "events").withColumn("b", b)
    kind = F.when(F.col("b").isNull(), "first").when(F.abs(F.col("value") - F.col("b")) < 50, "touching").when(F.signum(F.col("value") - 100) == F.signum(F.col("b") - 100), "same").otherwise("other")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))

"""More queries: probabilities, folds, binned quantiles, merges of sources, checks of names and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.operators import evaluation as e
from lamella.operators import learning as l
from lamella.operators import raster as r
from lamella.sources.tables import table

from .learning_queries import UNIT, vectors
from .raster_queries import PX, image
from .registry import query

_SCORES = f"""{UNIT}, m AS (SELECT y, j, avg(v) AS m FROM (SELECT y, unnest(range(0, 64)) AS j, unnest(x) AS v FROM vec) GROUP BY 1, 2), k AS (SELECT y AS class, list(m ORDER BY j) AS c FROM m GROUP BY y),
s AS (SELECT vec_id, y, class, list_dot_product(u, c) AS score FROM u, k)"""
_SOFT = ", x AS (SELECT *, exp((score - max(score) OVER w) / {t}) AS e FROM s WINDOW w AS (PARTITION BY vec_id)), q AS (SELECT *, greatest(e / sum(e) OVER (PARTITION BY vec_id), 1e-6) AS q FROM x), p AS (SELECT vec_id, y, class, q / sum(q) OVER (PARTITION BY vec_id) AS p FROM q)"


def scores(spark, d):
    """Scores of every row for each of the ten classes: the class means are packed in one row."""
    x = vectors(spark, d)
    c = l.pooled(x, ["y"], "x").agg(F.array_sort(F.collect_list(F.struct(F.col("y").alias("class"), F.col("mean").alias("c")))).alias("cs"))
    s = x.select("vec_id", "y", l.unit("x").alias("u")).join(F.broadcast(c)).withColumn("k", F.explode("cs"))
    return s.select("vec_id", "y", F.col("k.class").alias("class"), l.dot("u", "k.c").alias("score"))


@query(f"WITH {_SCORES}" + _SOFT.format(t=0.1) + " SELECT vec_id, class, round(p, 8) AS p FROM p")
def cv_softmax(spark, d):
    """CV-16."""
    return e.softmax(scores(spark, d), ["vec_id"], "score", 0.1).select("vec_id", "class", F.round("p", 8).alias("p"))


@query(f"WITH {_SCORES}" + _SOFT.format(t=0.1) + " SELECT round(-avg(ln(greatest(p, 1e-6))), 8) AS loss FROM p WHERE class = y")
def met_log_loss(spark, d):
    """MET-2."""
    return e.softmax(scores(spark, d), ["vec_id"], "score", 0.1).where("class = y").agg(F.round(e.log_loss(F.col("p")), 8).alias("loss"))


@query(f"WITH {_SCORES}, t AS (SELECT unnest([0.05, 0.1, 0.5]::DOUBLE[]) AS temperature), x AS (SELECT s.*, temperature, exp(score / temperature - max(score / temperature) OVER (PARTITION BY vec_id, temperature)) AS e FROM s, t), q AS (SELECT *, greatest(e / sum(e) OVER (PARTITION BY vec_id, temperature), 1e-6) AS q FROM x), p AS (SELECT *, q / sum(q) OVER (PARTITION BY vec_id, temperature) AS p FROM q) SELECT temperature, round(-avg(ln(greatest(p, 1e-6))), 8) AS loss FROM p WHERE class = y GROUP BY temperature")
def cv_temperature(spark, d):
    """CV-15."""
    return e.best_temperature(scores(spark, d), ["vec_id"], "class", "y", "score", [0.05, 0.1, 0.5]).withColumn("loss", F.round("loss", 8))


@query(f"WITH {_SCORES}, mm AS (SELECT vec_id, class, round(avg(score * w), 9) AS p FROM s, (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) v(w) GROUP BY 1, 2) SELECT vec_id, class AS call, p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS r FROM mm) WHERE r = 1")
def cv_ensemble(spark, d):
    """CV-21: two members that differ in scale."""
    s = scores(spark, d)
    m = s.select("vec_id", "class", F.col("score").alias("p")).unionByName(s.select("vec_id", "class", (F.col("score") * 0.5).alias("p")))
    m = m.groupBy("vec_id", "class").agg(F.round(F.avg("p"), 9).alias("p"))
    return e.ensemble(m, ["vec_id"], "class", "p")


@query(f"WITH {_SCORES}, c AS (SELECT vec_id, y, class AS call FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, class) AS r FROM s) WHERE r = 1), b AS (SELECT vec_id, class AS call FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, class) AS r FROM s) WHERE r = 2) SELECT CASE WHEN b.call = y AND c.call <> y THEN 'gained' WHEN c.call = y AND b.call <> y THEN 'lost' WHEN c.call = y THEN 'right' ELSE 'wrong' END AS state, count(*) AS n FROM c JOIN b ON c.vec_id = b.vec_id GROUP BY 1")
def met_changed_calls(spark, d):
    """MET-5: first against second choice."""
    s = scores(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(F.round("score", 9)), "class")))
    return e.changed_calls(s.where("r = 1"), s.where("r = 2"), "vec_id", "y", "class")


@query("WITH g AS (SELECT DISTINCT vec_id % 13 AS g FROM embeddings), p AS (SELECT a.g AS fold, b.g AS g, (row_number() OVER (PARTITION BY a.g ORDER BY md5(a.g || '|' || b.g)) - 1) % 3 AS i FROM g a JOIN g b ON a.g <> b.g) SELECT fold, n AS \"inner\", vec_id, CASE WHEN i = n THEN 'val' ELSE 'train' END AS role FROM p, (SELECT unnest([0, 1, 2]) AS n), embeddings WHERE vec_id % 13 = g")
def cv_nested_folds(spark, d):
    """CV-3: inner folds by session within each outer fold."""
    return e.nested_folds(vectors(spark, d), "vec_id", "s", 3)


@query("WITH f AS (SELECT DISTINCT vec_id % 13 AS fold FROM embeddings), a AS (SELECT fold, vec_id, CASE WHEN fold = vec_id % 13 THEN 'test' ELSE 'train' END AS role FROM f, embeddings) SELECT fold, vec_id, role FROM a WHERE role = 'test' OR NOT EXISTS (SELECT 1 FROM a t WHERE t.fold = a.fold AND t.role = 'test' AND abs(t.vec_id - a.vec_id) = 1)")
def cv_without_neighbours(spark, d):
    """CV-2: rows that touch a test row are not trained on."""
    x = vectors(spark, d)
    edges = x.select(F.col("vec_id").alias("src"), F.explode(F.array(F.col("vec_id") - 1, F.col("vec_id") + 1)).alias("dst"))
    return e.without_neighbours(l.group_folds(x, "vec_id", "s"), edges, "vec_id")


@query("WITH h AS (SELECT user_id, event_type, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1, 2) SELECT event_type, round(corr(a, b), 8) AS r, coalesce(corr(a, b) >= 0.5, false) AS trusted FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def met_split_half(spark, d):
    """MET-8, VEC-11: columns that agree between halves."""
    h = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return e.reliable_columns(h.dropna(subset=["a", "b"]), "event_type", "a", "b").withColumn("r", F.round("r", 8))


@query("WITH n AS (SELECT y, count(*) AS n FROM (SELECT label AS y FROM embeddings) GROUP BY y) SELECT y, round(least(greatest((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), 0.2), 5), 9) AS weight FROM n")
def dl_class_weights(spark, d):
    """DL-6: inverse-frequency class weights, clipped."""
    n = vectors(spark, d).groupBy("y").agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return n.join(F.broadcast(t)).select("y", F.round(F.least(F.greatest(F.col("t") / (F.col("k") * F.col("n")), F.lit(0.2)), F.lit(5.0)), 9).alias("weight"))


@query(f"WITH {PX}, h AS (SELECT img, least(greatest(floor((v + 0.5) * 32), 0), 31)::BIGINT AS bin, count(*) AS n FROM px GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY img) AS t FROM h), f AS (SELECT img, arg_min(struct_pack(bin, n, cum, t), bin) AS h FROM c WHERE cum >= 0.5 * t GROUP BY img) SELECT img, round(-0.5 + (h.bin + (0.5 * h.t - (h.cum - h.n)) / h.n) / 32, 9) AS q FROM f")
def agg_binned_quantile(spark, d):
    """AGG-14, HIS-10: the median of binned values with interpolation in the bin."""
    h = r.histogram(image(spark, d), ["img"], -0.5, 0.5, 32)
    w = Window.partitionBy("img")
    h = h.withColumns({"cum": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "t": F.sum("n").over(w)})
    at = -0.5 + (F.col("bin") + (0.5 * F.col("t") - (F.col("cum") - F.col("n"))) / F.col("n")) / 32
    return h.where("cum >= 0.5 * t").groupBy("img").agg(F.round(F.min_by(at, "bin"), 9).alias("q"))


@query(f"WITH {PX} SELECT img, y // 4 AS y, x // 4 AS x, bool_and(v > -0.25) AS all_on, avg((v > 0)::INT) >= 0.5 AS majority FROM px GROUP BY 1, 2, 3")
def ras_block_masks(spark, d):
    """RAS-6, RAS-7."""
    t = r.tiled(image(spark, d), 4)
    return t.groupBy("img", F.col("tr").alias("y"), F.col("tc").alias("x")).agg(F.bool_and(F.col("v") > -0.25).alias("all_on"), (F.avg((F.col("v") > 0).cast("int")) >= 0.5).alias("majority"))


@query(f"WITH {PX} SELECT img, y, x, v, least(greatest(floor((v + 0.5) * 8), 0), 7)::INT AS level FROM px WHERE y BETWEEN 4 AND 11 AND x BETWEEN 16 AND 47")
def ras_crop_quantise(spark, d):
    """RAS-1, RAS-17: a central crop at eight levels."""
    q = F.least(F.greatest(F.floor((F.col("v") + 0.5) * 8), F.lit(0)), F.lit(7)).cast("int")
    return image(spark, d).where("y BETWEEN 4 AND 11 AND x BETWEEN 16 AND 47").select("img", "y", "x", "v", q.alias("level"))


@query(f"WITH {PX}, t AS (SELECT oy, ox, img, avg(v) AS m FROM px, (SELECT unnest([0, 4, 8]) AS oy), (SELECT unnest([0, 16, 32, 48]) AS ox) WHERE y >= oy AND y < oy + 8 AND x >= ox AND x < ox + 16 GROUP BY 1, 2, 3) SELECT img, oy, ox, round(m, 9) AS m FROM t")
def ras_strided_tiles(spark, d):
    """RAS-3, RAS-4: overlapping tiles; each pixel is sent to the tiles that hold it."""
    inside = lambda c, size: lambda o: (o <= F.col(c)) & (F.col(c) < o + size)
    px = image(spark, d).withColumn("oy", F.explode(F.filter(F.array(*[F.lit(o) for o in (0, 4, 8)]), inside("y", 8)))).withColumn("ox", F.explode(F.filter(F.array(*[F.lit(o) for o in (0, 16, 32, 48)]), inside("x", 16))))
    return px.groupBy("img", "oy", "ox").agg(F.round(F.avg("v"), 9).alias("m"))


@query("WITH a AS (SELECT lower(trim(source)) AS k, year AS rank, relevance AS t FROM documents WHERE source IS NOT NULL) SELECT k, min(rank) AS first, count(*) AS n, array_to_string(list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)), ',') AS tiers FROM a GROUP BY k")
def joi_dedup_merge(spark, d):
    """JOI-16, LED-4: records of several feeds merged by a normalised key."""
    a = table(spark, d, "documents").where("source IS NOT NULL").select(F.lower(F.trim("source")).alias("k"), "year", "relevance")
    return a.groupBy("k").agg(F.min("year").alias("first"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("relevance")), ",").alias("tiers"))


@query("WITH w AS (SELECT space, string_split(space, '|') AS p FROM labelfree_spaces) SELECT space, list_has_any(list_transform(p, lambda t: regexp_replace(t, '[0-9]+$', '')), ['raw', 'harm']) AS forbidden FROM w")
def prj_forbidden_tokens(spark, d):
    """PRJ-9: names that hold a forbidden token, numbered forms included."""
    p = F.transform(F.split("space", r"\|"), lambda t: F.regexp_replace(t, "[0-9]+$", ""))
    return table(spark, d, "labelfree_spaces").select("space", F.arrays_overlap(p, F.array(F.lit("raw"), F.lit("harm"))).alias("forbidden"))


@query("SELECT user_id, round(least(greatest((avg(value) - 10) / 80, 0), 1), 9) AS position FROM events GROUP BY user_id")
def win_reference_position(spark, d):
    """WIN-11, IMP-10: a mean's place on a reference range."""
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.least(F.greatest((F.avg("value") - 10) / 80, F.lit(0.0)), F.lit(1.0)), 9).alias("position"))


@query("WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE r = floor(0.5 * (n - 1)) + 1")
def win_row_at_quantile(spark, d):
    """WIN-12: the row at the middle position."""
    w = Window.partitionBy("o_custkey")
    x = table(spark, d, "orders").withColumns({"r": F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")), "n": F.count("*").over(w)})
    return x.where(F.col("r") == F.floor(0.5 * (F.col("n") - 1)) + 1).select("o_custkey", "o_orderkey")


@query("WITH a AS (SELECT l_returnflag AS lot, l_orderkey % 13 AS s, l_quantity AS v FROM lineitem), m AS (SELECT *, median(v) OVER (PARTITION BY lot) AS m FROM a), z AS (SELECT lot, abs(v - m) AS z FROM m), g AS (SELECT lot, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY lot) SELECT round((sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) AS f FROM g")
def sta_brown_forsythe(spark, d):
    """STA-15: the F value of the spread test, from group sums of deviations from the medians."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("lot"), F.col("l_quantity").alias("v"))
    z = li.join(F.broadcast(li.groupBy("lot").agg(F.median("v").alias("m"))), "lot").withColumn("z", F.abs(F.col("v") - F.col("m")))
    g = z.groupBy("lot").agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    between = (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")) / (F.count("*") - 1)
    return g.agg(F.round(between / (F.sum(F.col("n") * F.col("v")) / (F.sum("n") - F.count("*"))), 6).alias("f"))

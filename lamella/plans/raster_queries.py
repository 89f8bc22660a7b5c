"""Queries of the raster operators; the embeddings table serves as images of 16 lines (img = vec_id // 16, y = vec_id % 16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import kernels as k
from lamella.operators import raster as r
from lamella.sources.tables import table

from .registry import query

PX = "px AS (SELECT vec_id // 16 AS img, vec_id % 16 AS y, unnest(range(0, 64)) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_ROW, _COL = "OVER (PARTITION BY img, y ORDER BY x)", "OVER (PARTITION BY img, x ORDER BY y)"
_N = (f", side AS (SELECT *, lag(v) {_ROW} AS l, lead(v) {_ROW} AS r FROM px), around AS (SELECT img, y, x, v, "
      + ", ".join(f"lag({c}) {_COL} AS n0{j}, {c} AS n1{j}, lead({c}) {_COL} AS n2{j}" for j, c in enumerate("lvr"))
      + " FROM side), nb AS (SELECT * FROM around WHERE " + " AND ".join(f"n{i}{j} IS NOT NULL" for i in range(3) for j in range(3)) + ")")


def image(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("_y", F.col("vec_id") % 16)
    return r.pixels(e, F.floor(F.col("vec_id") / 16), "_y", "embedding")


@query(f"WITH {PX} SELECT img, y // 4 AS y, x // 4 AS x, round(avg(v), 9) AS v FROM px GROUP BY 1, 2, 3")
def ras_block_mean(spark, d):
    """RAS-2, RAS-5."""
    return r.block_mean(image(spark, d), 4).withColumn("v", F.round("v", 9))


@query(f"WITH {PX}, q AS (SELECT img, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM px GROUP BY img) SELECT px.img, y, x, round(least(greatest((v - lo) / (hi - lo), 0), 1) * 255, 4) AS g FROM px JOIN q ON px.img = q.img")
def ras_percentile_stretch(spark, d):
    """RAS-8."""
    px = image(spark, d)
    q = px.groupBy("img").agg(F.percentile("v", F.lit(0.02)).alias("lo"), F.percentile("v", F.lit(0.98)).alias("hi"))
    return px.join(q, "img").select("img", "y", "x", F.round(F.least(F.greatest((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)) * 255, 4).alias("g"))


@query(f"WITH {PX}{_N} SELECT img, round(avg(abs(n00 - 2*n01 + n02 - 2*n10 + 4*n11 - 2*n12 + n20 - 2*n21 + n22)) * sqrt(pi() / 2) / 6, 9) AS sigma FROM nb GROUP BY img")
def ras_noise_sigma(spark, d):
    """RAS-11."""
    return r.noise_sigma(image(spark, d)).withColumn("sigma", F.round("sigma", 9))


@query(f"WITH {PX} SELECT img, bin, count(*) AS n FROM (SELECT img, least(greatest(floor((v + 0.5) * 32), 0), 31)::BIGINT AS bin FROM px) GROUP BY 1, 2")
def his_histogram(spark, d):
    """HIS-1."""
    return r.histogram(image(spark, d), ["img"], -0.5, 0.5, 32)


_H = f"WITH {PX}, h AS (SELECT img, bin, count(*) AS n FROM (SELECT img, least(greatest(floor((v + 0.5) * 32), 0), 31)::BIGINT AS bin FROM px) GROUP BY 1, 2)"


@query(_H + ", c AS (SELECT *, sum(n) OVER u AS w0, sum(n * bin) OVER u AS s0, sum(n) OVER (PARTITION BY img) AS w, sum(n * bin) OVER (PARTITION BY img) AS s FROM h WINDOW u AS (PARTITION BY img ORDER BY bin)), b AS (SELECT img, bin, w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2 AS g FROM c WHERE w > w0) SELECT img, bin AS level FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(g, 6) DESC, bin) AS n FROM b) WHERE n = 1")
def his_otsu(spark, d):
    """HIS-2."""
    return r.otsu(r.histogram(image(spark, d), ["img"], -0.5, 0.5, 32), ["img"])


@query(_H + " SELECT img, round(-sum(p * log2(p)), 9) AS bits, round(max(p), 9) AS top_share FROM (SELECT img, n / sum(n) OVER (PARTITION BY img) AS p FROM h) GROUP BY img")
def his_entropy(spark, d):
    """HIS-8."""
    return r.entropy(r.histogram(image(spark, d), ["img"], -0.5, 0.5, 32), ["img"]).select("img", F.round("bits", 9).alias("bits"), F.round("top_share", 9).alias("top_share"))


@query("WITH j AS (SELECT event_type AS a, user_id % 5 AS b, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT a, b, n / sum(n) OVER () AS p FROM j), m AS (SELECT *, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM p), h AS (SELECT (SELECT -sum(q * log2(q)) FROM (SELECT sum(p) AS q FROM p GROUP BY a)) AS ha, (SELECT -sum(q * log2(q)) FROM (SELECT sum(p) AS q FROM p GROUP BY b)) AS hb) SELECT round(sum(p * log2(p / (pa * pb))), 9) AS mi, round(sum(p * log2(p / (pa * pb))) / any_value(least(ha, hb)), 9) AS mi_norm FROM m, h")
def his_mutual_information(spark, d):
    """HIS-9."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("b"))
    return r.mutual_information(e, "event_type", "b").select(F.round("mi", 9).alias("mi"), F.round("mi_norm", 9).alias("mi_norm"))


@query(f"WITH {PX} SELECT img, round(avg(v), 9) AS m, round(stddev_pop(v), 9) AS sd, count(*) FILTER (v <= -0.3) / count(*) AS floor_share, count(*) FILTER (v >= 0.3) / count(*) AS ceiling_share FROM px GROUP BY img")
def his_level_statistics(spark, d):
    """HIS-6, TEX-18 in part."""
    return image(spark, d).groupBy("img").agg(F.round(F.avg("v"), 9).alias("m"), F.round(F.stddev_pop("v"), 9).alias("sd"), (F.count_if(F.col("v") <= -0.3) / F.count("*")).alias("floor_share"), (F.count_if(F.col("v") >= 0.3) / F.count("*")).alias("ceiling_share"))


_M = f"WITH {PX}, m AS (SELECT img, y, x FROM px WHERE v > 0.1)"


def _mask(spark, d):
    return image(spark, d).where("v > 0.1").select("img", "y", "x")


@query(_M + " SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM m, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dy, dx)")
def mor_dilate(spark, d):
    """MOR-1."""
    return r.dilate(_mask(spark, d))


@query(_M + " SELECT img, y + dy AS y, x + dx AS x FROM m, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dy, dx) GROUP BY 1, 2, 3 HAVING count(*) = 5")
def mor_erode(spark, d):
    """MOR-1."""
    return r.erode(_mask(spark, d))


@query(_M + " SELECT img, y, x FROM m EXCEPT (SELECT img, y + dy AS y, x + dx AS x FROM m, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dy, dx) GROUP BY 1, 2, 3 HAVING count(*) = 5)")
def mor_boundary(spark, d):
    """MOR-2, SPA-3."""
    return r.boundary(_mask(spark, d))


@query(f"WITH {PX}{_N} SELECT img, y, x, greatest(n00, n01, n02, n10, n11, n12, n20, n21, n22) AS high, least(n00, n01, n02, n10, n11, n12, n20, n21, n22) AS low, round((n00 + n01 + n02 + n10 + n11 + n12 + n20 + n21 + n22) / 9, 9) AS mean FROM nb")
def mor_grey_filters(spark, d):
    """MOR-3, inside the border."""
    n = [f"n{i}{j}" for i in range(3) for j in range(3)]
    x = r.neighbours(image(spark, d)).dropna(subset=n)
    return x.select("img", "y", "x", F.greatest(*n).alias("high"), F.least(*n).alias("low"), F.round(r.stencil([[1, 1, 1]] * 3) / 9, 9).alias("mean"))


@query(_M + ", s AS (SELECT m.img, (r.y IS NOT NULL)::INT AS r, (d.y IS NOT NULL)::INT AS d, (q.y IS NOT NULL)::INT AS q FROM m LEFT JOIN m r ON r.img = m.img AND r.y = m.y AND r.x = m.x + 1 LEFT JOIN m d ON d.img = m.img AND d.y = m.y + 1 AND d.x = m.x LEFT JOIN m q ON q.img = m.img AND q.y = m.y + 1 AND q.x = m.x + 1) SELECT img, (count(*) - sum(r) - sum(d) + sum(r * d * q))::BIGINT AS euler FROM s GROUP BY img")
def obj_euler(spark, d):
    """OBJ-15."""
    return r.euler_number(_mask(spark, d))


@query(f"""WITH RECURSIVE {PX}, m AS (SELECT img, y, x FROM px WHERE v > 0.1),
reach(img, y, x, ry, rx) AS (SELECT img, y, x, y, x FROM m UNION SELECT r.img, r.y, r.x, m.y, m.x FROM reach r JOIN m ON m.img = r.img AND abs(m.y - r.ry) + abs(m.x - r.rx) = 1),
l AS (SELECT img, y, x, min(ry * 64 + rx) AS label FROM reach GROUP BY 1, 2, 3)
SELECT img, label, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, bool_or(y IN (0, 15) OR x IN (0, 63)) AS touches FROM l GROUP BY 1, 2 HAVING count(*) >= 3""")
def obj_components(spark, d):
    """OBJ-1, OBJ-2, OBJ-4, OBJ-8: labels by union-find in an image, areas, boxes, border contact; small ones dropped."""
    l = k.label_components(_mask(spark, d), width=64)
    edge = F.col("y").isin(0, 15) | F.col("x").isin(0, 63)
    o = l.groupBy("img", "label").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.bool_or(edge).alias("touches"))
    return o.where("area >= 3")


@query()
def obj_moments(spark, d):
    """OBJ-5, OBJ-6: means, axes, aspect and angle of objects from their second moments."""
    l = k.label_components(_mask(spark, d), width=64).join(image(spark, d), ["img", "y", "x"])
    return k.object_shapes(l)


@query()
def obj_solidity(spark, d):
    """OBJ-7: area over the area of the convex hull."""
    return k.solidity(k.label_components(_mask(spark, d), width=64))


@query(f"WITH {PX}, m AS (SELECT img, y, x FROM px WHERE v > 0.3) SELECT px.img, px.y, px.x, round(sqrt(min((px.y - m.y) ** 2 + (px.x - m.x) ** 2)), 6) AS dist FROM px JOIN m ON px.img = m.img GROUP BY 1, 2, 3")
def dis_distance(spark, d):
    """DIS-1: exact distance to the nearest set pixel."""
    return k.distance_to(image(spark, d).select("img", "y", "x", (F.col("v") > 0.3).alias("m")), "m").select("img", "y", "x", F.round("dist", 6).alias("dist"))


@query(f"WITH {PX}, m AS (SELECT img, y, x, (v > 0.1)::INT AS m FROM px), c AS (SELECT img, m, abs(m - lag(m) OVER (PARTITION BY img, y ORDER BY x)) AS dx, abs(m - lag(m) OVER (PARTITION BY img, x ORDER BY y)) AS dy FROM m) SELECT img, sum(dx)::BIGINT AS nx, sum(dy)::BIGINT AS ny, sum(m)::BIGINT AS area, count(*) AS n FROM c GROUP BY img")
def spa_crossings(spark, d):
    """SPA-1, SPA-4."""
    return r.crossings(image(spark, d), F.col("v") > 0.1)


@query(f"WITH {PX}, m AS (SELECT img, y, x, v > 0.1 AS m FROM px), c AS (SELECT *, (lag(m) OVER (PARTITION BY img, y ORDER BY x) IS DISTINCT FROM m)::INT AS c FROM m), r AS (SELECT *, sum(c) OVER (PARTITION BY img, y ORDER BY x) AS run FROM c), l AS (SELECT img, y, run, count(*) AS length FROM r WHERE m GROUP BY 1, 2, 3) SELECT img, count(*) AS chords, round(avg(length), 9) AS mean, max(length) AS longest FROM l GROUP BY img")
def spa_chords(spark, d):
    """SPA-5, SPA-7."""
    return r.chords(image(spark, d), F.col("v") > 0.1).groupBy("img").agg(F.count("*").alias("chords"), F.round(F.avg("length"), 9).alias("mean"), F.max("length").alias("longest"))


@query(f"WITH {PX} SELECT a.img, r, round(avg((a.v > 0.1 AND b.v > 0.1)::INT), 9) AS s2 FROM px a JOIN (VALUES (0), (1), (2), (4), (8)) l(r) ON true JOIN px b ON b.img = a.img AND b.y = a.y AND b.x = a.x + r GROUP BY 1, 2")
def spa_two_point(spark, d):
    """SPA-8."""
    return r.two_point(image(spark, d), F.col("v") > 0.1, [0, 1, 2, 4, 8]).withColumn("s2", F.round("s2", 9))


@query(f"WITH {PX}, b AS (SELECT img, y // 4 AS y, x // 4 AS x, avg(v + 1) AS v FROM px GROUP BY 1, 2, 3) SELECT img, round(stddev_pop(v) / avg(v), 9) AS cv FROM b GROUP BY img")
def spa_block_cv(spark, d):
    """SPA-12."""
    b = r.block_mean(image(spark, d).withColumn("v", F.col("v") + 1), 4)
    return b.groupBy("img").agg(F.round(F.stddev_pop("v") / F.avg("v"), 9).alias("cv"))


@query(f"WITH {PX} SELECT a.img, a.y, a.x, round(avg((b.v > 0.1)::INT), 9) AS share FROM px a JOIN px b ON b.img = a.img AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2 GROUP BY 1, 2, 3")
def win_window_fraction(spark, d):
    """WIN-9, SPA-14: two window sums in place of a prefix-sum image."""
    return r.window_fraction(image(spark, d), F.col("v") > 0.1, 2).withColumn("share", F.round("share", 9))


_G = f"WITH {PX}, q AS (SELECT img, y, x, least(greatest(floor((v + 0.4) / 0.8 * 8), 0), 7)::INT AS i FROM px), p AS (SELECT a.img, a.i, b.i AS j FROM q a JOIN q b ON b.img = a.img AND b.y = a.y AND b.x = a.x + 1), s AS (SELECT img, i, j FROM p UNION ALL SELECT img, j, i FROM p), c AS (SELECT img, i, j, count(*) AS n FROM s GROUP BY 1, 2, 3)"


@query(_G + " FROM c")
def tex_co_occurrence(spark, d):
    """TEX-1 in part: one step to the right."""
    return r.co_occurrence(image(spark, d), 8, -0.4, 0.4, 0, 1)


@query(_G + ", w AS (SELECT *, n / sum(n) OVER (PARTITION BY img) AS p FROM c), u AS (SELECT *, sum(p * i) OVER (PARTITION BY img) AS mu FROM w) SELECT img, round(sum(p * (i - j) ** 2), 9) AS contrast, round(sum(p / (1 + (i - j) ** 2)), 9) AS homogeneity, round(sqrt(sum(p * p)), 9) AS energy, round(sum(p * (i - mu) * (j - mu)) / sum(p * (i - mu) ** 2), 9) AS correlation FROM u GROUP BY img")
def tex_glcm(spark, d):
    """TEX-2."""
    return r.glcm_properties(r.co_occurrence(image(spark, d), 8, -0.4, 0.4, 0, 1)).select("img", *[F.round(c, 9).alias(c) for c in ("contrast", "homogeneity", "energy", "correlation")])


@query(f"WITH {PX}{_N}, b AS (SELECT img, [(n12 >= n11)::INT, (n02 >= n11)::INT, (n01 >= n11)::INT, (n00 >= n11)::INT, (n10 >= n11)::INT, (n20 >= n11)::INT, (n21 >= n11)::INT, (n22 >= n11)::INT] AS b FROM nb), u AS (SELECT img, list_sum(b) AS ones, list_sum(list_transform(range(1, 9), lambda i: abs(b[i] - b[i % 8 + 1]))) AS turns FROM b) SELECT img, CASE WHEN turns <= 2 THEN ones ELSE 9 END::INT AS code, count(*) AS n FROM u GROUP BY 1, 2")
def tex_lbp(spark, d):
    """TEX-3."""
    return r.lbp_histogram(image(spark, d))


@query(f"WITH {PX}{_N} SELECT img, round(var_pop(n01 + n10 - 4 * n11 + n12 + n21), 9) AS focus, round(avg((n02 + 2*n12 + n22 - n00 - 2*n10 - n20) ** 2 + (n20 + 2*n21 + n22 - n00 - 2*n01 - n02) ** 2), 9) AS sobel FROM nb GROUP BY img")
def tex_focus(spark, d):
    """TEX-12, TEX-13."""
    n = r.neighbours(image(spark, d)).dropna(subset=[f"n{i}{j}" for i in range(3) for j in range(3)])
    gx, gy = r.stencil([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]), r.stencil([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    return n.groupBy("img").agg(F.round(F.var_pop(r.stencil([[0, 1, 0], [1, -4, 1], [0, 1, 0]])), 9).alias("focus"), F.round(F.avg(gx * gx + gy * gy), 9).alias("sobel"))


@query(f"WITH {PX}, m AS (SELECT *, avg(v) OVER (PARTITION BY img) AS m, stddev_pop(v) OVER (PARTITION BY img) AS s FROM px) SELECT img, round(avg(((v - m) / s) ** 3), 8) AS skew, round(avg(((v - m) / s) ** 4) - 3, 8) AS kurt, round(quantile_cont(v, 0.01), 9) AS p1, round(quantile_cont(v, 0.99), 9) AS p99 FROM m GROUP BY img")
def tex_moments(spark, d):
    """TEX-18."""
    return image(spark, d).groupBy("img").agg(F.round(F.skewness("v"), 8).alias("skew"), F.round(F.kurtosis("v"), 8).alias("kurt"), F.round(F.percentile("v", F.lit(0.01)), 9).alias("p1"), F.round(F.percentile("v", F.lit(0.99)), 9).alias("p99"))


@query(f"WITH {PX} SELECT img, round(regr_slope(m, b), 9) AS slope FROM (SELECT img, y // 4 AS b, median(v) AS m FROM px GROUP BY 1, 2) GROUP BY img")
def tex_level_drift(spark, d):
    """TEX-16, SPA-19 in part: slope of band medians."""
    b = image(spark, d).groupBy("img", F.floor(F.col("y") / 4).alias("b")).agg(F.median("v").alias("m"))
    return b.groupBy("img").agg(F.round(F.regr_slope("m", "b"), 9).alias("slope"))


@query(f"WITH {PX}, p AS (SELECT a.img, a.y // 4 AS tr, a.x // 16 AS tc, a.v AS a, b.v AS b FROM px a JOIN px b ON b.img = a.img AND b.y = a.y AND b.x = a.x + 1) SELECT img, tr, tc, round(coalesce(corr(a, b), 0), 9) AS r FROM p GROUP BY 1, 2, 3")
def xch_tile_pearson(spark, d):
    """XCH-1, XCH-3: correlation of two co-registered planes by tile; the second plane is the first one shifted by a pixel."""
    a = image(spark, d)
    b = a.select("img", "y", (F.col("x") - 1).alias("x"), F.col("v").alias("w"))
    p = a.join(b, ["img", "y", "x"])
    return p.groupBy("img", F.floor(F.col("y") / 4).alias("tr"), F.floor(F.col("x") / 16).alias("tc")).agg(F.round(F.coalesce(F.corr("v", "w"), F.lit(0.0)), 9).alias("r"))


@query()
def tex_periodogram(spark, d):
    """TEX-5, TEX-6: ring means of the windowed power spectrum of each image and the spectral slope."""
    return k.periodogram(image(spark, d))


_REFLECT = "CASE WHEN ({c} + i + 12 * {n}) % (2 * {n}) < {n} THEN ({c} + i + 12 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - ({c} + i + 12 * {n}) % (2 * {n}) END"


@query(f"""WITH {PX}, w AS (SELECT i, exp(-0.5 * (i / 1.5::DOUBLE) ** 2) / (SELECT sum(exp(-0.5 * (j / 1.5::DOUBLE) ** 2)) FROM range(-6, 7) r(j)) AS w FROM range(-6, 7) r(i)), h AS (SELECT img, max(y) + 1 AS h FROM px GROUP BY img),
a AS (SELECT o.img, o.y, o.x, sum(w * p.v) AS v FROM px o JOIN h ON h.img = o.img, w JOIN px p ON p.img = o.img AND p.x = o.x AND p.y = {_REFLECT.format(c='o.y', n='h.h')} GROUP BY 1, 2, 3)
SELECT o.img, o.y, o.x, round(sum(w * p.v), 9) AS v FROM a o, w JOIN a p ON p.img = o.img AND p.y = o.y AND p.x = {_REFLECT.format(c='o.x', n='64')} GROUP BY 1, 2, 3""")
def ras_gaussian(spark, d):
    """RAS-10: separable Gaussian blur with reflected borders."""
    return k.gaussian(image(spark, d), 1.5).withColumn("v", F.round("v", 9))


@query()
def spa_orientation(spark, d):
    """SPA-18: structure tensor: mean direction, order and coherence."""
    return k.orientation(image(spark, d), 1.0)

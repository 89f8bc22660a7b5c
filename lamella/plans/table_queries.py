"""Queries of the table, aggregation and window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.operators import ordered as o
from lamella.operators import tables as t
from lamella.sources.tables import table

from .registry import query

FEATURES = ("porosity_frac", "si_solid_frac", "si_n_per_1000um2", "si_d50_um", "si_d90_um", "si_aspect_aw", "si_agglom_d50_um", "interface_density_per_um", "pore_n_per_1000um2", "solid_chord_x_um", "solid_chord_y_um", "porosity_block_cv", "si_block_cv")
_CLEAN = ", ".join(f"CASE WHEN {c}::VARCHAR <> 'nan' THEN {c} END AS {c}" for c in FEATURES)
TILES = f"tiles AS (SELECT tile_id, batch, sample_id, scan, session, row, col, {_CLEAN} FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY loaded_at DESC) AS _n FROM tile_features) WHERE _n = 1)"


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tile features, one delivery a tile, NaN as null."""
    return t.nan_to_null(t.latest(table(spark, d, "tile_features"), ["tile_id"], "loaded_at")).drop("loaded_at")


@query(f"WITH {TILES} SELECT batch, sample_id, " + ", ".join(f"round(avg({c}), 9) AS {c}" for c in FEATURES) + ", count(*) AS n_tiles FROM tiles GROUP BY batch, sample_id")
def agg_spot_rollup(spark, d):
    """AGG-1, AGG-2: the mean of every feature by spot, with the number of tiles."""
    return tiles(spark, d).groupBy("batch", "sample_id").agg(*[F.round(F.avg(c), 9).alias(c) for c in FEATURES], F.count("*").alias("n_tiles"))


@query(f"WITH {TILES} SELECT scan, round(median(porosity_frac), 6) AS med, count(DISTINCT sample_id) AS n_spots, count(DISTINCT sample_id) > 1 AS several, bool_and(porosity_frac >= 0) AS all_ok, bool_or(porosity_frac > 0.3) AS any_high FROM tiles GROUP BY scan")
def agg_median_distinct_bool(spark, d):
    """AGG-3, AGG-5, AGG-21."""
    return tiles(spark, d).groupBy("scan").agg(F.round(F.median("porosity_frac"), 6).alias("med"), F.countDistinct("sample_id").alias("n_spots"), (F.countDistinct("sample_id") > 1).alias("several"), F.bool_and(F.col("porosity_frac") >= 0).alias("all_ok"), F.bool_or(F.col("porosity_frac") > 0.3).alias("any_high"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def agg_value_counts(spark, d):
    """AGG-4, AGG-19."""
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def agg_first_per_key(spark, d):
    """AGG-6 with an explicit order."""
    return o.top_k(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id")
def agg_sorted_set(spark, d):
    """AGG-7."""
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("SELECT coalesce(l_returnflag, 'all') AS flag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o, count(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def agg_pivot_margins(spark, d):
    """AGG-8: counts by two factors with margins."""
    c = lambda s: F.count_if(F.col("l_linestatus") == s)
    return table(spark, d, "lineitem").rollup("l_returnflag").agg(c("F").alias("f"), c("O").alias("o"), F.count("*").alias("total")).select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), "f", "o", "total")


@query(f"WITH {TILES} SELECT name, round(avg(v) FILTER (scan = 1), 6) AS s1, round(avg(v) FILTER (scan = 2), 6) AS s2 FROM (UNPIVOT (SELECT scan, {', '.join(FEATURES[:4])} FROM tiles) ON {', '.join(FEATURES[:4])} INTO NAME name VALUE v) GROUP BY name")
def agg_transposed_means(spark, d):
    """AGG-9: features as rows, scans as columns."""
    long = t.unpivot(tiles(spark, d), ["scan"], FEATURES[:4], value="v")
    m = lambda s: F.round(F.avg(F.when(F.col("scan") == s, F.col("v"))), 6)
    return long.groupBy("name").agg(m(1).alias("s1"), m(2).alias("s2"))


@query(f"WITH {TILES} SELECT scan, name, round(avg(v), 9) AS mean FROM (UNPIVOT (SELECT scan, {', '.join(FEATURES)} FROM tiles) ON {', '.join(FEATURES)} INTO NAME name VALUE v) WHERE v IS NOT NULL GROUP BY scan, name")
def agg_means_by_scan(spark, d):
    """AGG-9 over all features and all scans, in long form; a feature without values in a scan has no row."""
    long = t.unpivot(tiles(spark, d), ["scan"], list(FEATURES), value="v").where("v IS NOT NULL")
    return long.groupBy("scan", "name").agg(F.round(F.avg("v"), 9).alias("mean"))


_WQ = """, g AS (SELECT l_returnflag AS k, l_discount AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) AS cum, sum(w) OVER (PARTITION BY k) AS total FROM g),
r AS (SELECT k, v, {p} AS p FROM c), l AS (SELECT *, lag(p) OVER (PARTITION BY k ORDER BY v) AS p0, lag(v) OVER (PARTITION BY k ORDER BY v) AS v0 FROM r)
SELECT k AS l_returnflag, round(arg_min(CASE WHEN p0 IS NULL THEN v ELSE v0 + (v - v0) * ({q} - p0) / (p - p0) END, p), 6) AS quantile FROM l WHERE p >= {q} GROUP BY k"""


@query("WITH z AS (SELECT 1)" + _WQ.format(p="cum / total", q=0.4))
def agg_weighted_quantile_right(spark, d):
    """AGG-10."""
    return o.weighted_quantile(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", 0.4).withColumn("quantile", F.round("quantile", 6))


@query("WITH z AS (SELECT 1)" + _WQ.format(p="(cum - w / 2) / total", q=0.4))
def agg_weighted_quantile_mid(spark, d):
    """AGG-11."""
    return o.weighted_quantile(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", 0.4, "mid").withColumn("quantile", F.round("quantile", 6))


@query("WITH g AS (SELECT l_returnflag, l_discount AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM g) SELECT l_returnflag, min(v) AS quantile FROM c WHERE cum >= total * 0.5 GROUP BY l_returnflag")
def agg_weighted_median(spark, d):
    """AGG-12."""
    return o.weighted_quantile(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", 0.5, "left")


@query("SELECT l_suppkey % 7 AS k, round(sum(l_quantity * least(l_extendedprice, 30000)) / sum(l_quantity), 4) AS m FROM lineitem GROUP BY 1")
def agg_capped_mean(spark, d):
    """AGG-13."""
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("k")).agg(F.round(o.capped_mean(F.col("l_extendedprice"), F.col("l_quantity"), 30000.0), 4).alias("m"))


@query("SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY event_type")
def agg_five_numbers(spark, d):
    """AGG-15."""
    return o.five_numbers(table(spark, d, "events"), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("q1", "mid", "q3")})


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS m FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def agg_marginal_means(spark, d):
    """AGG-17: one grouping a factor in a single pass."""
    li = table(spark, d, "lineitem")
    return li.groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("m"))


@query(f"WITH {TILES} SELECT sample_id, count(*) AS expected, count(porosity_frac) AS done, count(*) FILTER (si_d50_um IS NULL) AS missing_d50 FROM tiles GROUP BY sample_id")
def agg_completeness(spark, d):
    """AGG-18."""
    return tiles(spark, d).groupBy("sample_id").agg(F.count("*").alias("expected"), F.count("porosity_frac").alias("done"), F.count_if(F.col("si_d50_um").isNull()).alias("missing_d50"))


@query("SELECT o_custkey, max(o_totalprice) AS best, arg_max(o_orderkey, o_totalprice) AS best_order FROM orders GROUP BY o_custkey")
def agg_arg_max(spark, d):
    """AGG-22."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.max_by("o_orderkey", "o_totalprice").alias("best_order"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    """AGG-23."""
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query()
def agg_sketches(spark, d):
    """AGG-23: approximate distinct counts and quantiles by mergeable sketches."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("orders"), F.approx_percentile("l_quantity", F.lit(0.5)).alias("mid"))


# --- projections -------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS ratio, greatest(least(l_quantity, 40), 10) AS clipped, CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 'inside' WHEN l_quantity BETWEEN 5 AND 45 THEN 'extrapolated' ELSE 'outside' END AS band FROM lineitem")
def prj_ratio_clip_band(spark, d):
    """PRJ-4, PRJ-14, PRJ-15."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(t.ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"), t.clip(F.col("l_quantity"), 10, 40).alias("clipped"), t.band(F.col("l_quantity"), (10, 40), (5, 45)).alias("band"))


@query("WITH s AS (SELECT l_orderkey, max(CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 0 WHEN l_quantity BETWEEN 5 AND 45 THEN 1 ELSE 2 END) AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE r WHEN 0 THEN 'inside' WHEN 1 THEN 'extrapolated' ELSE 'outside' END AS status FROM s")
def prj_worst_status(spark, d):
    """PRJ-15, PRJ-16: the worst state of an order."""
    return t.worst(table(spark, d, "lineitem").select("l_orderkey", t.band(F.col("l_quantity"), (10, 40), (5, 45)).alias("s")), "l_orderkey", "s")


@query(f"WITH {TILES}, f AS (SELECT avg(si_d50_um) AS a, median(si_d90_um) AS m FROM tiles) SELECT tile_id, round(coalesce(si_d50_um, a), 6) AS d50, round(coalesce(si_d90_um, m), 6) AS d90 FROM tiles, f")
def prj_impute(spark, d):
    """PRJ-5, PRJ-6."""
    x = t.impute(t.impute(tiles(spark, d), ["si_d50_um"]), ["si_d90_um"], "median")
    return x.select("tile_id", F.round("si_d50_um", 6).alias("d50"), F.round("si_d90_um", 6).alias("d90"))


@query(f"WITH {TILES}, l AS (UNPIVOT (SELECT tile_id, {', '.join(f'coalesce({c}, -1) AS {c}' for c in FEATURES[:5])}, 1.0::DOUBLE AS one FROM tiles WHERE porosity_frac IS NOT NULL) ON {', '.join(FEATURES[:5])}, one INTO NAME name VALUE v) SELECT name FROM l GROUP BY name HAVING bool_and(v IS NOT NULL AND isfinite(v)) AND stddev_pop(v) > 1e-12")
def prj_complete_names(spark, d):
    """PRJ-7, PRJ-8."""
    x = tiles(spark, d).where("porosity_frac IS NOT NULL").withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in FEATURES[:5]}).withColumn("one", F.lit(1.0))
    return t.complete_names(t.unpivot(x, ["tile_id"], [*FEATURES[:5], "one"]))


@query("SELECT space, split_part(space, '|', 1) AS family, split_part(space, '|', 2) AS detector, split_part(space, '|', 3) AS view, try_cast(split_part(space, '|', 4) AS INT) AS scale_nm, CASE WHEN detector = 'BSE' THEN 'risk' ELSE tag END AS tag FROM labelfree_spaces")
def prj_name_parse(spark, d):
    """PRJ-11, PRJ-13: names hold family, detector, view and scale; one detector overrides the tag."""
    p = F.split("space", r"\|")
    return table(spark, d, "labelfree_spaces").select("space", p[0].alias("family"), p[1].alias("detector_"), p[2].alias("view"), p[3].try_cast("int").alias("scale_nm"), F.when(F.col("detector") == "BSE", "risk").otherwise(F.col("tag")).alias("tag")).withColumnRenamed("detector_", "detector")


@query("SELECT n.n_name, p.pert FROM nation n, (VALUES ('P0', 0), ('gain', 1), ('erode', 2)) p(pert, least) WHERE n.n_nationkey >= p.least * 5")
def prj_version_expansion(spark, d):
    """PRJ-12: keys by versions, where a version needs a key of a certain range."""
    p = spark.createDataFrame([("P0", 0), ("gain", 1), ("erode", 2)], "pert string, least int")
    return table(spark, d, "nation").join(F.broadcast(p), F.col("n_nationkey") >= F.col("least") * 5).select("n_name", "pert")


# --- joins and sets ----------------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT o_orderkey, o_custkey FROM orders), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, o_custkey, n FROM c JOIN l ON o_orderkey = l_orderkey")
def joi_one_to_one(spark, d):
    """JOI-3: a join that fails on duplicate keys."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.one_to_one(table(spark, d, "orders").select("o_orderkey", "o_custkey"), l, ["o_orderkey"])


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def joi_lookup(spark, d):
    """JOI-1, JOI-4, JOI-10: lookups in small tables."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT DISTINCT crop FROM design WHERE crop NOT IN (SELECT site FROM analysis_only WHERE site IS NOT NULL AND chain_order IS NOT NULL)")
def joi_gaps(spark, d):
    """JOI-6, SRC-9: keys still to be done."""
    return t.gaps(table(spark, d, "design").where("crop IS NOT NULL"), table(spark, d, "analysis_only").where("chain_order IS NOT NULL").select(F.col("site").alias("crop")), ["crop"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def joi_semi(spark, d):
    """JOI-7."""
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'same' ELSE 'different' END AS kind FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def joi_pairs(spark, d):
    """JOI-8: all pairs of a fixed small table, by kind."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    a, b = n.toDF("ka", "a", "ra"), n.toDF("kb", "b", "rb")
    return a.join(b, F.col("ka") < F.col("kb")).select("a", "b", F.when(F.col("ra") == F.col("rb"), "same").otherwise("different").alias("kind"))


@query("WITH c AS (SELECT o_custkey, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders), e AS (SELECT src, dst FROM c WHERE dst IS NOT NULL UNION SELECT dst, src FROM c WHERE dst IS NOT NULL), k AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 50000) SELECT src, dst FROM e WHERE src IN (FROM k) AND dst IN (FROM k)")
def joi_symmetric(spark, d):
    """JOI-14: both directions of the edges between known nodes."""
    od = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = od.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst IS NOT NULL")
    return t.symmetric(e, od.where("o_totalprice > 50000").select(F.col("o_orderkey").alias("node")))


@query("SELECT e.event_id, (SELECT arg_max(p.value, p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'click'")
def joi_as_of(spark, d):
    """JOI-17: the last purchase at or before each click, by one window."""
    e = table(spark, d, "events")
    return t.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'"), "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")


@query("SELECT l_orderkey, l_linenumber, s.name FROM lineitem JOIN (VALUES ('low', 0, 12), ('mid', 10, 35), ('high', 30, 60)) s(name, a, b) ON l_quantity >= a AND l_quantity < b")
def joi_interval(spark, d):
    """JOI-17: overlapping intervals as an equi-join of bins."""
    s = spark.createDataFrame([("low", 0, 12), ("mid", 10, 35), ("high", 30, 60)], "name string, a int, b int")
    return t.interval_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), s, "l_quantity", "a", "b", 10).select("l_orderkey", "l_linenumber", "name")


@query("WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_totalprice > 100000 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k")
def joi_merge_keep(spark, d):
    """JOI-15."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "orders").where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("w"))
    return a.join(b, "k", "full").select("k", F.coalesce("w", "v").alias("v"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) UNION ALL SELECT o_orderkey, o_custkey, 0.0 FROM orders WHERE o_totalprice > 200000")
def src_upsert(spark, d):
    """SRC-6: recomputed keys replace the old rows."""
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return t.upsert(old, old.where("o_totalprice > 200000").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


@query("SELECT tile_id, sample_id, scan, row, col, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY loaded_at DESC) AS n FROM tile_features) WHERE n = 1")
def src_latest_delivery(spark, d):
    """One row a key, the delivery that arrived last."""
    return t.latest(table(spark, d, "tile_features"), ["tile_id"], "loaded_at").select("tile_id", "sample_id", "scan", "row", "col", "loaded_at")


@query("SELECT DISTINCT crop FROM design EXCEPT SELECT site FROM analysis_only")
def set_difference(spark, d):
    """SET-2."""
    return table(spark, d, "design").select("crop").subtract(table(spark, d, "analysis_only").select("site"))


@query("SELECT crop AS k FROM design INTERSECT SELECT site FROM analysis_only INTERSECT SELECT spot FROM spots_table")
def set_intersection(spark, d):
    """SET-3."""
    a, b, c = table(spark, d, "design").select(F.col("crop").alias("k")), table(spark, d, "analysis_only").select("site"), table(spark, d, "spots_table").select("spot")
    return a.intersect(b).intersect(c)


# --- windows -----------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rank FROM events")
def win_average_rank(spark, d):
    """WIN-1: ties share the mean rank; ranks come from counts of values."""
    return o.average_rank(table(spark, d, "events").select("event_id", "value"), [], "value").select("event_id", "rank")


@query("WITH n AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_quantity, n, round((sum(n) OVER (ORDER BY l_quantity) - n / 2) / sum(n) OVER (), 9) AS cdf FROM n")
def win_mid_rank_cdf(spark, d):
    """WIN-2."""
    return o.mid_rank_cdf(table(spark, d, "lineitem"), "l_quantity").withColumn("cdf", F.round("cdf", 9))


@query("SELECT event_id, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS high, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low_after, round(value - avg(value) OVER (PARTITION BY user_id), 10) AS demeaned FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def win_cumulative(spark, d):
    """WIN-3, WIN-4."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(back), 4).alias("total"), F.max("value").over(back).alias("high"), F.min("value").over(ahead).alias("low_after"), F.round(F.col("value") - F.avg("value").over(Window.partitionBy("user_id")), 10).alias("demeaned"))


@query("WITH c AS (SELECT user_id, event_type, ts, event_id, (lag(event_type) OVER w IS DISTINCT FROM event_type)::INT AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c) SELECT user_id, run::BIGINT AS run, event_type, count(*) AS length FROM r GROUP BY ALL")
def win_runs(spark, d):
    """WIN-5: runs of equal events."""
    return o.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings), d AS (SELECT *, v - avg(v) OVER (PARTITION BY vec_id) AS d FROM x), p AS (SELECT k AS lag, d * lead(d, k) OVER (PARTITION BY vec_id, k ORDER BY x) AS p FROM d, (VALUES (1), (2), (5)) l(k)) SELECT lag, round(avg(p), 9) AS product, count(p) AS n FROM p WHERE p IS NOT NULL GROUP BY lag")
def win_lag_products(spark, d):
    """WIN-6: autocorrelation along lines."""
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))
    return o.lag_products(x, ["vec_id"], "x", "v", [1, 2, 5]).withColumn("product", F.round("product", 9))


@query("WITH m AS (SELECT vec_id, list_avg(list_transform(embedding, lambda v: v::DOUBLE)) AS m FROM embeddings), d AS (SELECT m - lag(m) OVER (ORDER BY vec_id) AS d FROM m) SELECT round(sqrt(avg(d * d)), 9) AS rms, round(max(abs(d)), 9) AS high FROM d")
def win_line_differences(spark, d):
    """WIN-7: successive differences of line means."""
    m = table(spark, d, "embeddings").select("vec_id", (F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size("embedding")).alias("m"))
    dd = o.successive(m, "vec_id", "m").withColumnRenamed("step", "d")
    return dd.agg(F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 9).alias("rms"), F.round(F.max(F.abs("d")), 9).alias("high"))


@query("WITH n AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS depth FROM events) SELECT user_id, depth // 10 AS band, count(*) AS n, round(avg(value), 6) AS m FROM n GROUP BY 1, 2 HAVING count(*) >= 5")
def win_depth_bands(spark, d):
    """WIN-8: bands counted from the last row; a band less than half full is dropped, as the operator means it."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    n = table(spark, d, "events").withColumn("band", F.floor((F.row_number().over(w) - 1) / 10))
    return n.groupBy("user_id", "band").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("m")).where("n >= 5")


@query("WITH c AS (SELECT user_id, row_number() OVER w AS x, value, lag(value) OVER w AS v0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(arg_min(x - 1 + (v0 - 20) / (v0 - value), x), 6) AS crossing FROM c WHERE value < 20 AND v0 >= 20 GROUP BY user_id")
def win_first_crossing(spark, d):
    """WIN-10."""
    n = table(spark, d, "events").withColumn("x", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return o.first_crossing(n, ["user_id"], "x", "value", 20.0).withColumn("crossing", F.round("crossing", 6))


@query("SELECT c_custkey, c_nationkey, (row_number() OVER (ORDER BY c_nationkey, md5('s' || c_custkey), c_custkey) - 1) % 5 AS fold FROM customer")
def win_deal_folds(spark, d):
    """WIN-14, CV-6: class by class into five folds."""
    return o.deal(table(spark, d, "customer"), "c_custkey", "c_nationkey", 5, "s")


@query("SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5('t' || c_custkey), c_custkey) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS role FROM customer")
def win_shuffle_split(spark, d):
    """WIN-15."""
    return o.shuffle_split(table(spark, d, "customer"), "c_custkey", 0.8, "t")


@query("SELECT event_id, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS share, lag(value, 1) OVER w AS before, lead(value, 1) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_analytic(spark, d):
    """WIN-17."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("share"), F.lag("value", 1).over(w).alias("before"), F.lead("value", 1).over(w).alias("after"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def srt_top_per_group(spark, d):
    """SRT-2, SRT-3, SRT-6."""
    return o.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("SELECT doc_id, relevance, year FROM documents ORDER BY CASE relevance WHEN 'core' THEN 0 WHEN 'method' THEN 1 WHEN 'peripheral' THEN 2 ELSE 3 END, year DESC NULLS LAST, doc_id LIMIT 50")
def srt_tiered(spark, d):
    """SRT-5: a tiered top list; the limit is the feature."""
    tier = F.when(F.col("relevance") == "core", 0).when(F.col("relevance") == "method", 1).when(F.col("relevance") == "peripheral", 2).otherwise(3)
    return table(spark, d, "documents").orderBy(tier, F.desc_nulls_last("year"), "doc_id").select("doc_id", "relevance", "year").limit(50)

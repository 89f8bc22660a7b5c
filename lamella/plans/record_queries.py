"""Queries of record-level operators: metadata, filters, alignment, sets, galleries, texts, ledgers, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.operators import learning as l
from lamella.operators import ordered as o
from lamella.operators import records as c
from lamella.operators import tables as t
from lamella.sources import files
from lamella.sources.tables import table
from lamella.streaming import flows

from .learning_queries import NEAR, vectors
from .registry import query
from .table_queries import FEATURES, TILES, tiles

_T = f"WITH {TILES}"


@query(f"{_T}, m AS (SELECT session, count(DISTINCT batch) > 1 AS mixed FROM tiles GROUP BY session) SELECT DISTINCT sample_id, right(sample_id, 1) AS code, batch IS NULL AS is_reference, 's' || tiles.session AS alias, mixed FROM tiles JOIN m ON m.session = tiles.session")
def prj_metadata(spark, d):
    """PRJ-1: flags, a class code from the name's end, an alias and whether a session holds several batches."""
    return c.metadata(tiles(spark, d), "sample_id", "session", "batch")


@query(f"{_T} SELECT sample_id, session AS imaging_session, NULL::DOUBLE AS si_fraction, porosity_frac FROM tiles UNION ALL SELECT sample_id, session, si_solid_frac, NULL FROM tiles WHERE batch IS NULL")
def prj_columns(spark, d):
    """PRJ-2, SET-1: columns chosen, renamed and put in order; a table that lacks one gets nulls."""
    x = tiles(spark, d).withColumnRenamed("session", "imaging_session")
    b = x.where("batch IS NULL").select("sample_id", "imaging_session", F.col("si_solid_frac").alias("si_fraction"))
    return c.concatenated(x.select("sample_id", "imaging_session", "porosity_frac"), b, order=("sample_id", "imaging_session", "si_fraction", "porosity_frac"))


@query(f"{_T} SELECT tile_id FROM tiles WHERE starts_with(sample_id, 'k') OR (scan IN (1, 3) AND " + " + ".join(f"({x} IS NOT NULL)::INT" for x in FEATURES) + " >= 13)")
def prj_filters(spark, d):
    """PRJ-3: prefix, membership and a least number of present values."""
    return tiles(spark, d).where(F.col("sample_id").startswith("k") | (F.col("scan").isin(1, 3) & (c.present(*FEATURES) >= 13))).select("tile_id")


@query("SELECT name FROM (SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS name) WHERE NOT regexp_full_match(name, 'si_.*') AND NOT regexp_full_match(name, '.*_.m')")
def prj_globs(spark, d):
    """PRJ-10: names that match none of some glob patterns."""
    names = t.unpivot(tiles(spark, d), ["tile_id"], FEATURES).select("name").distinct()
    return names.where(~c.matches_glob(F.col("name"), "si_*", "*_?m"))


@query("WITH m AS (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_tax) AS tax FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2, 3) SELECT l_orderkey, l.l_linenumber, round(tax, 9) AS tax FROM lineitem l LEFT JOIN m ON m.l_returnflag = l.l_returnflag AND m.l_linestatus = l.l_linestatus AND m.l_linenumber = l.l_linenumber")
def joi_three_keys(spark, d):
    """JOI-2: a left join on three keys."""
    li, keys = table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]
    return li.join(li.where("l_quantity > 30").groupBy(*keys).agg(F.avg("l_tax").alias("tax")), keys, "left").select("l_orderkey", "l_linenumber", F.round("tax", 9).alias("tax"))


@query("WITH w AS (SELECT pos, (pos * 7) % 30 AS k FROM range(0, 30) r(pos)) SELECT pos, k, n_name FROM w LEFT JOIN nation ON n_nationkey = k")
def joi_aligned(spark, d):
    """JOI-5, SRT-1: rows in a wanted order of keys, missing ones kept as null."""
    want = spark.range(30).select(F.col("id").alias("pos"), (F.col("id") * 7 % 30).alias("k"))
    return c.aligned(want, table(spark, d, "nation").withColumnRenamed("n_nationkey", "k"), "k", "pos").select("pos", "k", "n_name")


@query("WITH e AS (SELECT DISTINCT event_type FROM events), n AS (SELECT user_id % 5 AS r, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT r_regionkey, e.event_type, coalesce(n, 0) AS n FROM region JOIN e ON true LEFT JOIN n ON n.r = r_regionkey AND n.event_type = e.event_type")
def joi_grid(spark, d):
    """JOI-9: every concept with every outcome, whether seen or not; both lists are small."""
    ev = table(spark, d, "events")
    seen = ev.groupBy((F.col("user_id") % 5).cast("int").alias("r_regionkey"), "event_type").agg(F.count("*").alias("n"))
    return c.grid(table(spark, d, "region").select("r_regionkey"), ev.select("event_type").distinct(), seen, "n")


@query(NEAR.format(where=" AND a.vec_id % 2 <> b.vec_id % 2") + ", f AS (SELECT a, b FROM n WHERE rank = 1) SELECT x.a AS a, x.b AS b FROM f x JOIN f y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def joi_mutual_nearest(spark, d):
    """JOI-12: pairs of two sets that are each other's nearest."""
    x = vectors(spark, d).withColumns({"u": l.unit("x"), "side": F.col("vec_id") % 2})
    return c.mutual(l.nearest_rows(x, "vec_id", "u", 1, "side").select("a", "b"))


@query("WITH n AS (SELECT count(DISTINCT l_linenumber) AS n FROM lineitem) SELECT l_suppkey AS k FROM lineitem, n GROUP BY l_suppkey, n.n HAVING count(DISTINCT l_linenumber) = n.n")
def joi_in_all(spark, d):
    """JOI-13: keys that every run holds."""
    return c.in_all(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber").select(F.col("l_suppkey").alias("k"))


@query("WITH v AS (SELECT vec_id, vec_id % 13 AS s FROM embeddings), f AS (SELECT DISTINCT s AS fold FROM v), r AS (SELECT fold, vec_id, s = fold AS test FROM f, v) SELECT fold, count(*) FILTER (test) AS n_test, count(*) FILTER (NOT test) AS n_train, 0::BIGINT AS n_both, count(DISTINCT vec_id) = (SELECT count(*) FROM v) AS complete FROM r GROUP BY fold")
def set_fold_checks(spark, d):
    """SET-4: folds must be disjoint and complete."""
    v = vectors(spark, d)
    return c.fold_checks(l.group_folds(v, "vec_id", "s"), "vec_id", v.count())


@query("SELECT o_custkey % 50 AS g, list_sort(list_distinct(list(o_orderpriority) || list(o_orderstatus))) AS tags FROM orders GROUP BY 1")
def set_array_union(spark, d):
    """SET-5: distinct union of array columns."""
    x = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("g"), F.array("o_orderpriority").alias("a"), F.array("o_orderstatus").alias("b"))
    return c.array_union_by(x, "g", "a", "b", alias="tags")


@query("WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS b FROM customer) SELECT c_nationkey, c_custkey, 'top' AS side, t AS rank FROM r WHERE t <= 3 UNION ALL SELECT c_nationkey, c_custkey, 'bottom', b FROM r WHERE b <= 3")
def srt_gallery(spark, d):
    """SRT-4: the n highest and the n lowest of each group."""
    return c.gallery(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_acctbal", 3)


@query("WITH x AS (SELECT n_name, c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS dev FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY abs(dev) DESC, c_custkey) AS rank FROM x) WHERE rank <= 5")
def srt_top_by_size(spark, d):
    """SRT-2: the five largest contributions by absolute value."""
    x = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    x = x.withColumn("dev", F.round(F.col("c_acctbal") - F.avg("c_acctbal").over(Window.partitionBy("c_nationkey")), 6))
    return o.top_k(x, ["n_name"], [F.desc(F.abs("dev")), F.col("c_custkey")], 5).select("n_name", "c_custkey", "dev", "rank")


@query("SELECT event_type, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, value DESC, event_id) AS r FROM events) WHERE r <= 2")
def srt_priority(spark, d):
    """SRT-3: the first k of a group by a map of priorities."""
    first = c.priority(F.col("event_type"), {"purchase": 0, "signup": 1})
    return o.top_k(table(spark, d, "events"), ["user_id"], [first, F.desc("value"), F.col("event_id")], 2).select("event_type", "user_id", "value")


@query("WITH c AS (SELECT c_nationkey AS k, 'customer' AS source, 1 AS p FROM customer UNION ALL SELECT s_nationkey, 'supplier', 0 FROM supplier) SELECT k, arg_min(source, p) AS source FROM c GROUP BY k")
def agg_catalog_union(spark, d):
    """AGG-16: catalogs put together, one row a name; the earlier catalog wins."""
    a, b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("source")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("source"))
    return c.first_of([a, b], "k")


@query(f"{_T}, m AS (SELECT sample_id, col < max(col) OVER (PARTITION BY sample_id) / 2 AS is_left, porosity_frac FROM tiles) SELECT sample_id, round(avg(porosity_frac) FILTER (is_left), 9) AS left_mean, round(avg(porosity_frac) FILTER (NOT is_left), 9) AS right_mean FROM m GROUP BY sample_id")
def win_halves(spark, d):
    """WIN-13: the left half of a spot against the right one."""
    return c.halves(tiles(spark, d), "sample_id", "col", "porosity_frac").select("sample_id", F.round("left", 9).alias("left_mean"), F.round("right", 9).alias("right_mean"))


@query("WITH r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) SELECT user_id, event_type, min(r) AS best FROM r GROUP BY 1, 2")
def win_best_rank(spark, d):
    """WIN-16: the best rank of each one per topic."""
    return c.best_rank(table(spark, d, "events"), "event_type", "user_id", ["value", "event_id"]).select("user_id", "event_type", "best")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_totalprice, o_orderkey) AS pos FROM orders")
def srt_global(spark, d):
    """SRT-1: the place of each row in a stable order of several keys, by ranges."""
    return o.global_rank(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_totalprice", "o_orderkey"], "pos").select("o_orderkey", "o_custkey", "pos")


@query("SELECT strip_id, min(site) AS first, count(DISTINCT site) AS n FROM (SELECT regexp_extract('data/' || batch || '/' || site || '_' || strip_height_px || '.tif', 'data/([^/]+)/', 1) AS strip_id, regexp_extract('data/' || batch || '/' || site || '_' || strip_height_px || '.tif', '([^/_]+)_[0-9]+[.]tif', 1) AS site FROM strip_map WHERE batch IS NOT NULL AND strip_height_px IS NOT NULL) GROUP BY 1")
def src_index_from_names(spark, d):
    """SRC-19: an index rebuilt from file names alone."""
    s = table(spark, d, "strip_map").where("batch IS NOT NULL AND strip_height_px IS NOT NULL")
    paths = s.select(F.concat(F.lit("data/"), "batch", F.lit("/"), "site", F.lit("_"), F.col("strip_height_px").cast("string"), F.lit(".tif")).alias("path"))
    x = paths.select(F.regexp_extract("path", "data/([^/]+)/", 1).alias("strip_id"), F.regexp_extract("path", "([^/_]+)_[0-9]+[.]tif", 1).alias("site"))
    return x.groupBy("strip_id").agg(F.min("site").alias("first"), F.countDistinct("site").alias("n"))


@query("SELECT c_custkey, c_acctbal AS balance, c_nationkey AS nation FROM customer")
def src_json_in_js(spark, d):
    """SRC-11: JSON wrapped as a script, unwrapped and parsed with a schema."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("window.DATA = "), F.to_json(F.struct(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))), F.lit(";\n")).alias("js"))
    return c.json_of_script(rows, "js", "balance double, nation int").select("c_custkey", "json.balance", "json.nation")


_NAMES = "WITH n AS (SELECT item_id, string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')[1:5] AS w FROM eval_items WHERE text IS NOT NULL AND trim(text) <> '')"


@query(_NAMES + " SELECT item_id, CASE WHEN len(w) > 3 THEN w[1] || ' et al.' ELSE array_to_string(w, ', ') END AS short FROM n")
def txt_short_authors(spark, d):
    """TXT-9: the first author and 'et al.' after three; the words of an item stand in for authors."""
    x = table(spark, d, "eval_items").where("text IS NOT NULL AND trim(text) <> ''").select("item_id", F.slice(F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " "), 1, 5).alias("w"))
    return x.select("item_id", c.short_authors(F.col("w")).alias("short"))


@query("SELECT o_custkey, md5(array_to_string(list_sort(list_distinct(list(o_orderpriority || '=' || o_orderstatus))), '|')) AS form FROM orders GROUP BY 1")
def txt_canonical(spark, d):
    """TXT-12: a form that does not depend on order, for telling whether an entry changed."""
    return c.canonical_form(table(spark, d, "orders").withColumn("kv", F.concat_ws("=", "o_orderpriority", "o_orderstatus")), "o_custkey", "kv")


@query("WITH s AS (SELECT doc_id, (doc_id % 11) / 10.0 AS name, (doc_id % 7) / 6.0 AS short, (doc_id % 5) / 4.0 AS long FROM documents), g AS (SELECT doc_id, greatest(name, short, 0.8 * long) AS score FROM s) SELECT doc_id, round(score, 9) AS score, CASE WHEN score >= 0.55 THEN 'duplicate' WHEN score >= 0.30 THEN 'similar' ELSE 'new' END AS verdict FROM g")
def txt_duplicate_verdict(spark, d):
    """TXT-6: the verdict from three similarities."""
    x = table(spark, d, "documents").select("doc_id", *[((F.col("doc_id") % m) / (m - 1)).alias(n) for m, n in ((11, "name"), (7, "short"), (5, "long"))])
    return c.duplicate_verdict(x, "name", "short", "long").select("doc_id", F.round("score", 9).alias("score"), "verdict")


@query("SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'balance below zero' END, CASE WHEN c_nationkey > 20 THEN 'nation out of range' END, CASE WHEN c_custkey % 10 = 0 THEN 'round key' END], lambda v: v IS NOT NULL) AS problems FROM customer")
def led_problems(spark, d):
    """LED-1, UDX-4: an entry with the list of its problems."""
    rules = {"balance below zero": F.col("c_acctbal") < 0, "nation out of range": F.col("c_nationkey") > 20, "round key": F.col("c_custkey") % 10 == 0}
    return table(spark, d, "customer").select("c_custkey", c.problems(rules).alias("problems"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def led_uncovered(spark, d):
    """LED-2: what was built but stands in no entry."""
    return t.gaps(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("WITH r AS (SELECT c_nationkey AS ref, min(c_custkey) AS first, list_sort(list(DISTINCT c_custkey % 7)) AS used_by FROM customer GROUP BY 1) SELECT row_number() OVER (ORDER BY first) AS number, ref, used_by FROM r")
def led_numbering(spark, d):
    """LED-3: references numbered in order of first use, with links back."""
    x = table(spark, d, "customer").select(F.col("c_nationkey").alias("ref"), F.col("c_custkey").alias("at"), (F.col("c_custkey") % 7).alias("entry"))
    return c.numbered_references(x, "ref", "at", "entry")


@query("WITH j AS (SELECT unnest(['10.1', '10.10', '10.2']) AS prefix, unnest(['first', 'tenth', 'second']) AS journal), x AS (SELECT c_custkey, '10.' || c_custkey || '/x' AS doi FROM customer) SELECT c_custkey, coalesce((SELECT arg_max(journal, len(prefix)) FROM j WHERE starts_with(doi, prefix)), 'unknown') AS journal FROM x")
def led_doi_prefix(spark, d):
    """LED-6: the journal of the longest prefix that fits, else a fallback."""
    prefixes = spark.createDataFrame([("10.1", "first"), ("10.10", "tenth"), ("10.2", "second")], "prefix string, journal string")
    x = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("10."), F.col("c_custkey").cast("string"), F.lit("/x")).alias("doi"))
    return c.by_longest_prefix(x, "doi", prefixes, "prefix", "journal", "unknown").select("c_custkey", "journal")


@query("SELECT event_id, value > 100 OR event_type = 'click' AS verified FROM events")
def evd_reverify(spark, d):
    """EVD-2: only unverified rows are looked at again."""
    ev = table(spark, d, "events").select("event_id", "event_type", "value", (F.col("value") > 100).alias("verified"))
    return c.reverified(ev, "verified", F.col("event_type") == "click").select("event_id", "verified")


@query("SELECT user_id, count(*) AS kept FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY 1")
def evd_addressed(spark, d):
    """EVD-3: answers that address the question."""
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view") & F.col("value").isNotNull()).groupBy("user_id").agg(F.count("*").alias("kept"))


_SIGN = "CASE o_orderstatus WHEN 'F' THEN 'more' WHEN 'O' THEN 'less' ELSE 'optimum' END"


@query(f"WITH a AS (SELECT o_custkey % 20 AS c, {_SIGN} AS dir FROM orders), k AS (SELECT c, count(*) AS n, count(*) FILTER (dir = 'more') AS m, count(*) FILTER (dir = 'less') AS s, count(*) FILTER (dir = 'optimum') AS p FROM a GROUP BY c), v AS (SELECT c, CASE WHEN n < 3 THEN 'too few' WHEN m >= 0.5 * n THEN 'more' WHEN s >= 0.5 * n THEN 'less' WHEN p >= 0.5 * n THEN 'optimum' ELSE 'mixed' END AS v FROM k) SELECT c, CASE WHEN v = 'optimum' THEN 'optimum' WHEN v IN ('mixed', 'too few') THEN 'unsettled' WHEN (v = 'more') = ((CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN c % 5 = 0 THEN -1 ELSE 1 END) > 0) THEN 'agrees' ELSE 'disagrees' END AS verdict FROM v")
def evd_rule_signs(spark, d):
    """EVD-5: the sign of a rule against the literature, inverse concepts turned."""
    from lamella.operators.text import consensus

    sign = F.when(F.col("o_orderstatus") == "F", "more").when(F.col("o_orderstatus") == "O", "less").otherwise("optimum")
    con = consensus(table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("c"), sign.alias("dir")), ["c"], "dir", 3, 0.5)
    return con.select("c", c.rule_against(F.col("consensus"), F.when(F.col("c") % 2 == 0, 1).otherwise(-1), F.col("c") % 5 == 0).alias("verdict"))


@query("WITH r AS (SELECT c_custkey AS id, c_nationkey AS feature, CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal < 9000 THEN 1 ELSE 2 END AS sign FROM customer) SELECT id, 'sign not -1 or 1' AS problem FROM r WHERE sign NOT IN (-1, 1) UNION ALL SELECT max(id), 'feature twice' FROM r GROUP BY feature, sign HAVING count(*) > 1 UNION ALL SELECT id, 'feature excluded' FROM r WHERE starts_with(feature::VARCHAR, '2')")
def map_rule_checks(spark, d):
    """MAP-9: constraints of a rule table, returned as violations."""
    sign = F.when(F.col("c_acctbal") < 0, -1).when(F.col("c_acctbal") < 9000, 1).otherwise(2)
    return c.rule_violations(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("feature"), sign.alias("sign")), ["2"])


@query("SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 9) AS ln, round(exp(o_orderkey % 10), 6) AS e, round(power(o_orderkey % 7, 3), 6) AS cube, floor(o_totalprice / 7)::BIGINT AS down, ceil(o_totalprice / 7)::BIGINT AS up, round(atan2(o_orderkey % 5, 3), 9) AS angle, round(sqrt((o_orderkey % 5) ** 2 + 9), 9) AS hyp, round(asinh(o_totalprice / 1000), 9) AS ash, sign(o_totalprice - 100000)::INT AS sgn, o_orderkey % 13 AS m FROM orders")
def fun_math(spark, d):
    """FUN math."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(k, F.round(F.sqrt(p), 6).alias("root"), F.round(F.log(p), 9).alias("ln"), F.round(F.exp(k % 10), 6).alias("e"), F.round(F.pow(k % 7, F.lit(3)), 6).alias("cube"), F.floor(p / 7).alias("down"), F.ceil(p / 7).alias("up"),
                                            F.round(F.atan2(k % 5, F.lit(3)), 9).alias("angle"), F.round(F.hypot(k % 5, F.lit(3)), 9).alias("hyp"), F.round(F.asinh(p / 1000), 9).alias("ash"), F.signum(p - 100000).cast("int").alias("sgn"), (k % 13).alias("m"))


@query("SELECT n_nationkey, upper(n_name) AS up, lower(n_name) AS low, reverse(n_name) AS rev, length(n_name) AS len, substr(n_name, 2, 3) AS sub, replace(n_name, 'A', '_') AS rep, lpad(n_name, 20, '.') AS pad, instr(n_name, 'I') AS at, repeat(left(n_name, 1), 3) AS tri, split_part(n_name, 'A', 1) AS first, regexp_extract(n_name, '[AEIOU]+', 0) AS vowels, levenshtein(n_name, 'FRANCE') AS dist, starts_with(n_name, 'I') AS i FROM nation")
def fun_string(spark, d):
    """FUN string."""
    n = F.col("n_name")
    return table(spark, d, "nation").select("n_nationkey", F.upper(n).alias("up"), F.lower(n).alias("low"), F.reverse(n).alias("rev"), F.length(n).alias("len"), F.substring(n, 2, 3).alias("sub"), F.replace(n, F.lit("A"), F.lit("_")).alias("rep"), F.lpad(n, 20, ".").alias("pad"), F.instr(n, "I").alias("at"),
                                            F.repeat(F.left(n, F.lit(1)), 3).alias("tri"), F.split_part(n, F.lit("A"), F.lit(1)).alias("first"), F.regexp_extract(n, "[AEIOU]+", 0).alias("vowels"), F.levenshtein(n, F.lit("FRANCE")).alias("dist"), n.startswith("I").alias("i"))


@query("SELECT c_custkey, md5(c_custkey::VARCHAR) AS m, sha1(c_custkey::VARCHAR) AS s, sha256(c_custkey::VARCHAR) AS t, to_base64(c_custkey::VARCHAR::BLOB) AS b FROM customer")
def fun_hash(spark, d):
    """FUN hash."""
    k = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select("c_custkey", F.md5(k).alias("m"), F.sha1(k).alias("s"), F.sha2(k, 256).alias("t"), F.base64(F.encode(k, "UTF-8")).alias("b"))


@query("WITH a AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS a FROM orders GROUP BY 1) SELECT o_custkey, len(a) AS n, a[1] AS first, a[-1] AS last, list_sum(a)::BIGINT AS total, list_contains(a, 1) AS one, list_position(a, a[2]) AS at, a[1:2] AS head, list_reverse(a) AS back, list_transform(a, lambda v: v * 2) AS twice, list_filter(a, lambda v: v % 2 = 0) AS even FROM a")
def fun_array(spark, d):
    """FUN array; the arrays are the orders of one customer."""
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    second = F.when(F.size("a") >= 2, F.element_at("a", 2))
    return x.select("o_custkey", F.size("a").alias("n"), F.element_at("a", 1).alias("first"), F.element_at("a", -1).alias("last"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"), F.array_contains("a", 1).alias("one"),
                    F.array_position("a", second).alias("at"), F.slice("a", 1, 2).alias("head"), F.reverse("a").alias("back"), F.transform("a", lambda v: v * 2).alias("twice"), F.filter("a", lambda v: v % 2 == 0).alias("even"))


@query("SELECT user_id, map_keys(m) AS keys, cardinality(m) AS n, map_extract(m, 'click')[1] AS clicks, (m::JSON::VARCHAR) AS js FROM (SELECT user_id, map_from_entries(list_sort(list((event_type, n)))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)")
def fun_map(spark, d):
    """FUN map / JSON."""
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("user_id", F.map_keys("m").alias("keys"), F.size("m").alias("n"), F.try_element_at("m", F.lit("click")).alias("clicks"), F.to_json("m").alias("js"))


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, dayofyear(ts) AS doy, date_trunc('week', ts)::DATE::VARCHAR AS week, date_diff('day', DATE '2024-01-01', ts::DATE) AS days, strftime(ts, '%Y%m%d') AS stamp, (ts::DATE + 30)::VARCHAR AS later, last_day(ts)::VARCHAR AS month_end FROM events")
def fun_date(spark, d):
    """FUN date."""
    t_ = F.col("ts")
    return table(spark, d, "events").select("event_id", F.year(t_).alias("y"), F.month(t_).alias("m"), F.day(t_).alias("dd"), F.hour(t_).alias("h"), F.dayofyear(t_).alias("doy"), F.date_trunc("week", t_).cast("date").cast("string").alias("week"), F.datediff(t_, F.lit("2024-01-01").cast("date")).alias("days"),
                                            F.date_format(t_, "yyyyMMdd").alias("stamp"), F.date_add(t_.cast("date"), 30).cast("string").alias("later"), F.last_day(t_).cast("string").alias("month_end"))


@query("SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 5 AS o, xor(c_custkey, 9) AS x, c_custkey << 2 AS l, c_custkey >> 1 AS r, bit_count(c_custkey)::INT AS n FROM customer")
def fun_bit(spark, d):
    """FUN bit."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k, k.bitwiseAND(F.lit(12)).alias("a"), k.bitwiseOR(F.lit(5)).alias("o"), k.bitwiseXOR(F.lit(9)).alias("x"), F.shiftleft(k, 2).alias("l"), F.shiftright(k, 1).alias("r"), F.bit_count(k).alias("n"))


_MD5U = "(('0x' || substr(md5('{s}|' || c_custkey), 1, 12))::BIGINT / 281474976710656.0)"


@query("SELECT c_custkey, round(sqrt(-2 * ln(" + _MD5U.format(s="n1") + " + 1e-15)) * cos(2 * pi() * " + _MD5U.format(s="n2") + "), 8) AS z, round(-ln(1 - " + _MD5U.format(s="e") + "), 8) AS expo, floor(" + _MD5U.format(s="i") + " * 6)::BIGINT + 1 AS die FROM customer")
def fun_random(spark, d):
    """FUN random, STA-17: normal, exponential and whole numbers from the hash generator."""
    u = lambda s: o.md5_uniform(F.lit(s), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.round(c.hash_normal(u("n1"), u("n2")), 8).alias("z"), F.round(-F.log(1 - u("e")), 8).alias("expo"), (F.floor(u("i") * 6) + 1).alias("die"))


@query("SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS text FROM (SELECT item_id, min(text) AS text FROM eval_items WHERE trim(text) <> '' GROUP BY item_id)")
def src_inverted_text(spark, d):
    """SRC-15: texts rebuilt from a map of their words to positions."""
    i = table(spark, d, "eval_items").where("trim(text) <> ''").groupBy("item_id").agg(F.min("text").alias("text"))
    w = i.select("item_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("at", "word")).groupBy("item_id", "word").agg(F.collect_list("at").alias("at"))
    inverted = w.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return files.from_positions(inverted, "item_id", "index")


@query("SELECT tile_id, CASE WHEN isnan(porosity_frac) THEN NULL ELSE porosity_frac END AS v FROM (SELECT tile_id, porosity_frac, row_number() OVER (PARTITION BY tile_id ORDER BY loaded_at DESC) AS n FROM tile_features) WHERE n = 1")
def src_json_numbers(spark, d):
    """SRC-10: numbers as the JSON sink writes them: NaN and infinity null, ten significant digits."""
    x = t.latest(table(spark, d, "tile_features"), ["tile_id"], "loaded_at").select("tile_id", files.clean_number(F.col("porosity_frac")).alias("v"))
    back = x.select("tile_id", F.from_json(F.to_json(F.struct("v")), "v double").alias("j"))
    return back.select("tile_id", "j.v")


@query("SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey % 7 <> 0")
def src_log_lines(spark, d):
    """SRC-18: JSON lines of a log of which some were cut short."""
    line = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")))
    cut = F.when(F.col("c_custkey") % 7 == 0, F.substring(line, 1, 9)).otherwise(line)
    x = table(spark, d, "customer").select(F.from_json(cut, "id bigint, value double, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    return x.where("j._corrupt IS NULL AND j.id IS NOT NULL").select("j.id", "j.value")


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS high FROM events GROUP BY 1, 2")
def str_tumbling(spark, d):
    """STR-1: tumbling windows; the same function serves streams under a watermark."""
    w = flows.windowed(_events(spark, d), "ts", "event_type", "value", "1 day", "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"), "high")


@query("SELECT strftime(date_trunc('hour', ts) - INTERVAL (k) HOUR, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events, range(0, 3) r(k) GROUP BY 1, 2")
def str_sliding(spark, d):
    """STR-1: windows of three hours every hour."""
    w = flows.windowed(_events(spark, d), "ts", "event_type", "value", "1 day", "3 hours", "1 hour")
    return w.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s")
def str_sessions(spark, d):
    """STR-1: sessions that end after twelve quiet hours."""
    s = flows.sessions(_events(spark, d), "ts", "user_id", "1 day", "12 hours")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")

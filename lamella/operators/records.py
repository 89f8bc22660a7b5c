"""Record-level operators: metadata, alignment, grids, sets, galleries, ledgers and their checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import global_rank


def metadata(rows: DataFrame, key: str, group: str, batch: str) -> DataFrame:
    """One row a key and group: class code (last letter), whether it is a reference (no batch), the group's alias, and whether
    the group holds several batches."""
    mixed = rows.groupBy(group).agg((F.countDistinct(batch) > 1).alias("mixed"))
    x = rows.select(key, group, F.col(batch).isNull().alias("is_reference")).distinct().join(mixed, group)
    return x.select(key, F.right(F.col(key), F.lit(1)).alias("code"), "is_reference", F.concat(F.lit("s"), F.col(group).cast("string")).alias("alias"), "mixed")


def concatenated(*parts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Tables one below the other by column name; a column that a table lacks is null; columns in the given order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*order)


def present(*columns: str) -> Column:
    """How many of the columns hold a value."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def matches_glob(c: Column, *patterns: str) -> Column:
    """Whether the whole value fits one of the glob patterns (``*`` any run, ``?`` one character)."""
    import re

    as_regex = lambda g: "^" + "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in g) + "$"
    return reduce(lambda a, b: a | b, [c.rlike(as_regex(g)) for g in patterns])


def aligned(order: DataFrame, rows: DataFrame, key: str, position: str) -> DataFrame:
    """The rows of the wanted keys with their position; keys that are missing keep a row of nulls."""
    return order.join(rows, key, "left").orderBy(position)


def grid(left: DataFrame, right: DataFrame, seen: DataFrame, value: str) -> DataFrame:
    """Every row of left with every one of right (short lists of names, broadcast), and the value seen or 0."""
    pairs = left.join(F.broadcast(right))
    return pairs.join(seen, [*left.columns, *right.columns], "left").withColumn(value, F.coalesce(value, F.lit(0).cast("bigint")))


def mutual(first: DataFrame) -> DataFrame:
    """Of (a, b), b the nearest of a: the pairs that hold both ways, once."""
    back = first.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return first.join(back, ["a", "b"], "left_semi").where("a < b")


def in_all(rows: DataFrame, key: str, run: str) -> DataFrame:
    """Keys that stand in every run."""
    runs = rows.agg(F.countDistinct(run).alias("_n"))
    return rows.groupBy(key).agg(F.countDistinct(run).alias("_k")).join(F.broadcast(runs)).where("_k = _n").select(key)


def fold_checks(folds: DataFrame, key: str, rows: int) -> DataFrame:
    """By fold: rows of each role, keys that stand in both, and whether all rows are there."""
    by = folds.groupBy("fold", key).agg(F.bool_or(F.col("role") == "test").alias("t"), F.bool_or(F.col("role") == "train").alias("r"))
    return by.groupBy("fold").agg(F.count_if("t").alias("n_test"), F.count_if("r").alias("n_train"), F.count_if(F.col("t") & F.col("r")).alias("n_both"), (F.count("*") == rows).alias("complete"))


def array_union_by(rows: DataFrame, key: str, *arrays: str, alias: str) -> DataFrame:
    """The sorted distinct values of some array columns over the rows of a key; values are made distinct before they meet."""
    v = rows.select(key, F.explode(F.array_distinct(F.flatten(F.array(*arrays)))).alias("_v"))
    return v.groupBy(key).agg(F.array_sort(F.collect_set("_v")).alias(alias))


def gallery(rows: DataFrame, group: str, key: str, value: str, n: int) -> DataFrame:
    """The n highest and n lowest rows of each group (equal: smaller key)."""
    top = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), key))
    bottom = F.row_number().over(Window.partitionBy(group).orderBy(value, key))
    side = lambda name, rank: rows.select(group, key, F.lit(name).alias("side"), rank.alias("rank")).where(F.col("rank") <= n)
    return side("top", top).unionByName(side("bottom", bottom))


def priority(c: Column, order: Mapping[str, int]) -> Column:
    """The priority of a value; values outside the map come last."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[c], F.lit(max(order.values()) + 1))


def first_of(catalogs: Sequence[DataFrame], key: str) -> DataFrame:
    """Catalogs put together, one row a key; the earlier catalog wins."""
    rows = reduce(DataFrame.unionByName, [x.distinct().withColumn("_p", F.lit(n)) for n, x in enumerate(catalogs)])
    rest = [c for c in catalogs[0].columns if c != key]
    return rows.groupBy(key).agg(*[F.min_by(c, "_p").alias(c) for c in rest])


def halves(rows: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Means of the left and the right half of each key, by position against half the largest one; one aggregation and a join."""
    width = rows.groupBy(key).agg((F.max(position) / 2).alias("_w"))
    x = rows.join(width, key).withColumn("_l", F.col(position) < F.col("_w"))
    return x.groupBy(key).agg(F.avg(F.when(F.col("_l"), F.col(value))).alias("left"), F.avg(F.when(~F.col("_l"), F.col(value))).alias("right"))


def best_rank(rows: DataFrame, topic: str, key: str, order: Sequence[str]) -> DataFrame:
    """Ranks within topic by the first column falling, the others rising; the best one a key and topic."""
    w = Window.partitionBy(topic).orderBy(F.desc(order[0]), *order[1:])
    return rows.select(topic, key, F.row_number().over(w).alias("_r")).groupBy(topic, key).agg(F.min("_r").alias("best"))


def json_of_script(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``json`` from a value like ``name = {...};``: the wrapper goes, the rest is parsed; what cannot be parsed is null."""
    body = F.regexp_extract(column, r"(?s)=\s*(.*?);?\s*$", 1)
    return rows.withColumn("json", F.from_json(body, schema))


def short_authors(names: Column) -> Column:
    """Up to three names as they are, else the first one and 'et al.'."""
    return F.when(F.size(names) > 3, F.concat(names[0], F.lit(" et al."))).otherwise(F.array_join(names, ", "))


def canonical_form(rows: DataFrame, key: str, part: str) -> DataFrame:
    """A hash of the parts of a key that depends on neither their order nor their repetition."""
    return rows.groupBy(key).agg(F.md5(F.array_join(F.array_sort(F.collect_set(part)), "|")).alias("form"))


def duplicate_verdict(rows: DataFrame, name: str, short: str, long: str, duplicate: float = 0.55, similar: float = 0.30) -> DataFrame:
    """The greatest of name, short and 0.8 long similarity (fixed values), and what it means."""
    x = rows.withColumn("score", F.greatest(F.col(name), F.col(short), 0.8 * F.col(long)))
    return x.withColumn("verdict", F.when(F.col("score") >= duplicate, "duplicate").when(F.col("score") >= similar, "similar").otherwise("new"))


def problems(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that a row breaks, in the rules' order."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda v: v.isNotNull())


def numbered_references(rows: DataFrame, ref: str, at: str, entry: str) -> DataFrame:
    """(number, ref, used_by): references by the place of their first use, with the entries that use them."""
    r = rows.groupBy(ref).agg(F.min(at).alias("_first"), F.array_sort(F.collect_set(entry)).alias("used_by"))
    return global_rank(r, ["_first", ref], "number").select("number", ref, "used_by")


def by_longest_prefix(rows: DataFrame, value: str, prefixes: DataFrame, prefix: str, name: str, fallback: str) -> DataFrame:
    """Adds ``name`` of the longest prefix that fits. Prefixes are a short reference list: one array, searched from the longest."""
    held = F.broadcast(prefixes.agg(F.sort_array(F.collect_list(F.struct(F.length(prefix).alias("n"), F.col(prefix).alias("p"), F.col(name).alias("v"))), asc=False).alias("_all")))
    fit = F.filter("_all", lambda e: F.startswith(F.col(value), e["p"]))
    return rows.join(held).withColumn(name, F.coalesce(F.get(fit, F.lit(0))["v"], F.lit(fallback))).drop("_all")


def reverified(rows: DataFrame, flag: str, check: Column) -> DataFrame:
    """Rows already verified stay; the check is made for the others only."""
    return rows.withColumn(flag, F.when(F.col(flag), True).otherwise(check))


def rule_against(consensus: Column, sign: Column, inverse: Column) -> Column:
    """agrees, disagrees, optimum or unsettled: the sign of a rule, turned for inverse concepts, against the consensus."""
    s = F.when(inverse, -sign).otherwise(sign)
    return F.when(consensus == "optimum", "optimum").when(consensus.isin("mixed", "too few"), "unsettled").when((consensus == "more") == (s > 0), "agrees").otherwise("disagrees")


def rule_violations(rules: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """(id, problem) of a rule table (id, feature, sign): signs other than -1 and 1, repeated rules, excluded prefixes."""
    out = reduce(lambda a, b: a | b, [F.col("feature").startswith(p) for p in excluded])
    twice = rules.groupBy("feature", "sign").agg(F.max("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id", F.lit("feature twice").alias("problem"))
    bad = rules.where(~F.col("sign").isin(-1, 1)).select("id", F.lit("sign not -1 or 1").alias("problem"))
    return bad.unionByName(twice).unionByName(rules.where(out).select("id", F.lit("feature excluded").alias("problem")))


def hash_normal(u: Column, v: Column) -> Column:
    """A normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(u + 1e-15)) * F.cos(2 * F.pi() * v)

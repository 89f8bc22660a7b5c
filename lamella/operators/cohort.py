"""Evaluation, kernels, resampling and pooling on small tables of calls, classes and groups, from sums by group where possible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .learning import doubles, dot
from .ordered import md5_uniform


def pairwise_accuracies(calls: DataFrame, y: str, call: str) -> DataFrame:
    """(a, b, one_vs_rest, pairwise): the recall of class a among all rows, and among rows of a and b called one of the two."""
    n = calls.groupBy(F.col(y).alias("y"), F.col(call).alias("c")).agg(F.count("*").alias("n"))  # classes squared
    total = n.groupBy(F.col("y").alias("a")).agg((F.sum(F.when(F.col("y") == F.col("c"), F.col("n")).otherwise(0)) / F.sum("n")).alias("one_vs_rest"))
    ends = n.select(F.col("y").alias("a")).distinct()
    pairs = ends.join(F.broadcast(ends.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))
    inside = n.join(F.broadcast(pairs), F.col("y").isin(F.col("a"), F.col("b")) & F.col("c").isin(F.col("a"), F.col("b")))
    both = inside.groupBy("a", "b").agg((F.sum(F.when(F.col("y") == F.col("c"), F.col("n")).otherwise(0)) / F.sum("n")).alias("pairwise"))
    return both.join(total, "a")


def fold_report(folds: DataFrame, labels: DataFrame, key: str, y: str, least: int) -> DataFrame:
    """By fold: classes among the training rows, the rows of the rarest one, and whether it can be learnt."""
    n = folds.where("role = 'train'").join(labels.select(key, y), key).groupBy("fold", y).agg(F.count("*").alias("n"))
    return n.groupBy("fold").agg(F.count("*").alias("classes"), F.min("n").alias("rarest")).withColumn("learnable", (F.col("classes") > 1) & (F.col("rarest") >= least))


def training_sets(folds: DataFrame, key: str) -> DataFrame:
    """Folds with the same training rows share a job: (job, folds); sets are told apart by their size and two sums, so that no
    set is gathered."""
    k = F.col(key).cast("decimal(38,0)")
    s = folds.where("role = 'train'").groupBy("fold").agg(F.count("*").alias("n"), F.sum(k).alias("s"), F.sum(k * k % 1_000_003).alias("q"))
    return s.groupBy("n", "s", "q").agg(F.min("fold").alias("job"), F.count("*").alias("folds")).select("job", "folds", "n")


def provenance_oracle(rows: DataFrame, key: str, group: str, y: str, pseudo: float) -> DataFrame:
    """(key, class, majority, oracle), each row left out: the class shares of the other rows, and those of the other rows of its
    group with ``pseudo`` rows of the shares added. Counts by group and class, no fold table."""
    by = rows.groupBy(F.col(group).alias("g"), F.col(y).alias("class")).agg(F.count("*").alias("k"))
    classes = by.groupBy("class").agg(F.sum("k").alias("all"))
    n = rows.agg(F.count("*").alias("rows"))
    sizes = by.groupBy("g").agg(F.sum("k").alias("size"))
    x = rows.select(key, F.col(group).alias("g"), F.col(y).alias("own")).join(F.broadcast(classes)).join(F.broadcast(n)).join(sizes, "g").join(by, ["g", "class"], "left")
    own = (F.col("own") == F.col("class")).cast("int")
    prior = (F.col("all") - own) / (F.col("rows") - 1)
    return x.select(key, "class", prior.alias("majority"), ((F.coalesce("k", F.lit(0)) - own + pseudo * prior) / (F.col("size") - 1 + pseudo)).alias("oracle"))


def blind_choice(a: DataFrame, b: DataFrame, key: str, y: str, call: str, margin: int, winner: str) -> DataFrame:
    """(n_a, n_b, chosen): rows called right by each; within the margin the named winner, else the better one."""
    n = lambda x, name: x.agg(F.count_if(F.col(y) == F.col(call)).alias(name))
    x = n(a, "n_a").join(F.broadcast(n(b, "n_b")))
    return x.withColumn("chosen", F.when(F.abs(F.col("n_a") - F.col("n_b")) <= margin, winner).when(F.col("n_a") > F.col("n_b"), "A").otherwise("B"))


def stability(refits: DataFrame, call: DataFrame, key: str) -> DataFrame:
    """The share of refits (key, call) that agree with the call made with all rows."""
    x = refits.select(key, F.col("call").alias("_r")).join(call.select(key, F.col("call")), key)
    return x.groupBy("call").agg(F.count("*").alias("n"), F.avg((F.col("_r") == F.col("call")).cast("double")).alias("stable"))


def contributions(rows: DataFrame, key: str, vec: str, coef: Sequence[float], k: int) -> DataFrame:
    """The k coordinates with the largest part (by size) in the score of each row: value times coefficient."""
    part = F.zip_with(vec, F.array(*[F.lit(float(c)) for c in coef]), lambda v, w: v * w)
    x = rows.select(key, F.posexplode(part).alias("j", "part"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("part"), 9)), "j"))).where(F.col("rank") <= k)


def pair_folds(edges: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Pair hold-out: a fold for each edge, its two ends are its test rows (training rows are all others, not listed)."""
    e = edges.withColumn("fold", F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string")))
    ends = e.select("fold", F.explode(F.array("src", "dst")).alias(key))
    return ends.join(rows.select(key), key, "left_semi").select("fold", key)


def finished_kernel(kernel: DataFrame, train: Column) -> DataFrame:
    """(a, b, k): cosine-normalised, centred on the training rows' means, scaled to a mean training diagonal of 1."""
    own = kernel.where("a = b").select("a", F.sqrt(F.greatest("k", F.lit(0.0))).alias("n"))
    x = kernel.join(own, "a").join(own.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    x = x.select("a", "b", F.when((F.col("n") > 1e-12) & (F.col("m") > 1e-12), F.col("k") / F.col("n") / F.col("m")).otherwise(0.0).alias("k"))
    held = x.withColumn("b_train", train)
    mean = held.where("b_train").groupBy("a").agg(F.avg("k").alias("mean"))
    total = mean.withColumnRenamed("a", "b").withColumn("t", train).where("t").agg(F.avg("mean").alias("total"))
    c = x.join(mean, "a").join(mean.select(F.col("a").alias("b"), F.col("mean").alias("mean_b")), "b").join(F.broadcast(total))
    c = c.select("a", "b", (F.col("k") - F.col("mean") - F.col("mean_b") + F.col("total")).alias("k"))
    trace = c.where("a = b").withColumn("t", train).where("t").agg(F.avg("k").alias("trace"))
    return c.join(F.broadcast(trace)).select("a", "b", F.when(F.col("trace") > 1e-10, F.col("k") / F.col("trace")).otherwise(0.0).alias("k"))


def class_distances(rows: DataFrame, key: str, y: str, vec: str) -> DataFrame:
    """(key, class, d): squared distance to each class in the linear kernel's space, k(x,x) - 2 mean k(x,c) + mean k(c,c); the
    means of kernels follow from the class means, so no pair of rows is made."""
    m = rows.select(F.col(y).alias("class"), F.posexplode(vec).alias("j", "v")).groupBy("class", "j").agg(F.avg("v").alias("m"))
    m = m.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda e: e["m"]).alias("c"))
    x = rows.select(key, vec).join(F.broadcast(m))
    return x.select(key, "class", (dot(vec, vec) - 2 * dot(vec, "c") + dot("c", "c")).alias("d"))


def paired_delta(calls: DataFrame, group: str, a: str, b: str, draws: int, seed: str) -> DataFrame:
    """Difference of the means of two columns over shared resamples of whole groups: (low, high, p) with p the share over 0."""
    g = calls.groupBy(F.col(group).alias("g")).agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.count("*").alias("n"))
    g = g.withColumn("i", F.row_number().over(Window.orderBy("g")) - 1)  # one row a group
    size = g.agg(F.count("*").alias("m"))
    pick = size.select("m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("m", "draw", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("slot"))
    pick = pick.select("draw", F.floor(md5_uniform(F.lit(seed), "draw", "slot") * F.col("m")).alias("i"))
    d = pick.join(F.broadcast(g), "i").groupBy("draw").agg(((F.sum("a") - F.sum("b")) / F.sum("n")).alias("d"))
    return d.agg(F.percentile("d", F.lit(0.05)).alias("low"), F.percentile("d", F.lit(0.95)).alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("p"))


def renamed_classes(groups: DataFrame, group: str, y: str, draws: int, seed: str) -> DataFrame:
    """(draw, group, y, as): the classes of each group renamed among themselves in every draw, by hash order."""
    d = groups.select(group, y).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    part = Window.partitionBy("draw", group)
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col(group).cast("string"), F.col(y).cast("string")))
    a = d.withColumn("r", F.row_number().over(part.orderBy(y)))
    b = d.withColumn("r", F.row_number().over(part.orderBy(mixed, F.col(y)))).select("draw", group, "r", F.col(y).alias("as"))
    return a.join(b, ["draw", group, "r"]).select("draw", group, y, "as")


def max_statistic(scores: DataFrame, family: str, draw: str, value: str) -> DataFrame:
    """(family, value, p): the observed value (draw 0) of each member against the largest of all members in each other draw."""
    top = scores.where(F.col(draw) > 0).groupBy(draw).agg(F.max(value).alias("_top"))
    seen = scores.where(F.col(draw) == 0).select(family, value)  # one row a member
    return seen.join(F.broadcast(top)).groupBy(family, value).agg(((F.count_if(F.col("_top") >= F.col(value)) + 1) / (F.count("*") + 1)).alias("p"))


def generalised_mean(rows: DataFrame, keys: Sequence[str], vec: str, power: float = 3.0) -> DataFrame:
    """(keys, j, v): signed generalised mean of each coordinate."""
    x = rows.select(*keys, F.posexplode(vec).alias("j", "v")).groupBy(*keys, "j").agg(F.avg(F.signum("v") * F.pow(F.abs("v"), power)).alias("m"))
    return x.select(*keys, "j", (F.signum("m") * F.pow(F.abs("m"), 1 / power)).alias("v"))


def sign_sketch(rows: DataFrame, key: str, vec: str, width: int, dims: int, seed: str) -> DataFrame:
    """(key, sketch): wide arrays brought to ``dims`` numbers by hashed signs, the same on every machine."""
    import hashlib

    sign = lambda i, j: 1.0 if int(hashlib.md5(f"{seed}|{i}|{j}".encode()).hexdigest()[:1], 16) < 8 else -1.0
    plane = lambda i: F.array(*[F.lit(sign(i, j)) for j in range(width)])
    return rows.select(key, F.array(*[dot(doubles(vec), plane(i)) / dims**0.5 for i in range(dims)]).alias("sketch"))


def trust_weights(rules: DataFrame, measured: DataFrame, key: str, default: Mapping[str, float], kind: str) -> DataFrame:
    """The measured trust of a rule's feature where there is one, else the default of its kind, else 0.5."""
    d = F.create_map(*[F.lit(x) for kv in default.items() for x in kv])
    return rules.join(measured.select(key, F.col("trust").alias("_m")), key, "left").withColumn("trust", F.coalesce("_m", F.try_element_at(d, F.col(kind)), F.lit(0.5))).drop("_m")


def outlook(scores: DataFrame, concepts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(batch, outcome, outlook): the mean over concepts of score (turned if inverse) times the sign of the literature, weighted by
    consensus and by how many answers there are (min(1, n / 5), a fixed value)."""
    x = scores.join(F.broadcast(concepts), "concept").join(evidence, "concept")
    w = F.col("consensus") * F.least(F.lit(1.0), F.col("n") / 5)
    return x.groupBy("batch", "outcome").agg((F.sum(F.when(F.col("inverse"), -F.col("score")).otherwise(F.col("score")) * F.col("sign") * w) / F.sum(w)).alias("outlook"))


def best_of(draws: DataFrame, draw: str, name: str, value: str) -> DataFrame:
    """The share of draws in which each one is the best (equal: smaller name)."""
    top = draws.groupBy(draw).agg(F.min_by(name, F.struct(-F.col(value), F.col(name))).alias(name))
    n = draws.agg(F.countDistinct(draw).alias("_n"))
    return top.groupBy(name).agg(F.count("*").alias("_k")).join(F.broadcast(n)).select(name, (F.col("_k") / F.col("_n")).alias("p_best"))

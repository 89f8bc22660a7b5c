"""Raster operators on a pixel table (img, y, x, v): every image is a partition key, so nothing crosses images.

Neighbourhoods are windows along rows or columns (lag and lead), not self-joins, wherever the stencil is separable; offset
joins serve the others, as equi-joins on shifted places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(arrays: DataFrame, img: str | Column, line: str, values: str) -> DataFrame:
    """(img, y, x, v) of rows that hold one line each as an array."""
    i = F.col(img) if isinstance(img, str) else img
    return arrays.select(i.alias("img"), F.col(line).alias("y"), F.posexplode(values).alias("x", "v")).withColumn("v", F.col("v").cast("double"))


def tiled(px: DataFrame, size: int) -> DataFrame:
    """Tile row and column of each pixel (RAS-2, RAS-5)."""
    return px.withColumns({"tr": F.floor(F.col("y") / size), "tc": F.floor(F.col("x") / size)})


def block_mean(px: DataFrame, factor: int) -> DataFrame:
    return tiled(px, factor).groupBy("img", F.col("tr").alias("y"), F.col("tc").alias("x")).agg(F.avg("v").alias("v"))


def neighbours(px: DataFrame, value: str = "v") -> DataFrame:
    """The 3 x 3 neighbourhood as columns n00 .. n22 (row, column), null outside: two windows, no join."""
    row, col = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    side = px.withColumns({"_l": F.lag(value).over(row), "_r": F.lead(value).over(row)})
    out = {}
    for j, c in enumerate(("_l", value, "_r")):
        out |= {f"n0{j}": F.lag(c).over(col), f"n1{j}": F.col(c), f"n2{j}": F.lead(c).over(col)}
    return side.withColumns(out).drop("_l", "_r")


def stencil(weights: Sequence[Sequence[float]]) -> Column:
    """Weighted sum over a neighbourhood made by ``neighbours``; null at the border."""
    total = None
    for i, line in enumerate(weights):
        for j, w in enumerate(line):
            if w:
                term = F.col(f"n{i}{j}") * w
                total = term if total is None else total + term
    return total


def noise_sigma(px: DataFrame) -> DataFrame:
    """Noise by the mean absolute response to the difference of two Laplacians, per image."""
    r = neighbours(px).select("img", stencil([[1, -2, 1], [-2, 4, -2], [1, -2, 1]]).alias("r"))
    return r.groupBy("img").agg((F.avg(F.abs("r")) * F.sqrt(F.lit(3.141592653589793) / 2) / 6).alias("sigma"))


def histogram(px: DataFrame, keys: Sequence[str], low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin 0 .. bins - 1, n); values outside fall into the end bins."""
    b = F.least(F.greatest(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    return px.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last bin of the dark class, where the variance between the classes is largest (the first one if equal)."""
    part = Window.partitionBy(*keys)
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumns({"w0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("bin")).over(run), "w": F.sum("n").over(part), "s": F.sum(F.col("n") * F.col("bin")).over(part)})
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    between = F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - s1 / w1, 2) / (F.col("w") * F.col("w"))
    return h.where(w1 > 0).withColumn("between", between).groupBy(*keys).agg(F.min_by("bin", F.struct(-F.col("between"), F.col("bin"))).alias("level"))


def entropy(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return hist.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("bits"), F.max("p").alias("top_share"))


def mutual_information(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two codes in bits, and divided by the smaller entropy."""
    j = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    all_ = j.agg(F.sum("n").alias("t"))
    j = j.join(F.broadcast(all_)).withColumn("p", F.col("n") / F.col("t"))
    m = j.withColumns({"pa": F.sum("p").over(Window.partitionBy(a)), "pb": F.sum("p").over(Window.partitionBy(b))})
    ha = j.groupBy(a).agg(F.sum("p").alias("q")).agg((-F.sum(F.col("q") * F.log2("q"))).alias("ha"))
    hb = j.groupBy(b).agg(F.sum("p").alias("q")).agg((-F.sum(F.col("q") * F.log2("q"))).alias("hb"))
    mi = m.agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"))
    return mi.join(F.broadcast(ha)).join(F.broadcast(hb)).select("mi", (F.col("mi") / F.least("ha", "hb")).alias("mi_norm"))


def dilate(mask: DataFrame, reach: int = 1, square: bool = False) -> DataFrame:
    """(img, y, x) within ``reach`` steps of the mask: by the four neighbours, or the square."""
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if square or abs(dy) + abs(dx) <= reach]
    moves = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])
    return mask.select("img", F.explode(moves).alias("p")).select("img", "p.y", "p.x").distinct()


def erode(mask: DataFrame, reach: int = 1, square: bool = False) -> DataFrame:
    """Places whose whole neighbourhood is in the mask (outside counts as empty): each place is counted by its neighbours."""
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if square or abs(dy) + abs(dx) <= reach]
    moves = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])
    hits = mask.select("img", F.explode(moves).alias("p")).groupBy("img", "p.y", "p.x").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(steps)).select("img", "y", "x")


def boundary(mask: DataFrame) -> DataFrame:
    """Mask pixels with a 4-neighbour outside the mask."""
    return mask.join(erode(mask), ["img", "y", "x"], "left_anti")


def crossings(px: DataFrame, flag: Column) -> DataFrame:
    """Changes of the flag along rows and columns, and the pixels, by image (SPA-4)."""
    row, col = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    m = px.select("img", "y", "x", flag.cast("int").alias("m"))
    d = m.select("img", F.abs(F.col("m") - F.lag("m").over(row)).alias("dx"), F.abs(F.col("m") - F.lag("m").over(col)).alias("dy"), "m")
    return d.groupBy("img").agg(F.coalesce(F.sum("dx"), F.lit(0)).alias("nx"), F.coalesce(F.sum("dy"), F.lit(0)).alias("ny"), F.sum("m").alias("area"), F.count("*").alias("n"))


def chords(px: DataFrame, flag: Column) -> DataFrame:
    """Runs of set pixels along rows: (img, y, run, length)."""
    from .ordered import runs

    m = px.select("img", "y", "x", flag.cast("int").alias("m"))
    return runs(m, ["img", "y"], ["x"], "m").where("m = 1").select("img", "y", "run", "length")


def two_point(px: DataFrame, flag: Column, lags: Sequence[int]) -> DataFrame:
    """S2(r) along rows: how often both ends of a step r are set."""
    row = Window.partitionBy("img", "y").orderBy("x")
    m = px.select("img", "y", "x", flag.cast("double").alias("m"))
    m = m.withColumns({f"_{r}": F.col("m") * F.lead("m", r).over(row) for r in lags})
    e = m.select("img", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"_{r}").alias("p")) for r in lags])).alias("e"))
    return e.where("e.p IS NOT NULL").groupBy("img", F.col("e.r").alias("r")).agg(F.avg("e.p").alias("s2"))


def co_occurrence(px: DataFrame, levels: int, low: float, high: float, dy: int, dx: int) -> DataFrame:
    """Symmetric grey-level co-occurrence counts of one step: (img, i, j, n)."""
    q = F.least(F.greatest(F.floor((F.col("v") - low) / (high - low) * levels), F.lit(0)), F.lit(levels - 1)).cast("int")
    a = px.select("img", "y", "x", q.alias("i"))
    b = a.select("img", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("i").alias("j"))
    p = a.join(b, ["img", "y", "x"]).groupBy("img", "i", "j").agg(F.count("*").alias("n"))
    return p.unionByName(p.select("img", F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("img", "i", "j").agg(F.sum("n").alias("n"))


def glcm_properties(counts: DataFrame) -> DataFrame:
    """Contrast, homogeneity, energy, correlation by image."""
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("img")))
    p = p.withColumn("mu", F.sum(F.col("p") * F.col("i")).over(Window.partitionBy("img")))
    d = F.col("i") - F.col("j")
    var = F.sum(F.col("p") * F.pow(F.col("i") - F.col("mu"), 2))
    cov = F.sum(F.col("p") * (F.col("i") - F.col("mu")) * (F.col("j") - F.col("mu")))
    return p.groupBy("img").agg(F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"), F.when(var > 0, cov / var).alias("correlation"))


def lbp_histogram(px: DataFrame) -> DataFrame:
    """Uniform local binary patterns of the 8 neighbours: code is the number of set bits, 9 for non-uniform ones."""
    ring = ["n12", "n02", "n01", "n00", "n10", "n20", "n21", "n22"]
    n = neighbours(px).dropna(subset=ring)
    bits = F.array(*[(F.col(c) >= F.col("n11")).cast("int") for c in ring])
    n = n.select("img", bits.alias("b"))
    turned = F.concat(F.slice("b", 2, 7), F.slice("b", 1, 1))
    changes = F.aggregate(F.zip_with("b", turned, lambda a, c: F.abs(a - c)), F.lit(0), lambda s, v: s + v)
    code = F.when(changes <= 2, F.aggregate("b", F.lit(0), lambda s, v: s + v)).otherwise(9)
    return n.groupBy("img", code.alias("code")).agg(F.count("*").alias("n"))


def window_fraction(px: DataFrame, flag: Column, reach: int) -> DataFrame:
    """Share of set pixels in the (2 reach + 1)-square about each pixel, over the pixels that exist: two window sums."""
    row = Window.partitionBy("img", "y").orderBy("x").rangeBetween(-reach, reach)
    col = Window.partitionBy("img", "x").orderBy("y").rangeBetween(-reach, reach)
    m = px.select("img", "y", "x", flag.cast("double").alias("m")).withColumns({"_s": F.sum("m").over(row), "_n": F.count("m").over(row)})
    return m.select("img", "y", "x", (F.sum("_s").over(col) / F.sum("_n").over(col)).alias("share"))


def euler_number(mask: DataFrame) -> DataFrame:
    """Objects minus holes (4-connected): pixels - neighbour pairs + full 2 x 2 blocks, by image."""
    key = ["img", "y", "x"]
    right = mask.select("img", "y", (F.col("x") - 1).alias("x"))
    down = mask.select("img", (F.col("y") - 1).alias("y"), "x")
    diag = mask.select("img", (F.col("y") - 1).alias("y"), (F.col("x") - 1).alias("x"))
    m = mask.withColumn("v", F.lit(1)).join(right.withColumn("r", F.lit(1)), key, "left").join(down.withColumn("d", F.lit(1)), key, "left").join(diag.withColumn("q", F.lit(1)), key, "left")
    return m.groupBy("img").agg((F.count("v") - F.count("r") - F.count("d") + F.count_if(F.col("r").isNotNull() & F.col("d").isNotNull() & F.col("q").isNotNull())).alias("euler"))

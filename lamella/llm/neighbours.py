"""Problem 1: the most similar vectors of every vector, by a forest of random-projection trees and exact reranking.

Every vector is placed in the leaves that a shared priority queue over the trees gives it, and within each leaf all vectors are
compared with each other; so a pair is found if the two share one of their leaves. Spaces of up to ``leaf_rows`` vectors are one
leaf and thus exact. Depth and visits grow with the space (``depth_of``, ``visits_of``), so that recall does not fall with its
size. The trees' thresholds come from a bounded sample (SAMPLE_PER_LEAF rows a leaf and at least LEAST_SAMPLE a space); every
vector is indexed. Vectors travel to the leaves with 20 bits a coordinate, which leaves cosines right to within NEAR / 4;
candidates whose order or place at the threshold that could change are compared again with the vectors themselves, in double.
Large classes of exact copies take part with one representative that stands for its six smallest ids, which is all that any
list of five can need; smaller classes are reduced in the same way within a leaf, so no leaf compares all pairs of copies.

Null, short, NaN, infinite and all-zero vectors take no part; a repeated delivery counts once; equal similarities go by the
smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.session import cut

from .plans import spread
from .vectors import Forest, large_copy_classes, packed, sound_vectors, unit_rows, unpacked, without_copies

LEAF_ROWS, TREES, SEED = 4096, 2, 20260701
SAMPLE_PER_LEAF, LEAST_SAMPLE = 64, 2048
#: Cosines of packed vectors that lie closer together than this are made again in double.
NEAR = 4e-6
#: Up to so many ids of such pairs are sent to all executors; more are joined by shuffle.
FEW = 500_000


def depth_of(n: int, leaf_rows: int) -> int:
    """Levels of the trees of a space of n vectors: leaves of ``leaf_rows`` down to level 4, then three levels for each factor
    of 16, so that deep trees have larger leaves rather than pairs that are torn apart more often."""
    levels = max(0, math.ceil(math.log2(n / leaf_rows))) if n else 0
    return levels if levels <= 4 else 4 + math.ceil(0.75 * (levels - 4))


def visits_of(depth: int) -> int:
    """Leaves to visit: found by trial so that at least 95 % of pairs at a cosine of 0.86 share a leaf (see the README)."""
    return max(4, math.ceil(depth * depth / 5.5))


def fit_forests(vectors: DataFrame, sizes: dict[str, int], leaf_rows: int, trees: int, seed: int = SEED) -> dict[str, Forest]:
    """A forest for every space, a task for each tree; of the sample only the projections travel, four bytes a level.
    Thresholds come back, four bytes a node."""
    depths = {s: depth_of(n, leaf_rows) for s, n in sizes.items() if n}
    forests = {s: Forest(seed, 0, np.zeros((trees, 1), dtype=np.float32)) for s in depths}
    shares = {s: min(1.0, max(LEAST_SAMPLE, SAMPLE_PER_LEAF << d) / sizes[s]) for s, d in depths.items() if d}
    if not shares:
        return forests
    spark = vectors.sparkSession
    share = F.broadcast(spark.createDataFrame(list(shares.items()), "space string, share double"))
    drawn = vectors.join(share, "space").where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for space, part in b.groupby("space", sort=False):
                unit = unit_rows(part["x"]).astype(np.float32)
                for t in range(trees):
                    p = unit @ Forest.directions(seed, t, depths[space], unit.shape[1])
                    yield pd.DataFrame({"space": space, "tree": t, "p": [row.tobytes() for row in p]})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        space = rows["space"].iloc[0]
        p = np.frombuffer(b"".join(rows["p"]), dtype=np.float32).reshape(len(rows), -1)
        return pd.DataFrame({"space": [space], "tree": [rows["tree"].iloc[0]], "thresholds": [Forest.split(p, depths[space]).tobytes()]})

    fitted = drawn.mapInPandas(project, "space string, tree int, p binary").groupBy("space", "tree").applyInPandas(fit, "space string, tree int, thresholds binary")
    by: dict[str, dict[int, np.ndarray]] = {}
    for r in fitted.collect():
        by.setdefault(r["space"], {})[r["tree"]] = np.frombuffer(r["thresholds"], dtype=np.float32)
    return forests | {s: Forest(seed, depths[s], np.stack([t[k] for k in range(trees)])) for s, t in by.items()}


def in_leaves(vectors: DataFrame, forests: dict[str, Forest], visits: int | None = None) -> DataFrame:
    """(leaf, vec_id, raw): a row for each visited leaf; leaf numbers hold space, tree and node."""
    number = {s: n for n, s in enumerate(sorted(forests))}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for space, part in b.groupby("space", sort=False):
                f = forests.get(space)
                if f is None:
                    continue
                unit = unit_rows(part["x"])
                raw = packed(unit)
                tree, leaf = f.leaves(unit, visits or visits_of(f.depth))
                key = (number[space] << 40) + (tree << 32) + leaf
                n = key.shape[1]
                yield pd.DataFrame({"leaf": key.ravel(), "vec_id": np.repeat(part["vec_id"].to_numpy(), n), "raw": np.repeat(raw, n)})

    return spread(vectors).mapInPandas(place, "leaf bigint, vec_id bigint, raw binary")


def best_of_block(ids: np.ndarray, unit: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, cosine) of the k most similar others of each row with at least the given cosine (less NEAR), and of those
    that lie within NEAR of the k-th; cosines that round to one are one, so that copies go by id.

    Single precision finds all that can be among the k (with a margin for its error), double precision decides.
    """
    small, out = unit.astype(np.float32), []
    chunk = max(64, min(1024, (1 << 23) // max(1, len(ids))))
    for i in range(0, len(ids), chunk):
        s = small[i : i + chunk] @ small.T
        own = np.arange(len(s))
        s[own, own + i] = -2
        if s.shape[1] > 4 * k:
            close = s.max(axis=1) >= least - 2e-5
            if not close.any():
                continue
            rows = np.nonzero(close)[0]
            s = s[rows]
            cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        else:
            rows, cut = own, np.full(len(s), -1.0, dtype=np.float32)
        a, b = np.nonzero(s >= np.maximum(cut - 2e-5, least - 2e-5)[:, None])
        a = rows[a] + i
        sim = np.einsum("ij,ij->i", unit[a], unit[b])
        sim[sim > 1 - 1e-9] = 1.0
        good = sim >= least - NEAR
        a, b, sim = a[good], b[good], sim[good]
        order = np.lexsort((ids[b], -sim, a))
        a, b, sim = a[order], b[order], sim[order]
        first = np.searchsorted(a, a)
        nth = np.arange(len(a)) - first
        last = sim[np.minimum(first + k - 1, len(a) - 1)] if len(a) else sim
        keep = (nth < k) | ((sim >= last - 2 * NEAR) & (last < 1))
        out.append((ids[a[keep]], ids[b[keep]], sim[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def similar_in_leaves(placed: DataFrame, least: float, k: int) -> DataFrame:
    """(vec, other, sim): the k best of each vector within each of its leaves. Of equal rows k + 1 are compared; each of the
    others has the first one and its list."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("vec_id").sort_values("vec_id").reset_index(drop=True)
        kind = pd.Series(pd.factorize(rows["raw"])[0])
        few = (kind.groupby(kind).cumcount() <= k).to_numpy()
        ids = rows["vec_id"].to_numpy()
        a, b, s = best_of_block(ids[few], unpacked(rows["raw"][few]), least, k)
        out = pd.DataFrame({"vec": a, "other": b, "sim": s})
        if few.all():
            return out
        rep = pd.Series(ids).groupby(kind).transform("first")
        more = pd.DataFrame({"own": ids[~few], "vec": rep[~few].to_numpy()})
        lists = more.merge(out, on="vec").drop(columns="vec").rename(columns={"own": "vec"})
        return pd.concat([out, lists, more.rename(columns={"own": "vec", "vec": "other"}).assign(sim=1.0)])

    return placed.groupBy("leaf").applyInPandas(search, "vec bigint, other bigint, sim double")


def _best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("vec").orderBy(F.desc("sim"), "other"))
    return rows.where("vec <> other").distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def reranked(found: DataFrame, sound: DataFrame, least: float, k: int) -> DataFrame:
    """(vec, other, sim) of the k best of each vector, sim rounded to six places.

    Where the cosines of the k-th and the next candidate lie within NEAR, those about as similar are made again from the vectors
    in double, as are cosines within NEAR of the threshold; the vectors of those few are fetched by id. So the k are the right
    ones; the order among them is that of the packed vectors.
    """
    w, every = Window.partitionBy("vec").orderBy(F.desc("sim"), "other"), Window.partitionBy("vec")
    one = found.where("vec <> other").repartition("vec").groupBy("vec", "other").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(w))
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("sim"))).over(every)
    tied = (F.col("last") - F.col("next") <= NEAR) & (F.col("last") < 1) & (F.abs(F.col("sim") - F.col("last")) <= 2 * NEAR)
    unsure = F.coalesce(tied, F.lit(False)) | (F.abs(F.col("sim") - least) <= NEAR)
    held = one.withColumns({"last": at(k), "next": at(k + 1)}).withColumn("unsure", unsure)
    held = cut(held.where((F.col("rank") <= k) | F.col("unsure")).select("vec", "other", "sim", "unsure"))
    again = held.where("unsure")
    n = again.count()
    sure = held.where("NOT unsure").select("vec", "other", F.round("sim", 6).alias("sim"))
    if n:
        ids = again.select(F.explode(F.array("vec", "other")).alias("vec_id")).distinct()
        rows = sound.join(F.broadcast(ids) if n <= FEW else ids, "vec_id", "left_semi").dropDuplicates(["vec_id"])
        rows = cut(rows.select("vec_id", "x"))

        @F.pandas_udf("double")
        def cosine(p: pd.Series, q: pd.Series) -> pd.Series:
            unit = lambda x: unit_rows([x])[0]  # noqa: E731  (widths may differ from row to row)
            return pd.Series([round(float(unit(u) @ unit(v)), 6) for u, v in zip(p, q)], dtype="float64")

        side = lambda c, x: rows.select(F.col("vec_id").alias(c), F.col("x").alias(x))
        exact = again.select("vec", "other").join(side("vec", "p"), "vec").join(side("other", "q"), "other")
        sure = sure.unionByName(exact.select("vec", "other", cosine("p", "q").alias("sim")))
    return sure.where(F.col("sim") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def nearest(vectors: DataFrame, spaces: DataFrame, k: int = 5, least: float = 0.85, leaf_rows: int = LEAF_ROWS, trees: int = TREES, visits: int | None = None) -> DataFrame:
    """(vec, other, sim, rank) of up to k (at most 5) most similar vectors of the same space, those of at least ``least``."""
    if k > 5:
        raise ValueError("copies are kept for lists of at most five")
    sound = sound_vectors(vectors, spaces)
    sizes, heavy = large_copy_classes(sound)
    single = without_copies(sound, heavy)
    found = reranked(similar_in_leaves(in_leaves(single, fit_forests(single, sizes, leaf_rows, trees), visits), least, k), single, least, k)
    if heavy.empty:
        return _best(found, k)
    # A representative in a list stands for the class's smallest ids, and each member of the class has the representative's list.
    spark = vectors.sparkSession
    ids = spark.createDataFrame(list(zip(heavy["rep"].astype(int).tolist(), [list(map(int, i)) for i in heavy["ids"]])), "rep bigint, ids array<bigint>")
    full = found.join(F.broadcast(ids), F.col("other") == F.col("rep"), "left").select("vec", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "sim")
    full = full.unionByName(ids.select(F.col("rep").alias("vec"), F.explode("ids").alias("other"), F.lit(1.0).alias("sim")))
    marks = spark.createDataFrame(heavy[["mark", "rep"]].astype("int64"))
    members = sound.select("vec_id", F.xxhash64("space", "x").alias("mark")).join(F.broadcast(marks), "mark").select("vec_id", "rep").distinct()
    lists = _best(full.join(F.broadcast(ids.select(F.col("rep").alias("vec"))), "vec", "left_semi").select("vec", "other", "sim")
                  .unionByName(ids.select(F.col("rep").alias("vec"), F.col("rep").alias("other"), F.lit(1.0).alias("sim"))).withColumn("vec", -F.col("vec") - 1), k + 1)
    shared = members.join(F.broadcast(lists.select((-F.col("vec") - 1).alias("rep"), "other", "sim")), "rep").select(F.col("vec_id").alias("vec"), "other", "sim")
    rest = full.join(F.broadcast(ids.select(F.col("rep").alias("vec"))), "vec", "left_anti")
    return _best(rest.unionByName(shared), k)


def similar_pairs(vectors: DataFrame, spaces: DataFrame, k: int = 5, least: float = 0.85, **how: int) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of at least the given similarity where one is among the k most similar of the other."""
    return nearest(vectors, spaces, k, least, **how).select(F.least("vec", "other").alias("vec_a"), F.greatest("vec", "other").alias("vec_b")).distinct()


def same_crop_rate(vectors: DataFrame, spaces: DataFrame) -> DataFrame:
    """(space, n, n_same, rate): of the vectors with a most similar one of at least 0.85, how many have one of their own crop."""
    first = nearest(vectors, spaces, 1)
    crops = vectors.select("vec_id", "space", "crop").where("vec_id IS NOT NULL").dropDuplicates(["vec_id"])
    a, b = crops.withColumnsRenamed({"vec_id": "vec", "crop": "crop_a"}), crops.select(F.col("vec_id").alias("other"), F.col("crop").alias("crop_b"))
    same = (F.col("crop_a") == F.col("crop_b")).cast("bigint")
    return first.join(a, "vec").join(b, "other").groupBy("space").agg(F.count("*").alias("n"), F.coalesce(F.sum(same), F.lit(0)).alias("n_same")).withColumn("rate", F.round(F.col("n_same") / F.col("n"), 6))

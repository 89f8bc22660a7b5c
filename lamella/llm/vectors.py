"""Sound vectors, their copies, and random-projection forests, shared by problems 1 and 4."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A class of exact copies is set aside from this many rows on, and from this share of all rows on; so there are at most
#: 1 / COPY_SHARE such classes, whatever the size of the table.
COPY_ROWS, COPY_SHARE = 500, 1e-4


def sound_vectors(vectors: DataFrame, spaces: DataFrame) -> DataFrame:
    """(vec_id, space, x) of the vectors that are not null, have n_dims values, no NaN, infinity or null, and are not all zero."""
    dims = spaces.select("space", "n_dims").where("space IS NOT NULL").dropDuplicates(["space"])
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select("vec_id", "space", "x").where("vec_id IS NOT NULL AND x IS NOT NULL").join(dims, "space")
        .where((F.size("x") == F.col("n_dims")) & ~bad & F.exists("x", lambda v: v != 0)).select("vec_id", "space", "x")
    )


def unit_rows(xs: pd.Series) -> np.ndarray:
    """Rows of length one, in double: scaled by the largest value first, so that no unit of measure over- or underflows."""
    m = np.stack([np.asarray(x, dtype=np.float64) for x in xs]) if len(xs) else np.empty((0, 1))
    m = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m


def packed(unit: np.ndarray) -> np.ndarray:
    """Rows as bytes, 20 bits a coordinate relative to the row's largest one; cosines keep about six and a half places."""
    q = np.minimum(np.floor(unit / np.abs(unit).max(axis=1, keepdims=True) * (1 << 19)).astype(np.int32) + (1 << 19), (1 << 20) - 1)
    low = (q & 15).astype(np.uint8)
    if low.shape[1] % 2:
        low = np.pad(low, ((0, 0), (0, 1)))
    high, low = (q >> 4).astype("<u2"), low[:, ::2] | low[:, 1::2] << 4
    out = np.empty(len(unit), dtype=object)
    out[:] = [h.tobytes() + b.tobytes() for h, b in zip(high, low)]
    return out


def unpacked(rows: pd.Series) -> np.ndarray:
    """Unit rows from ``packed`` ones of one width; an odd width is told by the length."""
    if not len(rows):
        return np.empty((0, 1))
    size = len(rows.iloc[0])
    width = size * 2 // 5 if size % 5 == 0 else (2 * size - 1) // 5
    raw = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), size)
    high = np.ascontiguousarray(raw[:, : 2 * width]).view("<u2").astype(np.int64)
    low = np.stack([raw[:, 2 * width :] & 15, raw[:, 2 * width :] >> 4], axis=2).reshape(len(rows), -1)[:, :width]
    unit = ((high << 4) + low - (1 << 19)).astype(np.float64) + 0.5
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def large_copy_classes(sound: DataFrame) -> tuple[dict[str, int], pd.DataFrame]:
    """Rows by space, and the large classes of exact copies: (space, mark, rep, ids), ids being the six smallest.

    Two narrow aggregations; the vectors themselves are not moved. Both results are bounded: by the number of spaces, and by
    1 / COPY_SHARE classes.
    """
    marked = sound.select("space", "vec_id", F.xxhash64("space", "x").alias("mark"))
    classes = marked.groupBy("space", "mark").agg(F.count("*").alias("n"))
    sizes = {r["space"]: int(r["n"]) for r in sound.groupBy("space").agg(F.count("*").alias("n")).collect()}
    least = max(COPY_ROWS, int(sum(sizes.values()) * COPY_SHARE))
    heavy = classes.where(F.col("n") >= least).select("space", "mark")
    if heavy.isEmpty():
        return sizes, pd.DataFrame({"space": [], "mark": [], "rep": [], "ids": []})
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("space", "mark").orderBy("vec_id"))
    few = marked.join(F.broadcast(heavy), ["space", "mark"]).distinct().withColumn("r", rank).where("r <= 6")
    held = few.groupBy("space", "mark").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0])
    return sizes, held.select("space", "mark", "rep", "ids").toPandas()


def without_copies(sound: DataFrame, heavy: pd.DataFrame) -> DataFrame:
    """The vectors without the members of large copy classes, but with each class's representative."""
    if heavy.empty:
        return sound
    reps = sound.sparkSession.createDataFrame(heavy[["mark", "rep"]].astype("int64"))
    m = sound.withColumn("mark", F.xxhash64("space", "x")).join(F.broadcast(reps), "mark", "left")
    return m.where("rep IS NULL OR rep = vec_id").select("vec_id", "space", "x")


@dataclass
class Forest:
    """Trees of one space. All nodes of a level split along one random direction, each at the median of its own sample.

    Directions come from the seed, so a tree is kept as its thresholds alone, in heap order (node 1 is the root).
    """

    seed: int
    depth: int
    thresholds: np.ndarray  # trees x 2^depth

    @staticmethod
    def directions(seed: int, tree: int, depth: int, dims: int) -> np.ndarray:
        return np.random.default_rng((seed, tree)).standard_normal((dims, depth)).astype(np.float32)

    @staticmethod
    def split(p: np.ndarray, depth: int) -> np.ndarray:
        """The thresholds of one tree from the projections of its sample (rows x levels)."""
        t, node = np.zeros(1 << depth, dtype=np.float32), np.ones(len(p), dtype=np.int64)
        for level in range(depth):
            order = np.lexsort((p[:, level], node))
            starts = np.searchsorted(node[order], np.arange(1 << level, 2 << level))
            ends = np.append(starts[1:], len(order))
            for n, (a, b) in enumerate(zip(starts, ends)):
                if b > a:  # sorted already: the middle is the median
                    t[(1 << level) + n] = (p[order[(a + b - 1) // 2], level] + p[order[(a + b) // 2], level]) / 2
            node = 2 * node + (p[:, level] > t[node])
        return t

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int, seed: int) -> Forest:
        rows = sample.astype(np.float32)
        return cls(seed, depth, np.stack([cls.split(rows @ cls.directions(seed, k, depth, rows.shape[1]), depth) for k in range(trees)]))

    def leaves(self, unit: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """(tree, leaf) visited by each row, n x visits.

        One queue holds the open branches of all trees, ordered by the sum of the squared margins crossed on the way; the roots
        come first, then the other sides of the closest splits, whichever tree they are in.
        """
        n, trees, depth = len(unit), len(self.thresholds), self.depth
        rows = np.arange(n)
        if depth == 0:
            return np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1), dtype=np.int64)
        p = np.stack([unit.astype(np.float32) @ self.directions(self.seed, k, depth, unit.shape[1]) for k in range(trees)], axis=1)
        cap = trees + visits * depth
        cost = np.full((n, cap), np.inf, dtype=np.float32)
        tree, node, level = (np.zeros((n, cap), dtype=np.int64) for _ in range(3))
        cost[:, :trees], tree[:, :trees], node[:, :trees] = 0, np.arange(trees), 1
        used, out_tree, out_leaf = trees, [], []
        for _ in range(visits):
            j = cost.argmin(axis=1)
            c, k, at, lv = cost[rows, j], tree[rows, j], node[rows, j], level[rows, j]
            cost[rows, j] = np.inf
            for step in range(depth):
                go = lv <= step
                margin = p[rows, k, step] - self.thresholds[k, np.where(go, at, 1)]
                up = (margin > 0).astype(np.int64)
                cost[:, used] = np.where(go, c + margin * margin, np.inf)
                tree[:, used], node[:, used], level[:, used] = k, 2 * at + 1 - up, step + 1
                at = np.where(go, 2 * at + up, at)
                used += 1
            out_tree.append(k)
            out_leaf.append(at)
        return np.stack(out_tree, axis=1), np.stack(out_leaf, axis=1)

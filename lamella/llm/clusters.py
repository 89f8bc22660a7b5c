"""Problem 4: clusters of mutually similar vectors and their most typical members, by distributed k-means.

Centroids of each space are seeded by parallel oversampling (each round draws rows with a probability in proportion to their
squared distance from the centroids so far) and moved by Lloyd steps, on a bounded hash sample (SAMPLE_PER_CELL rows a
centroid); then every vector is sent to the cells of its SPILL nearest centroids, with eight bits a coordinate. Within a cell
all pairs are compared, with the threshold lowered by what eight bits may be off, and each linked vector reports the smallest
id of its linked set, so links never leave a task as pairs. Sets that share a vector are joined by connected components over
the reported ids alone, and every set is then checked, with the vectors themselves in double, to be one in which every two are
similar. Vectors within half the angle of their centroid (strong ones) are similar to each other without comparing them. Cells
that are expected to outgrow BLOCK rows are taken in pairs of lots: weak ones with weak ones and weak ones with strong ones, so
that no task holds more than two lots.

Null, short, NaN, infinite and all-zero vectors take no part; a repeated delivery counts once; large classes of exact copies
take part with one vector of their weight; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import cut

from .components import hook_and_shortcut
from .plans import by_group, spread
from .vectors import large_copy_classes, sound_vectors, unit_rows, without_copies

CELL_ROWS, SAMPLE_PER_CELL, SPILL, ROUNDS, STEPS, BLOCK, SEED = 768, 48, 3, 3, 2, 8192, 11
#: A space has at most so many cells times the root of its rows, which bounds what the driver and the closures hold.
CELLS = 2


def coded(unit: np.ndarray) -> np.ndarray:
    """Rows as bytes, eight bits a coordinate relative to the row's largest one."""
    out = np.empty(len(unit), dtype=object)
    out[:] = [q.tobytes() for q in np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)]
    return out


def decoded(raw: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of coded ones, and what each one's cosines may be off: a coordinate is off by half a step with any sign, so
    the part along another vector has a deviation of step / sqrt(12); seven of those are allowed for."""
    q = np.stack([np.frombuffer(r, dtype=np.int8) for r in raw]).astype(np.float64)
    n = np.linalg.norm(q, axis=1, keepdims=True)
    return q / n, 7 / math.sqrt(12) / n[:, 0]


def _raw(xs: pd.Series) -> np.ndarray:
    out = np.empty(len(xs), dtype=object)
    out[:] = [np.asarray(x, dtype=np.float32).tobytes() for x in xs]
    return out


def _units(raw: pd.Series) -> np.ndarray:
    return unit_rows(raw.map(lambda r: np.frombuffer(r, dtype=np.float32)))


def _by_space(b: pd.DataFrame, centers: dict[str, np.ndarray]) -> Iterator[tuple[str, pd.DataFrame, np.ndarray, np.ndarray]]:
    """Space, its rows, their unit vectors and cosines to its centroids."""
    for space, part in b.groupby("space", sort=False):
        if space in centers:
            unit = _units(part["raw"])
            yield space, part, unit, unit.astype(np.float32) @ centers[space].T.astype(np.float32)


def _gather(rows: DataFrame) -> dict[str, np.ndarray]:
    """Centroids to the driver: their number is bounded by the number of cells (times the oversampling while seeding)."""
    found: dict[str, list[np.ndarray]] = {}
    for r in rows.orderBy("space", "at").collect():
        found.setdefault(r["space"], []).append(np.frombuffer(r["raw"], dtype=np.float32))
    return {s: unit_rows(pd.Series(v)).astype(np.float32) for s, v in found.items()}


def seed_centroids(sample: DataFrame, cells: dict[str, int], rounds: int = ROUNDS, seed: int = SEED) -> dict[str, np.ndarray]:
    """k-means|| seeding for all spaces at once; the weighted candidates are thinned out to the wanted number."""
    first = sample.groupBy("space").agg(F.min_by("raw", F.xxhash64("vec_id", F.lit(seed))).alias("raw")).withColumn("at", F.lit(0))
    centers = _gather(first)
    for r in range(rounds):
        held = centers

        def spent(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                for s, _, _, c in _by_space(b, held):
                    yield pd.DataFrame({"space": [s], "cost": [float(np.maximum(0, 2 - 2 * c.max(axis=1)).sum())]})

        cost = {x["space"]: x["cost"] for x in sample.mapInPandas(spent, "space string, cost double").groupBy("space").agg(F.sum("cost").alias("cost")).collect()}

        def draw(batches: Iterator[pd.DataFrame], held=held, cost=cost, r=r) -> Iterator[pd.DataFrame]:
            for b in batches:
                for s, part, _, c in _by_space(b, held):
                    share = 2.0 * cells[s] / rounds * np.maximum(0, 2 - 2 * c.max(axis=1)) / max(cost[s], 1e-12)
                    ids = part["vec_id"].to_numpy().astype(np.uint64)
                    with np.errstate(over="ignore"):
                        h = (ids + np.uint64(seed * 131 + r)) * np.uint64(0x9E3779B97F4A7C15)
                        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    lot = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)) / float(1 << 53)
                    new = part[lot < share]
                    if len(new) and cells[s] > 1:
                        yield pd.DataFrame({"space": s, "at": new["vec_id"], "raw": new["raw"]})

        more = _gather(sample.mapInPandas(draw, "space string, at bigint, raw binary"))
        centers = {s: np.concatenate([c, more[s]]) if s in more else c for s, c in centers.items()}

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, _, _, c in _by_space(b, centers):
                at, n = np.unique(c.argmax(axis=1), return_counts=True)
                yield pd.DataFrame({"space": s, "at": at, "n": n})

    weights: dict[str, np.ndarray] = {s: np.zeros(len(c)) for s, c in centers.items()}
    for x in sample.mapInPandas(weigh, "space string, at bigint, n bigint").groupBy("space", "at").agg(F.sum("n").alias("n")).collect():
        weights[x["space"]][x["at"]] = x["n"]
    return {s: _thin(c, weights[s], cells[s]) for s, c in centers.items()}


def _thin(c: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k of the candidates: each next one has the largest weighted squared distance from those taken."""
    if len(c) <= k:
        return c
    taken, far = [int(weight.argmax())], np.full(len(c), np.inf)
    while len(taken) < k:
        far = np.minimum(far, np.maximum(0, 2 - 2 * (c @ c[taken[-1]])))
        taken.append(int((far * weight).argmax()))
    return c[sorted(set(taken))]


def move_centroids(sample: DataFrame, centers: dict[str, np.ndarray], steps: int = STEPS) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Lloyd steps with sums per partition before the shuffle; also the rows of the sample at each centroid."""
    for _ in range(max(1, steps)):
        held = centers

        def sums(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            total: dict[tuple[str, int], list] = {}
            for b in batches:
                for s, _, unit, c in _by_space(b, held):
                    at = c.argmax(axis=1)
                    for a in np.unique(at):
                        t = total.setdefault((s, int(a)), [0.0, 0])
                        t[0], t[1] = t[0] + unit[at == a].sum(axis=0), t[1] + int((at == a).sum())
            if total:
                yield pd.DataFrame([(s, a, t[0].tobytes(), t[1]) for (s, a), t in total.items()], columns=["space", "at", "part", "n"])

        def mean(rows: pd.DataFrame) -> pd.DataFrame:
            v = np.sum([np.frombuffer(p) for p in rows["part"]], axis=0)
            raw = (v / max(np.linalg.norm(v), 1e-30)).astype(np.float32).tobytes()
            return pd.DataFrame({"space": [rows["space"].iloc[0]], "at": [rows["at"].iloc[0]], "raw": [raw], "n": [rows["n"].sum()]})

        new = sample.mapInPandas(sums, "space string, at bigint, part binary, n bigint").groupBy("space", "at").applyInPandas(mean, "space string, at bigint, raw binary, n bigint")
        by: dict[str, tuple[list, list]] = {}
        for x in new.orderBy("space", "at").collect():
            v, n = by.setdefault(x["space"], ([], []))
            v.append(np.frombuffer(x["raw"], dtype=np.float32))
            n.append(x["n"])
        centers = {s: np.stack(v) for s, (v, _) in by.items()}
    return centers, {s: np.array(n) for s, (_, n) in by.items()}


def spread_of(sample: DataFrame, centers: dict[str, np.ndarray], core: float) -> dict[str, np.ndarray]:
    """Rows of the sample that each cell will hold, by space: (weak, strong) a cell."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, _, _, c in _by_space(b, centers):
                at, row = _cells(c)
                key, n = np.unique(at * 2 + (c[row, at] >= core), return_counts=True)
                yield pd.DataFrame({"space": s, "at": key, "n": n})

    out = {s: np.zeros((len(c), 2)) for s, c in centers.items()}
    for r in sample.mapInPandas(count, "space string, at bigint, n bigint").groupBy("space", "at").agg(F.sum("n").alias("n")).collect():
        out[r["space"]][divmod(r["at"], 2)] = r["n"]
    return out


def _cells(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of the SPILL nearest centroids of each row, from its cosines to all of them."""
    n = min(SPILL, c.shape[1])
    near = np.argpartition(-c, n - 1, axis=1)[:, :n] if n < c.shape[1] else np.tile(np.arange(n), (len(c), 1))
    return near.ravel(), np.repeat(np.arange(len(c)), n)


def _blocks(rows: np.ndarray, strong: np.ndarray, weak_lots: np.ndarray, strong_lots: np.ndarray, lot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, place in rows) of every copy. No lots: block 0 for all. Else a weak row of lot q goes to the blocks (q, p) of
    all lots p of strong rows and to (q, j) of all lots of weak rows; a strong one of lot p to the blocks (q, p) of all q."""
    whole = np.flatnonzero(weak_lots == 0)
    at, block = [whole], [np.zeros(len(whole), dtype=np.int64)]
    many = np.flatnonzero(weak_lots > 0)

    def add(own: np.ndarray, times: np.ndarray, number) -> None:
        again = np.repeat(own, times)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        at.append(again)
        block.append(number(again, nth))

    w, s = many[~strong[many]], many[strong[many]]
    q, p = lot % np.maximum(weak_lots, 1), lot % np.maximum(strong_lots, 1)
    add(w, strong_lots[w], lambda r, n: 1 + q[r] * strong_lots[r] + n)
    add(s, weak_lots[s], lambda r, n: 1 + n * strong_lots[r] + p[r])
    add(w, weak_lots[w], lambda r, n: 1 + weak_lots[r] * strong_lots[r] + np.minimum(q[r], n) * weak_lots[r] + np.maximum(q[r], n))
    return rows[np.concatenate(at)], np.concatenate(block), np.concatenate(at)


def linked_sets(unit: np.ndarray, ids: np.ndarray, least: float, weak: np.ndarray | None = None, chunk: int = 1024, off: np.ndarray | None = None) -> np.ndarray:
    """The smallest id of each row's linked set (its own where it has no link); only rows of ``weak`` are compared if given.

    Each row is joined to its first partner; of the other pairs only those that still join two sets are looked at one by one.
    With ``off``, what each row's cosines may be off, the threshold is lowered by that of both rows (in root of squares);
    without it, double precision decides the pairs next to the threshold.
    """
    n = len(ids)
    small, label = unit.astype(np.float32), np.arange(n)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def roots() -> np.ndarray:
        r = label
        while (r[r] != r).any():
            r = r[r]
        return r

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            for x, y in zip(a[:2000].tolist(), b[:2000].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    label[max(x, y)] = min(x, y)
            a, b = a[2000:], b[2000:]
            if len(a):
                r = roots()
                open_ = r[a] != r[b]
                a, b = a[open_], b[open_]

    rows = np.arange(n) if weak is None else np.nonzero(weak)[0]
    for i in range(0, len(rows), chunk):
        own = rows[i : i + chunk]
        s = small[own] @ small.T
        s[np.arange(len(own)), own] = -2
        sure = s >= (least + 1e-5 if off is None else least - np.hypot(off[own][:, None], off[None, :]).astype(np.float32))
        first = sure.argmax(axis=1)
        some = sure[np.arange(len(own)), first]
        join(own[some], first[some])
        r = roots()
        a, b = np.nonzero(sure & (r[own][:, None] != r[None, :]))
        join(own[a], b)
        if off is not None:
            continue
        a, b = np.nonzero((s >= least - 1e-5) & ~sure)
        a = own[a]
        close = np.round(np.einsum("ij,ij->i", unit[a], unit[b]), 6) >= least
        join(a[close], b[close])
    r = roots()
    best = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(best, r, ids)
    return best[r]


def _peeled(unit: np.ndarray, weight: np.ndarray, least: float, chunk: int = 512) -> list[np.ndarray]:
    """Sets of weight 3 or more in which every two rows are similar: of the row of highest degree and its partners those with
    the fewest partners go until all are similar, then the rest follows. Similarities are made as needed, never kept as a square."""
    near = lambda a, b: a @ b.T >= least - 5e-7  # noqa: E731  (at six places)

    def degrees(of: np.ndarray, among: np.ndarray) -> np.ndarray:
        return np.concatenate([near(unit[of[i : i + chunk]], unit[among]) @ weight[among] for i in range(0, len(of), chunk)]) if len(of) else np.zeros(0)

    left, out = np.arange(len(unit)), []
    degree = degrees(left, left)
    while len(left) and degree.max() >= 3:
        start = left[degree.argmax()]
        pick = left[near(unit[left], unit[start])]
        inner = degrees(pick, pick)
        while (inner < weight[pick].sum()).any():
            worst = inner.argmin()
            inner = inner - weight[pick[worst]] * near(unit[pick], unit[pick[worst]])
            pick, inner = np.delete(pick, worst), np.delete(inner, worst)
        gone = pick if weight[pick].sum() >= 3 else np.array([start])
        if gone is pick:
            out.append(pick)
        stay = ~np.isin(left, gone)
        left, degree = left[stay], degree[stay]
        degree = degree - degrees(left, gone)
    return out


def typical_of(ids: np.ndarray, unit: np.ndarray, weight: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(id, typical id) for the clusters of one linked set; a row of weight w stands for w copies."""
    if len(ids) == 1:
        return [(int(ids[0]), int(ids[0]))] if weight[0] >= 3 else []
    out = []
    if len(ids) <= 1024:
        sim = np.round(unit @ unit.T, 6)
        if (sim >= least).all():
            mean = np.round((sim @ weight - 1) / max(weight.sum() - 1, 1), 6)
            best = int(ids[np.lexsort((ids, -mean))[0]])
            return [(int(i), best) for i in ids] if weight.sum() >= 3 else []
    whole = all((np.round(unit[i : i + 1024] @ unit.T, 6) >= least).all() for i in range(0, len(ids), 1024))
    parts = [np.arange(len(ids))] if whole else _peeled(unit, weight, least)
    for p in parts:
        w, u = weight[p], unit[p]
        if w.sum() >= 3:
            total = np.concatenate([np.round(u[i : i + 1024] @ u.T, 6) @ w for i in range(0, len(p), 1024)])
            mean = np.round((total - 1) / (w.sum() - 1), 6)
            best = int(ids[p][np.lexsort((ids[p], -mean))[0]])
            out += [(int(i), best) for i in ids[p]]
    return out


def cluster_members(vectors: DataFrame, spaces: DataFrame, least: float = 0.90, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """(vec_id, typical_id) for each member of a cluster; see the module's text."""
    spark = vectors.sparkSession
    sound = sound_vectors(vectors, spaces)
    sizes, heavy = large_copy_classes(sound)
    single = without_copies(sound, heavy)
    empty = spark.createDataFrame([], "vec_id bigint, typical_id bigint")
    if not sizes:
        return empty
    cells = {s: max(1, math.ceil(min(n / cell_rows, CELLS * math.sqrt(n)))) for s, n in sizes.items()}
    shares = {s: min(1.0, SAMPLE_PER_CELL * max(8, cells[s]) / n) for s, n in sizes.items()}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"space": b["space"], "vec_id": b["vec_id"], "raw": _raw(b["x"])})

    share = F.broadcast(spark.createDataFrame(list(shares.items()), "space string, share double"))
    drawn = single.join(share, "space").where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    sample = cut(drawn.mapInPandas(pack, "space string, vec_id bigint, raw binary"))
    centers, _ = move_centroids(sample, seed_centroids(sample, cells))
    number = {s: n for n, s in enumerate(sorted(sizes))}
    core = math.cos(math.acos(least) / 2) + 1e-6
    lots = {}
    for s, n in spread_of(sample, centers, core).items():
        lots[s] = np.ceil(n / shares[s] / block).astype(np.int64)
        lots[s][:, 0] = np.where(n.sum(axis=1) / shares[s] > block, np.maximum(1, lots[s][:, 0]), 0)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for space, part in b.groupby("space", sort=False):
                if space not in centers:
                    continue
                unit, ids = unit_rows(part["x"]), part["vec_id"].to_numpy()
                raw, c = coded(unit), unit.astype(np.float32) @ centers[space].T
                at, row = _cells(c)
                strong = c[row, at] >= core
                weak_lots, strong_lots = lots[space][at].T
                row, block_no, copy = _blocks(row, strong, weak_lots, strong_lots, ids[row] * 2654435761 >> 7)
                yield pd.DataFrame({"cell": (number[space] << 32) + at[copy], "block": block_no, "vec_id": ids[row], "raw": raw[row],
                                    "strong": strong[copy] & (weak_lots[copy] > 0)})

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("vec_id")
        ids, strong = rows["vec_id"].to_numpy(), rows["strong"].to_numpy()
        unit, off = decoded(rows["raw"])
        root = linked_sets(unit, ids, least, ~strong if strong.any() else None, off=off)
        out = pd.DataFrame({"vec": ids, "root": root})
        if strong.any():  # all of the cell's strong rows are similar to each other: they meet in one name for the cell
            out = pd.concat([out, pd.DataFrame({"vec": ids[strong], "root": -1 - int(rows["cell"].iloc[0])})])
        counts = out["root"].map(out["root"].value_counts())
        return out[(counts > 1) | (out["root"] < 0)]

    placed = spread(single).mapInPandas(place, "cell bigint, block bigint, vec_id bigint, raw binary, strong boolean")
    named = cut(placed.groupBy("cell", "block").applyInPandas(link, "vec bigint, root bigint").groupBy("vec").agg(F.array_sort(F.collect_set("root")).alias("roots")))
    ties = named.where(F.size("roots") > 1).select(F.col("roots")[0].alias("src"), F.explode(F.expr("slice(roots, 2, size(roots) - 1)")).alias("dst"))
    joined = hook_and_shortcut(ties)
    labels = named.select("vec", F.col("roots")[0].alias("root")).join(joined.select(F.col("id").alias("root"), "group_id"), "root", "left")
    weights = spark.createDataFrame([(int(r), float(n)) for r, n in _class_sizes(sound, heavy)], "vec bigint, weight double")
    labels = labels.select("vec", F.coalesce("group_id", "root").alias("label")).join(F.broadcast(weights), "vec", "full").select("vec", F.coalesce("label", "vec").alias("label"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    labels = cut(labels)
    large = labels.groupBy("label").count().where(F.col("count") > block).select("label")
    members = labels.join(single.select(F.col("vec_id").alias("vec"), "x"), "vec")
    found = _small(members.join(large, "label", "left_anti"), least)
    if not large.isEmpty():
        found = found.unionByName(_large(members.join(large, "label", "left_semi"), least, core, block))
    if heavy.empty:
        return found.distinct()
    marks = spark.createDataFrame(heavy[["mark", "rep"]].astype("int64"))
    copies = sound.select("vec_id", F.xxhash64("space", "x").alias("mark")).join(F.broadcast(marks), "mark").select(F.col("vec_id").alias("copy"), F.col("rep").alias("vec_id"))
    return found.unionByName(copies.join(found, "vec_id").select(F.col("copy").alias("vec_id"), "typical_id")).distinct()


def _class_sizes(sound: DataFrame, heavy: pd.DataFrame) -> list[tuple[int, int]]:
    if heavy.empty:
        return []
    marks = sound.sparkSession.createDataFrame(heavy[["mark", "rep"]].astype("int64"))
    n = sound.select("vec_id", F.xxhash64("space", "x").alias("mark")).join(F.broadcast(marks), "mark").groupBy("rep").agg(F.countDistinct("vec_id").alias("n"))
    return [(r["rep"], r["n"]) for r in n.collect()]


def _small(members: DataFrame, least: float) -> DataFrame:
    def settle(rows: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        ids, xs, weight, got = rows["vec"].to_numpy(), rows["x"].to_numpy(), rows["weight"].to_numpy(), []
        for a, b in groups:
            _, first = np.unique(ids[a:b], return_index=True)
            at = a + first
            if len(at) > 1 or weight[at[0]] >= 3:
                got += typical_of(ids[at], unit_rows(xs[at]), weight[at], least)
        return pd.DataFrame(got, columns=["vec_id", "typical_id"], dtype="int64")

    return by_group(members, "label", settle, "vec_id bigint, typical_id bigint")


def _compared(rows: DataFrame, least: float, block: int, sums: bool = False) -> DataFrame:
    """What the rows that ask find among all rows of their set, in pairs of blocks: (label, vec, weight, k1, k2) summed over
    their partners, themselves included, or with ``sums`` (label, vec, total) of all cosines at six places. Without ``sums``
    the rows that do not ask get the sums over their partners among those that do."""
    asked = rows.where("asks")
    n = rows.groupBy("label").agg(F.ceil(F.count("*") / block).alias("wide")).join(asked.groupBy("label").agg(F.ceil(F.count("*") / block).alias("deep")), "label")
    lot = lambda of, seed: F.pmod(F.xxhash64("vec", F.lit(seed)), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1))
    held = ["label", "vec", "weight", "k1", "k2", "x", "asks"]
    left = asked.join(F.broadcast(n), "label").select(*held, F.lit(True).alias("left"), lot("deep", 1).alias("i"), every("wide").alias("j"))
    right = rows.join(F.broadcast(n), "label").select(*held, F.lit(False).alias("left"), every("deep").alias("i"), lot("wide", 2).alias("j"))

    def work(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p[p["left"]], p[~p["left"]]
        u, v = unit_rows(a["x"]), unit_rows(b["x"])
        of_a, of_b = (q[["weight", "k1", "k2"]].to_numpy(dtype=np.float64) for q in (a, b))
        got_a, got_b = np.zeros((len(a), 3)), np.zeros((len(b), 3))
        for i in range(0, len(a) if len(b) else 0, 512):
            s = u[i : i + 512] @ v.T
            if sums:
                got_a[i : i + 512, 0] = np.round(s, 6) @ of_b[:, 0]
                continue
            near = (s >= least - 5e-7).astype(np.float64)
            got_a[i : i + 512] = near @ of_b
            got_b += near.T @ of_a[i : i + 512]
        quiet = ~b["asks"].to_numpy(dtype=bool) & (not sums)
        got = np.concatenate([got_a, got_b[quiet]])
        out = pd.DataFrame({"label": p["label"].iloc[0], "vec": np.concatenate([a["vec"], b["vec"][quiet]])})
        if sums:
            return out.assign(total=got[:, 0])
        return out.assign(weight=got[:, 0], k1=got[:, 1].astype(np.int64), k2=got[:, 2].astype(np.int64))

    names = ["total"] if sums else ["weight", "k1", "k2"]
    schema = "label bigint, vec bigint, " + ("total double" if sums else "weight double, k1 bigint, k2 bigint")
    return left.unionByName(right).groupBy("label", "i", "j").applyInPandas(work, schema).groupBy("label", "vec").agg(*(F.sum(c).alias(c) for c in names))


def _large(members: DataFrame, least: float, core: float, block: int) -> DataFrame:
    """Linked sets of more than BLOCK vectors, settled exactly. Vectors within half the angle of the mean are similar to each
    other without comparing them; the others are compared with the whole set. Vectors with the same partners (by weight and
    two sums of 30-bit keys) are similar to each other and go together: one of each kind is enough to find the cliques, and a
    set that is a clique as a whole has one kind. The typical member is the best of those whose mean cosine, which follows
    from the sum of all, lies within the rounding of the largest one."""
    key = lambda seed: F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 30))
    unit = members.dropDuplicates(["vec"]).withColumn("n", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)))
    unit = unit.select("label", "vec", "weight", "x", F.transform("x", lambda v: v.cast("double") / F.col("n")).alias("u"), key(3).alias("k1"), key(4).alias("k2"))

    def total(of: DataFrame) -> DataFrame:
        s = of.select("label", "weight", F.posexplode("u")).groupBy("label", "pos").agg(F.sum(F.col("col") * F.col("weight")).alias("s"))
        s = s.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("sum"))
        return s.join(of.groupBy("label").agg(F.sum("weight").alias("size")), "label")

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    marked = cut(unit.join(total(unit), "label").withColumn("asks", ~F.coalesce(dot("u", "sum") / F.sqrt(dot("sum", "sum")) >= core, F.lit(False))).drop("sum", "size"))
    seen = _compared(marked, least, block).select("label", "vec", F.struct("weight", "k1", "k2").alias("seen"))
    inner = marked.where("NOT asks").groupBy("label").agg(F.struct(*(F.sum(c).alias(c) for c in ("weight", "k1", "k2"))).alias("inner"))
    kind = [(F.coalesce(f"seen.{c}", F.lit(0)) + F.when(F.col("asks"), F.lit(0)).otherwise(F.col(f"inner.{c}"))).alias(f"n_{c}") for c in ("weight", "k1", "k2")]
    known = cut(marked.join(seen, ["label", "vec"], "left").join(inner, "label", "left").select("label", "vec", "weight", "x", "u", "k1", "k2", *kind))
    same = ["label", "n_weight", "n_k1", "n_k2"]
    kinds = cut(known.groupBy(*same).agg(F.min_by(F.struct("vec", "x"), "vec").alias("one"), F.sum("weight").alias("weight")))

    def peel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec")
        ids = p["vec"].to_numpy()
        got = _peeled(unit_rows(p["x"]), p["weight"].to_numpy(), least)
        return pd.DataFrame([(int(i), int(ids[g].min())) for g in got for i in ids[g]], columns=["one", "clique"], dtype="int64")

    cliques = kinds.select("label", "weight", "one.*").groupBy("label").applyInPandas(peel, "one bigint, clique bigint")
    named = known.join(kinds.select(*same, F.col("one.vec").alias("one")), same).join(cliques, "one").select(F.col("clique").alias("label"), "vec", "weight", "x", "u", "k1", "k2")
    named = cut(named)
    scored = named.join(total(named), "label").withColumn("mean", (dot("u", "sum") - 1) / (F.col("size") - 1)).drop("sum")
    top = scored.groupBy("label").agg(F.max("mean").alias("top"))
    close = cut(scored.join(top, "label").withColumn("asks", F.col("mean") >= F.col("top") - 2.1e-6).drop("u", "mean", "top"))
    exact = _compared(close, least, block, sums=True).join(close.select("label", "size").distinct(), "label")
    mean = F.round((F.col("total") - 1) / (F.col("size") - 1), 6)
    best = exact.groupBy("label").agg(F.min_by("vec", F.struct(-mean, F.col("vec"))).alias("typical_id"))
    return close.join(best, "label").select(F.col("vec").alias("vec_id"), "typical_id")


def cluster_sizes(vectors: DataFrame, spaces: DataFrame) -> DataFrame:
    """(space, typical_id, n_members) of every cluster."""
    found = cluster_members(vectors, spaces)
    named = vectors.select(F.col("vec_id").alias("typical_id"), "space").where("vec_id IS NOT NULL").dropDuplicates(["typical_id"])
    return found.groupBy("typical_id").agg(F.count("*").alias("n_members")).join(named, "typical_id").select("space", "typical_id", "n_members")

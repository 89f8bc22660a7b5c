"""Connected components in two ways: parent hooking with shortcutting, and hash-to-min.

Both take an edge table (``src``, ``dst``; extra columns are ignored) and return ``(id, group_id)`` with one row for each id
that stands in an edge to another id; ``group_id`` is the smallest id of its component. Null ends and loops link nothing,
repeated edges count once, an empty table gives an empty result. State is kept in tables, so no component is ever gathered
in one task; a vertex with very many neighbours is reduced by partial aggregation, and in joins with its own minimum it is taken
out of the shuffle (``spread_join``). The other joins read both sides from written tables, where the adaptive skew join applies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.session import cut


#: A key with at least HOT_ROWS rows and this share of all rows is hot; so there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 100_000, 2000


def hot_from(total: int | None) -> int:
    """From how many rows on a key is hot, of so many rows in all."""
    return max(HOT_ROWS, -(-(total or 0) // HOT_KEYS))


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], total: int | None, top: int | None) -> DataFrame:
    """``rows`` joined with ``lookup``, which has one row a key and ``n``, the key's rows (``total`` in all, ``top`` at most).

    Rows of hot keys stay where they are and get their row of ``lookup`` by broadcast (at most HOT_KEYS rows); all others are
    joined as usual. Without hot keys it is one join.
    """
    if (top or 0) < hot_from(total):
        return rows.join(lookup.drop("n"), keys)
    hot, rest = (lookup.where(c).drop("n") for c in (F.col("n") >= hot_from(total), F.col("n") < hot_from(total)))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def _edges(edges: DataFrame) -> DataFrame:
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(a, b).distinct()


def star(rows: DataFrame, key: str | list[str], member: str) -> DataFrame:
    """Edges that tie all members of a key to its smallest one: linear in the rows, where all pairs would be quadratic."""
    keys = [key] if isinstance(key, str) else key
    hubs = cut(rows.groupBy(*keys).agg(F.min(member).alias("dst"), F.count("*").alias("n")))
    total, top = hubs.agg(F.sum("n"), F.max("n")).first()
    return spread_join(rows, hubs, keys, total, top).select(F.col(member).alias("src"), "dst")


def hook_and_shortcut(edges: DataFrame) -> DataFrame:
    """Components by hooking roots to smaller neighbouring roots and shortcutting the parent table.

    Each round every root that has a smaller neighbour hooks to the smallest one, the parent table is shortcut until it is
    flat, and the edges are contracted to the roots that remain; at least half of a component's roots vanish a round.
    """
    live = cut(_edges(edges))
    labels = cut(live.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("group_id", F.col("id")))
    while not live.isEmpty():
        parents = cut(
            live.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("a").alias("p")), F.struct(F.col("b").alias("v"), F.col("a").alias("p")))).alias("e"))
            .select("e.*").groupBy("v").agg(F.min("p").alias("p"))
        )
        while True:
            up = parents.select(F.col("v").alias("p"), F.col("p").alias("g"))
            jumped = cut(parents.join(up, "p").select("v", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")))
            parents = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        labels = cut(labels.join(parents, F.col("group_id") == F.col("v"), "left").select("id", F.coalesce("p", "group_id").alias("group_id")))
        left, right = parents.select(F.col("v").alias("a"), F.col("p").alias("src")), parents.select(F.col("v").alias("b"), F.col("p").alias("dst"))
        live = cut(_edges(live.join(left, "a").join(right, "b")))
    return labels


def hash_to_min(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components by hash-to-min: each vertex sends its cluster to the cluster's smallest member and that member to all others.

    A cluster is a set of rows (v, u), not an array, so the largest component needs no single large row. A component is settled
    once each of its vertices holds the smallest one alone and the smallest one holds them all, which is seen from the table of
    minima; rounds end when all are. They grow with the logarithm of the longest path; more than ``max_rounds`` (paths of some
    2^60 vertices) raise an error rather than give a wrong result.
    """
    e = _edges(edges)
    pair = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    both = F.explode(F.array(pair("a", "b"), pair("b", "a"), pair("a", "a"), pair("b", "b")))
    clusters = cut(e.select(both.alias("e")).select("e.*").distinct())
    alone, own = F.count_if((F.col("v") != F.col("m")) & (F.col("n") == 1)), F.max(F.when(F.col("v") == F.col("m"), F.col("n")))
    for _ in range(max_rounds):
        least = cut(clusters.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")))
        state = least.groupBy("m").agg(F.sum("n").alias("rows"), F.max("n").alias("top"), F.coalesce(alone + 1 == own, F.lit(False)).alias("settled"))
        open_, rows, top = state.agg(F.count_if(~F.col("settled")), F.sum("rows"), F.max("top")).first()
        if not open_:
            return least.select(F.col("v").alias("id"), F.col("m").alias("group_id"))
        sent = spread_join(clusters, least, ["v"], rows, top)
        clusters = cut(sent.select(F.explode(F.array(pair("m", "u"), pair("u", "m"))).alias("e")).select("e.*").distinct())
    raise RuntimeError(f"hash-to-min did not settle in {max_rounds} rounds")


def ranked(rows: DataFrame, key: str, order: str, buckets: int = 256) -> DataFrame:
    """Adds ``rank`` (from 0) within key, by hash bucket and then order, without bringing a whole key into one task."""
    b = rows.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    counts = b.groupBy(key, "_b").count()
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(key, "_b").orderBy(order)
    return b.withColumn("_r", F.row_number().over(within) - 1).join(offsets, [key, "_b"]).withColumn("rank", F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def _fill(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take for a total as near to target as can be (the smaller total if two are as near).

    Subset sums as the bits of one integer; a size that occurs n times enters as 1, 2, 4 ... copies. ``first`` keeps for each
    sum the item that reached it first (from 1 on), which is enough to walk back: two bytes a sum while there are under 65,535
    items, so the driver needs about two bytes and a bit for each record of the target.
    """
    import numpy as np

    if target <= 0 or not sizes:
        return {}
    top = target + max(min(sizes), min(target, max(sizes)))
    mask, bits = (1 << (top + 1)) - 1, 1
    items: list[tuple[int, int]] = []
    first = np.zeros(top + 1, dtype=np.uint16 if sum(n.bit_length() for n in sizes.values()) < 65_535 else np.uint32)
    block = 1 << 20  # bytes of the bitset that are looked at together
    for size in sorted(sizes, reverse=True):
        n, step = sizes[size], 1
        while n > 0 and size <= top:
            take = min(step, n)
            n, step = n - take, step * 2
            if size * take > top:
                continue
            new = (bits << (size * take)) & mask & ~bits
            if new:
                items.append((size, take))
                raw = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), dtype=np.uint8)
                for i in range(0, len(raw), block):
                    part = np.unpackbits(raw[i : i + block], bitorder="little")[: top + 1 - 8 * i]
                    first[8 * i + np.nonzero(part)[0]] = len(items)
                bits |= new
    reached = np.concatenate([[0], np.nonzero(first)[0]])
    total = int(reached[np.argmin(np.abs(reached - target))])
    chosen: dict[int, int] = {}
    while total:
        size, take = items[int(first[total]) - 1]
        chosen[size] = chosen.get(size, 0) + take
        total -= size * take
    return chosen


def assign_splits(members: DataFrame, shares: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """(id, group_id) -> (id, group_id, split): no group is parted, and the totals come as near the shares as sizes allow.

    Only the multiplicities of the sizes come to the driver: n records have fewer than sqrt(2 n) + 1 different sizes; choosing
    among them takes about two bytes for each record of the smaller shares (``_fill``). Test is
    filled first, then val from what remains; train gets the rest, so a group too large for either share is train.
    Among groups of one size, the ranks by hash decide. An empty table gives an empty result.
    """
    groups = cut(members.groupBy("group_id").agg(F.count("*").alias("size")))
    sizes = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()}
    n = sum(s * k for s, k in sizes.items())
    test = _fill(sizes, round(n * shares[2]))
    val = _fill({s: left for s, k in sizes.items() if (left := k - test.get(s, 0))}, round(n * shares[1]))
    spark = members.sparkSession
    plan = spark.createDataFrame([(s, test.get(s, 0), test.get(s, 0) + val.get(s, 0)) for s in sizes], "size bigint, t bigint, v bigint")
    split = F.when(F.col("rank") < F.col("t"), "test").when(F.col("rank") < F.col("v"), "val").otherwise("train")
    named = ranked(groups, "size", "group_id").join(plan, "size").select("group_id", split.alias("split"))
    return members.join(named, "group_id").select("id", "group_id", "split")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

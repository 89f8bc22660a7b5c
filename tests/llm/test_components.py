"""Problems 2, 3 and 5, and the component operators under them."""

import random

import pytest

from lamella.llm import components as c
from lamella.llm import overlap, sites


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


CASES = {
    "empty": [],
    "loops and nulls": [("a", "a"), (None, "b"), ("c", None)],
    "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)],
    "shuffled chain": [(f"n{(i * 37) % 61:03d}", f"n{((i + 1) * 37) % 61:03d}") for i in range(60)],
    "star": [("hub", f"s{i}") for i in range(200)],
    "random": [(f"v{random.Random(i).randrange(90)}", f"v{random.Random(i + 999).randrange(90)}") for i in range(70)],
}


@pytest.mark.parametrize("find", [c.hook_and_shortcut, c.hash_to_min])
@pytest.mark.parametrize("case", CASES)
def test_components(spark, find, case):
    edges = CASES[case]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in edges + edges[:5]], "src string, dst string, id string, group_id int")
    assert {r["id"]: r["group_id"] for r in find(df).collect()} == brute(edges)


@pytest.mark.parametrize("find", [c.hook_and_shortcut, c.hash_to_min])
@pytest.mark.parametrize("case", ["star", "random"])
def test_components_with_hot_vertices(spark, find, case, monkeypatch):
    """Vertices of three rows and more count as hot, so that both ways of the joins are taken."""
    monkeypatch.setattr(c, "HOT_ROWS", 3)
    edges = CASES[case]
    rows = spark.createDataFrame([(b, a) for a, b in edges], "member string, k string")
    assert {r["id"]: r["group_id"] for r in find(spark.createDataFrame(edges, "src string, dst string")).collect()} == brute(edges)
    least = {k: min(b for a, b in edges if a == k) for k, _ in edges}
    assert {(r["src"], r["dst"]) for r in c.star(rows, "k", "member").collect()} == {(b, least[a]) for a, b in edges}


def test_splits_keep_groups_and_shares(spark):
    sizes = [40, 17, 9, 9, 5, 3, 3, 3, 2, 2] + [1] * 30
    rows = [(f"r{g}_{i}", f"g{g:02d}") for g, n in enumerate(sizes) for i in range(n)]
    got = c.assign_splits(spark.createDataFrame(rows, "id string, group_id string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values()) and len(got) == len(rows)
    n = {s: sum(r["split"] == s for r in got) for s in ("train", "val", "test")}
    assert n["test"] == round(len(rows) * 0.15) and n["val"] == round(len(rows) * 0.15)
    assert c.assign_splits(spark.createDataFrame([], "id string, group_id string")).count() == 0


def test_fill_is_exact():
    for seed in range(40):
        r = random.Random(seed)
        sizes = {r.randrange(1, 30): r.randrange(1, 5) for _ in range(4)}
        target = r.randrange(0, 60)
        sums = {0}
        for s, n in sizes.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        got = c._fill(sizes, target)
        assert all(got[s] <= sizes[s] for s in got)
        assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(x - target) for x in sums)


def test_hand_typed_sites(spark):
    strips = spark.createDataFrame([
        ("aaaaaaa1", None, "AAAAAAA2_ETD.TIF", "x"), ("aaaaaaa2", "site:aaaaaaa1", "none", "x"), ("aaaaaaa3", "", " aaaaaaa4\t", "x"), ("aaaaaaa4", "-", "unknown1 (same batch)", "x"), ("aaaaaaa5", "n/a", None, "x"), ("aaaaaaa5", None, "aaaaaaa5", "x")],
        "site string, left_neighbour string, right_neighbour string, other string")
    analysis = spark.createDataFrame([("aaaaaaa2", "img1", 4, None), ("aaaaaaa3", "img1", 5, None), ("aaaaaaa6", "img1", 7, "./crops/aaaaaaa7.png"), ("aaaaaaa7", None, None, None)], "site string, source_image string, chain_order int, right_neighbour string")
    got = {r["site"]: r["group_id"] for r in sites.strips_of_sites(strips, analysis).collect()}
    assert got == {f"aaaaaaa{i}": "aaaaaaa1" for i in (1, 2, 3, 4)} | {"aaaaaaa6": "aaaaaaa6", "aaaaaaa7": "aaaaaaa6"}


def test_tied_crops(spark):
    spots = spark.createDataFrame([("c1", "src/IMG_0012.tif", "s", 1500), ("c2", "n/a", "s", 1500), ("c3", None, None, 1500), ("c4", "img12", "t", 99999), ("c5", "", "t", 99999), ("c6", None, "", 1500)], "spot string, legacy_id string, scope string, session_px int")
    design = spark.createDataFrame([("c1", None), ("c3", "Img 000007"), ("c5", "img7"), ("c6", "unknown"), (None, "img7")], "crop string, groups string")
    got = {r["crop"]: r["group_id"] for r in sites.tied_crops(spots, design).collect()}
    assert got == {"c1": "c1", "c2": "c1", "c4": "c1", "c3": "c3", "c5": "c3"}


def test_overlaps(spark):
    wave = [int(100 + 50 * ((i * 7) % 13 - 6) / 6) for i in range(64)]
    other = [int(100 + 50 * ((i * 5) % 11 - 5) / 5) for i in range(64)]
    strips = spark.createDataFrame([
        ("aaaaaaa1", None, "aaaaaaa2", 0.9, wave), ("aaaaaaa2", None, None, 0.1, other), ("aaaaaaa3", "aaaaaaa1", None, 85.0, [v + 3 for v in wave]),
        ("aaaaaaa4", None, "aaaaaaa2", 0.5, [7] * 64), ("aaaaaaa5", None, "aaaaaaa1", float("nan"), wave[:41]), ("aaaaaaa6", None, None, None, None), ("aaaaaaa7", None, None, None, [2 * v for v in wave])],
        "site string, left_neighbour string, right_neighbour string, seam_corr_to_right double, profile array<smallint>")
    design = spark.createDataFrame([("aaaaaaa1", "TRAIN", "img1"), ("aaaaaaa2", "Validation", "img2"), ("aaaaaaa3", "held-out", None), ("aaaaaaa4", "val", "img2"), ("aaaaaaa5", "test", "x"), ("aaaaaaa6", " train ", "x"), ("aaaaaaa7", None, "x")], "crop string, split string, groups string")
    got = {(r["site_a"], r["site_b"]) for r in overlap.overlaps(strips, design).collect()}
    assert got == {("aaaaaaa1", "aaaaaaa2"), ("aaaaaaa1", "aaaaaaa3")}
    assert overlap.overlaps(strips.limit(0), design).count() == 0
    report = {(r["split"], r["image"]): r["n_pairs"] for r in overlap.overlaps_by_source(strips, design).collect()}
    assert report == {("val", 2): 1, ("test", -1): 1}


def test_same_records(spark):
    rows = spark.createDataFrame([(1, "train", "Hello,  World!", "s"), (2, "test", "hello world", "t"), (3, "val", "other", "t"), (4, "test", "...", "t"), (5, "train", "...", "s"), (6, "dev", None, "t")], "id int, split string, text string, source string")
    assert [tuple(r) for r in overlap.same_records(rows, "id", "split", "text", "source").collect()] == [("test", "t", 1)]


def test_pairs_at_the_least_correlation_share_a_hash():
    """Planes and tables as for 500, a hundred thousand and ten million training profiles."""
    import numpy as np

    r = np.random.default_rng(1)
    for n in (500, 100_000, 10_000_000):
        bits = overlap.bits_for(n)
        tables = overlap.tables_for(bits, 0.95)
        a, o = r.standard_normal((2, 600, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        o -= (o * a).sum(axis=1, keepdims=True) * a
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
        planes = r.standard_normal((64, tables * bits))
        p, q = (x.reshape(600, tables, bits) for x in (a @ planes, b @ planes))
        turned = (p > 0) != (q > 0)
        rank = np.argsort(np.argsort(np.abs(q), axis=2), axis=2)
        met = ((turned.sum(axis=2) == 0) | (turned.sum(axis=2) == 1) & (turned & (rank < overlap.FLIPS)).any(axis=2)).any(axis=1)
        assert met.mean() >= 0.99

"""Problems 1 and 4 against brute force, with copies, odd rows, ties, empty tables and clashing columns."""

import numpy as np
import pandas as pd
import pytest

from lamella.llm import clusters, neighbours, vectors

SPACES = "space string, n_dims int, vec_id string"
VECTORS = "vec_id bigint, space string, x array<float>, rep int, mark string, n_dims string"


def table(spark, rows):
    return spark.createDataFrame([(i, s, None if x is None else [None if v is None else float(v) for v in x], 0, "m", "d") for i, s, x in rows], VECTORS)


def spaces(spark, *of):
    return spark.createDataFrame([(s, d, "x") for s, d in of], SPACES)


def made(seed=0, n=120, d=12, groups=8, size=5):
    r = np.random.default_rng(seed)
    rows = [r.standard_normal(d) for _ in range(n)]
    for _ in range(groups):
        c = r.standard_normal(d)
        rows += [(c + 0.05 * r.standard_normal(d)) * r.choice([1, 100, 1e-3]) for _ in range(size)]
    return [(i + 1, "a" if i % 5 else "b", x.astype(np.float32)) for i, x in enumerate(rows)]


def brute(rows, least=0.85, k=5):
    out, top = set(), {}
    sims = {}
    for i, s, x in rows:
        u = np.asarray(x, float) / np.linalg.norm(np.asarray(x, float))
        sims[i] = (s, u)
    for i, (s, u) in sims.items():
        c = sorted((-round(float(u @ v), 6), j) for j, (t, v) in sims.items() if t == s and j != i)
        top[i] = c[:k]
    for i, c in top.items():
        out |= {(min(i, j), max(i, j)) for m, j in c if -m >= least}
    return out


def pairs(df):
    got = [(r["vec_a"], r["vec_b"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_pairs_match_brute_force(spark):
    rows = made()
    odd = [(900, "a", None), (901, "a", [1.0]), (902, "a", [float("nan")] + [1.0] * 11), (903, "a", [0.0] * 12), (904, "a", [None] + [1.0] * 11), (905, "zz", [1.0] * 12), (None, "a", [1.0] * 12), (906, None, [1.0] * 12)]
    df = table(spark, rows + odd + rows[:10])
    assert pairs(neighbours.similar_pairs(df, spaces(spark, ("a", 12), ("b", 12)))) == brute(rows)


def test_forest_recall(spark):
    rows = made(3, 600, 24, 60, 6)
    found = pairs(neighbours.similar_pairs(table(spark, rows), spaces(spark, ("a", 24), ("b", 24)), leaf_rows=100))
    assert len(found & brute(rows)) >= 0.9 * len(brute(rows))


@pytest.mark.parametrize("depth", [4, 8, 10])
def test_recall_of_deep_trees(depth):
    """The share of pairs at a cosine of 0.86 that meet in a leaf, among vectors without structure, which are the hardest."""
    r = np.random.default_rng(depth)
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = norm(r.standard_normal((1500, 64)))
    o = r.standard_normal(a.shape)
    b = 0.86 * a + np.sqrt(1 - 0.86**2) * norm(o - (o * a).sum(axis=1, keepdims=True) * a)
    f = vectors.Forest.fit(norm(r.standard_normal((64 << depth, 64))), depth, neighbours.TREES, 1)
    (s, p), (t, q) = (f.leaves(x, neighbours.visits_of(depth)) for x in (a, b))
    met = ((p[:, :, None] == q[:, None, :]) & (s[:, :, None] == t[:, None, :])).any(axis=(1, 2)).mean()
    assert met >= 0.95


def test_order_next_to_a_tie_is_settled_in_double(spark):
    """Cosines that differ by less than packing shows, in lists of more than five and at the threshold."""
    u, rows = np.eye(9), [(1, "a", np.eye(9)[0].astype(np.float32))]
    for i in range(8):
        c = 0.9 + i * 1.1e-6
        rows.append((10 - i, "a", (c * u[0] + np.sqrt(1 - c * c) * u[1 + i]).astype(np.float32)))
    for i, c in enumerate((0.8499993, 0.8499999, 0.8500006)):
        rows.append((20 + i, "b", np.array([1.0, 0, 0] + [0] * 6, dtype=np.float32) if i == 0 else (c * u[0] + np.sqrt(1 - c * c) * u[i]).astype(np.float32)))
    got = pairs(neighbours.similar_pairs(table(spark, rows), spaces(spark, ("a", 9), ("b", 9))))
    assert got == brute(rows)


def test_many_copies_in_a_leaf(spark):
    """Copies under the bound for large classes: lists go by id, and only a few of them are compared."""
    rows = [(i, "a", x) for i, _, x in made(6)]
    rows += [(500 + i, "a", rows[-1][2]) for i in range(40)] + [(700 + i, "a", rows[3][2]) for i in range(7)]
    assert pairs(neighbours.similar_pairs(table(spark, rows), spaces(spark, ("a", 12)))) == brute(rows)


def test_hot_copies_of_one_vector(spark, monkeypatch):
    """A third of all rows are exact copies; lists go by id, and nothing is quadratic in the copies."""
    monkeypatch.setattr(vectors, "COPY_ROWS", 20)
    rows = made(5)
    hot = rows[-1][2]
    rows += [(1000 + i, "a", hot) for i in range(80)]
    rows = [(i, "a", x) for i, _, x in rows]
    df = table(spark, rows)
    assert pairs(neighbours.similar_pairs(df, spaces(spark, ("a", 12)))) == brute(rows)
    got = {r["vec_id"]: r["typical_id"] for r in clusters.cluster_members(df, spaces(spark, ("a", 12))).collect()}
    assert {1000 + i for i in range(80)} <= set(got) and len({got[1000 + i] for i in range(80)}) == 1


def test_empty_tables(spark):
    df, sp = table(spark, []), spaces(spark)
    assert neighbours.similar_pairs(df, sp).count() == 0 and clusters.cluster_members(df, sp).count() == 0
    assert neighbours.similar_pairs(df, spaces(spark, ("a", 3))).count() == 0


def brute_clusters(rows, least=0.9):
    ids = [i for i, _, _ in rows]
    u = np.stack([np.asarray(x, float) / np.linalg.norm(np.asarray(x, float)) for _, _, x in rows])
    same = np.array([[a == b for _, a, _ in rows] for _, b, _ in rows])
    s = np.round(u @ u.T, 6)
    near = (s >= least) & same
    out = {}
    for n in range(len(ids)):
        m = np.nonzero(near[n])[0]
        if len(m) >= 3 and near[np.ix_(m, m)].all():
            mean = np.round([(s[i, m].sum() - s[i, i]) / (len(m) - 1) for i in m], 6)
            out[ids[n]] = ids[m[np.lexsort((np.array(ids)[m], -mean))[0]]]
    return out


@pytest.mark.parametrize("block", [8192, 6])
def test_clusters_match_brute_force(spark, block):
    rows = made(7, 60, 16, 10, 9)
    df = table(spark, rows + rows[:7] + [(900, "a", None), (901, "b", [0.0] * 16)])
    got = clusters.cluster_members(df, spaces(spark, ("a", 16), ("b", 16)), cell_rows=20, block=block).collect()
    assert len(got) == len({r["vec_id"] for r in got})
    want = brute_clusters(rows)
    found = {r["vec_id"]: r["typical_id"] for r in got}
    assert found == want


def test_packing_keeps_cosines():
    for d in (1, 2, 7, 80, 97):
        u = np.random.default_rng(d).standard_normal((40, d))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v = vectors.unpacked(pd.Series(vectors.packed(u)))
        assert np.abs(u @ u.T - v @ v.T).max() < 3e-6


def spread_cluster(r, n, d, cosine):
    """n vectors whose cosines to each other lie close to ``cosine``."""
    c = r.standard_normal(d)
    c /= np.linalg.norm(c)
    noise = r.standard_normal((n, d)) / np.sqrt(d)
    noise -= np.outer(noise @ c, c)
    return c + noise * np.sqrt(1 / cosine - 1)


def test_large_sets_keep_members_far_from_the_mean(spark):
    """Cosines of 0.90 to 0.95 throughout: about sqrt(0.93) = 0.964 to the mean, outside half the angle."""
    r = np.random.default_rng(2)
    xs = [*spread_cluster(r, 40, 320, 0.93), *spread_cluster(r, 30, 320, 0.99), *r.standard_normal((20, 320))]
    rows = [(i + 1, "a", x.astype(np.float32)) for i, x in enumerate(xs)]
    want = brute_clusters(rows)
    assert len(want) == 70
    found = {x["vec_id"]: x["typical_id"] for x in clusters.cluster_members(table(spark, rows), spaces(spark, ("a", 320)), block=8).collect()}
    assert found == want


def test_large_set_of_several_cliques(spark):
    """Two cliques of 20 joined by one row in between that is similar to some of either."""
    at = np.zeros((41, 4))
    for i in range(20):
        at[i, :2] = np.cos(0.001 * i), np.sin(0.001 * i)
        at[20 + i, :2] = np.cos(0.8 + 0.001 * i), np.sin(0.8 + 0.001 * i)
    at[40, :2] = np.cos(0.41), np.sin(0.41)  # within 0.451 of all of both
    rows = [(i + 1, "a", x.astype(np.float32)) for i, x in enumerate(at)]
    got = clusters.cluster_members(table(spark, rows), spaces(spark, ("a", 4)), block=8).collect()
    found = {x["vec_id"]: x["typical_id"] for x in got}
    assert len(got) == len(found) == 41
    assert len({found[i] for i in range(1, 21)}) == 1 and len({found[i] for i in range(21, 41)}) == 1 and found[1] != found[21]


def test_copies_survive_a_neighbour_just_out_of_reach(spark, monkeypatch):
    """A cosine of 0.8995 is a link of the half-precision pass but not a similarity; the copies are a cluster all the same."""
    monkeypatch.setattr(vectors, "COPY_ROWS", 20)
    hot, near = np.zeros(8), np.zeros(8)
    hot[0], near[:2] = 1, (0.8995, np.sqrt(1 - 0.8995**2))
    rows = [(i + 1, "a", hot) for i in range(30)] + [(40, "a", near)]
    rows = [(i, s, x.astype(np.float32)) for i, s, x in rows]
    found = {x["vec_id"]: x["typical_id"] for x in clusters.cluster_members(table(spark, rows), spaces(spark, ("a", 8))).collect()}
    assert found == brute_clusters(rows) == {i: 1 for i in range(1, 31)}


def test_cliques_go_on_after_a_start_that_yields_none():
    """A hub with four partners that are not similar to each other has no clique of three; the triangle beside it has."""
    hub = np.zeros((8, 8))
    hub[0, 0] = 1
    for i in range(4):
        hub[1 + i, [0, 1 + i]] = 0.91, np.sqrt(1 - 0.91**2)
    hub[5:, 7] = 1
    got = clusters.typical_of(np.arange(1, 9), hub, np.ones(8), 0.9)
    assert got == [(6, 6), (7, 6), (8, 6)]


def test_partners_that_share_only_their_third_cell(spark, monkeypatch):
    """The nearest two cells of the first two rows are 0 and 1, of the third 4 and 3; all three have cell 2 as third."""
    monkeypatch.setattr(clusters, "seed_centroids", lambda sample, cells: {})
    monkeypatch.setattr(clusters, "move_centroids", lambda sample, centers: ({"a": np.eye(5, dtype=np.float32)}, {"a": np.ones(5)}))
    x = np.array([0.5, 0.45, 0.4, 0.35, 0.3])
    rows = [(1, "a", x.astype(np.float32)), (2, "a", (x + [0.01, 0, 0, 0, 0]).astype(np.float32)), (3, "a", x[::-1].astype(np.float32))]
    found = {r["vec_id"]: r["typical_id"] for r in clusters.cluster_members(table(spark, rows), spaces(spark, ("a", 5))).collect()}
    assert found == brute_clusters(rows) and len(found) == 3


@pytest.mark.parametrize("block", [4, 30, 10_000])
def test_a_wide_cluster_in_one_cell_of_many_lots(spark, block):
    """All rows in one cell; the cluster's rows lie outside half the angle, so they are weak and meet in pairs of lots."""
    r = np.random.default_rng(9)
    xs = [*spread_cluster(r, 24, 300, 0.92), *spread_cluster(r, 12, 300, 0.995), *r.standard_normal((60, 300))]
    rows = [(i + 1, "a", x.astype(np.float32)) for i, x in enumerate(xs)]
    found = {x["vec_id"]: x["typical_id"] for x in clusters.cluster_members(table(spark, rows), spaces(spark, ("a", 300)), cell_rows=1000, block=block).collect()}
    assert found == brute_clusters(rows) and len(found) == 36


def test_coded_cosines_stay_within_what_they_may_be_off():
    for d in (2, 16, 96, 700):
        u = np.random.default_rng(d).standard_normal((200, d))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v, off = clusters.decoded(pd.Series(clusters.coded(u)))
        assert (np.abs(u @ u.T - v @ v.T) <= np.hypot(off[:, None], off[None, :])).all()

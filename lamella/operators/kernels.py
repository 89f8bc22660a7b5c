"""Image kernels in NumPy, one image a group: labelling, distance, shapes, hulls, spectra, blur, orientation.

An image is the unit of work, and images have a bounded size; larger fields are cut into tiles first (``raster.tiled``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(rows: pd.DataFrame, value: str, fill: float = 0.0) -> np.ndarray:
    """The pixels of one image as an array; missing places get ``fill``."""
    out = np.full((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), fill, dtype=np.float64)
    out[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows[value].to_numpy(dtype=np.float64)
    return out


def label_array(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """0 outside, else 1 + the smallest flat index of the component: the minimum spreads along runs until nothing changes."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    while True:
        before = label.copy()
        for dy, dx in steps:
            a = label[: h - dy, max(0, -dx) : w - max(0, dx)]
            b = label[dy:, max(0, dx) : w - max(0, -dx)]
            both = (a < h * w) & (b < h * w)
            low = np.minimum(a, b)
            a[both] = low[both]
            b[both] = np.minimum(b[both], low[both])  # the two views overlap
        flat = label.ravel()
        inside = flat < h * w
        flat[inside] = flat[flat[inside]]
        if (label == before).all():
            return np.where(mask, label + 1, 0)


def label_components(mask: DataFrame, width: int, eight: bool = False) -> DataFrame:
    """(img, y, x, label): label is y * width + x of the component's first pixel."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(rows["y"].max()) + 1, width), dtype=bool)
        m[rows["y"], rows["x"]] = True
        lab = label_array(m, eight)
        return rows[["img", "y", "x"]].assign(label=lab[rows["y"], rows["x"]] - 1)

    return mask.select("img", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")).groupBy("img").applyInPandas(run, "img bigint, y bigint, x bigint, label bigint")


def distance_array(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance to the nearest True: columns first, then the lower envelope along rows by direct minimum."""
    h, w = mask.shape
    far = float(h + w + 1) ** 2
    col = np.full((h, w), np.inf)
    last = np.full(w, -np.inf)
    for y in range(h):
        last = np.where(mask[y], y, last)
        col[y] = y - last
    last = np.full(w, np.inf)
    for y in range(h - 1, -1, -1):
        last = np.where(mask[y], y, last)
        col[y] = np.minimum(col[y], last - y)
    sq = np.where(np.isfinite(col), col**2, far)
    dx = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    return np.sqrt(np.stack([(sq[y][None, :] + dx).min(axis=1) for y in range(h)]))


def distance_to(px: DataFrame, mask: str) -> DataFrame:
    """(img, y, x, dist) for images that have a set pixel."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = grid(rows, mask).astype(bool)
        out = rows[["img", "y", "x"]].assign(dist=distance_array(m)[rows["y"], rows["x"]] if m.any() else np.nan)
        return out[out["dist"].notna()]

    return px.select("img", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), mask).groupBy("img").applyInPandas(run, "img bigint, y bigint, x bigint, dist double")


def object_shapes(labelled: DataFrame) -> DataFrame:
    """Area, mean value, axes of the ellipse of equal second moments, aspect and angle, all as aggregates (OBJ-4 to OBJ-6)."""
    g = labelled.groupBy("img", "label").agg(F.count("*").alias("area"), F.avg("v").alias("mean"), (F.var_pop("y") + 1 / 12).alias("vy"), (F.var_pop("x") + 1 / 12).alias("vx"), F.covar_pop("y", "x").alias("c"))
    half, root = (F.col("vy") + F.col("vx")) / 2, F.sqrt(F.pow((F.col("vy") - F.col("vx")) / 2, 2) + F.pow("c", 2))
    return g.select("img", "label", "area", "mean", (4 * F.sqrt(half + root)).alias("major"), (4 * F.sqrt(F.greatest(half - root, F.lit(0.0)))).alias("minor"), (0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy"))).alias("angle")).withColumn("aspect", F.when(F.col("minor") > 0, F.col("major") / F.col("minor")))


def hull_area(y: np.ndarray, x: np.ndarray) -> float:
    """Area of the convex hull of the pixels' corners (monotone chain)."""
    p = sorted({(int(b + i), int(a + j)) for a, b in zip(y, x) for i in (0, 1) for j in (0, 1)})

    def chain(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    hull = chain(p) + chain(p[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2


def solidity(labelled: DataFrame) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(rows["img"].iloc[0], l, len(g), len(g) / hull_area(g["y"].to_numpy(), g["x"].to_numpy())) for l, g in rows.groupby("label")]
        return pd.DataFrame(out, columns=["img", "label", "area", "solidity"])

    return labelled.groupBy("img").applyInPandas(run, "img bigint, label bigint, area bigint, solidity double")


def periodogram(px: DataFrame, rings: int = 8) -> DataFrame:
    """Mean log power by ring of spatial frequency under a Hann window, and the slope of log power on log frequency."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = grid(rows, "v")
        v = (v - v.mean()) * np.hanning(v.shape[0])[:, None] * np.hanning(v.shape[1])[None, :]
        power = np.abs(np.fft.fft2(v)) ** 2 / v.size
        f = np.hypot(np.fft.fftfreq(v.shape[0])[:, None], np.fft.fftfreq(v.shape[1])[None, :])
        ok = f > 0
        lf, lp = np.log(f[ok]), np.log(power[ok] + 1e-30)
        ring = np.minimum((f[ok] / 0.7072 * rings).astype(int), rings - 1)
        slope = np.polyfit(lf, lp, 1)[0]
        n = np.bincount(ring, minlength=rings)
        m = np.bincount(ring, lp, rings) / np.maximum(n, 1)
        return pd.DataFrame({"img": rows["img"].iloc[0], "ring": np.arange(rings), "log_power": m, "slope": slope})[n > 0]

    return px.groupBy("img").applyInPandas(run, "img bigint, ring int, log_power double, slope double")


def gaussian_array(v: np.ndarray, sigma: float) -> np.ndarray:
    n = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (n, n)
        p = np.pad(v, pad, mode="symmetric")
        v = sum(w[i] * np.take(p, np.arange(i, i + v.shape[axis]), axis=axis) for i in range(2 * n + 1))
    return v


def gaussian(px: DataFrame, sigma: float) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["img", "y", "x"]].assign(v=gaussian_array(grid(rows, "v"), sigma)[rows["y"], rows["x"]])

    return px.select("img", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "v").groupBy("img").applyInPandas(run, "img bigint, y bigint, x bigint, v double")


def orientation(px: DataFrame, sigma: float) -> DataFrame:
    """Mean direction (0 to pi), nematic order and mean coherence of the structure tensor of each image."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        gy, gx = np.gradient(gaussian_array(grid(rows, "v"), sigma))
        xx, yy, xy = (gaussian_array(g, 2 * sigma) for g in (gx * gx, gy * gy, gx * gy))
        strength = xx + yy
        coherence = np.hypot(xx - yy, 2 * xy) / np.maximum(strength, 1e-30)
        c, s = ((xx - yy)).sum() / strength.sum(), (2 * xy).sum() / strength.sum()
        return pd.DataFrame({"img": [rows["img"].iloc[0]], "angle": [0.5 * np.arctan2(s, c) % np.pi], "order": [np.hypot(c, s)], "coherence": [coherence.mean()]})

    return px.groupBy("img").applyInPandas(run, "img bigint, angle double, `order` double, coherence double")

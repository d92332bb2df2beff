"""Pose alignment by projective point-to-plane ICP: association and sums in Spark, a 6x6 solve on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.sensors import Pinhole, norm, pixel, transform

#: Results of associating a pixel.
OK, NO_NORMAL, NO_PROJECTION, NO_REFERENCE, TOO_FAR, TOO_STEEP = 1, -1, -2, -3, -4, -5
#: The colour that shows each result.
COLOURS = {OK: (128, 128, 128), NO_NORMAL: (0, 0, 0), NO_PROJECTION: (255, 0, 0), NO_REFERENCE: (0, 255, 0), TOO_FAR: (0, 0, 255), TOO_STEEP: (255, 255, 0)}
P, N = ("px", "py", "pz"), ("nx", "ny", "nz")


def track(points: DataFrame, reference: DataFrame, pose: np.ndarray, camera: Pinhole, distance: float = 0.1, cosine: float = 0.8) -> DataFrame:
    """(frame, x, y, result, error, j0..j5) of every pixel.

    points and reference: (frame, x, y, p, n) of the images of a frame and of what is to be
    met; pose moves points into the reference's camera. error is along the reference normal.
    """
    moved = transform(pose, tuple(F.col(c) for c in P))
    turned = pose.copy()
    turned[:3, 3] = 0
    normal = transform(turned, tuple(F.col(c) for c in N))
    u, v, ok = camera.project(tuple(F.col(f"m{c}") for c in "xyz"))
    known = F.col("nx").isNotNull() & (F.col("pz") > 0)
    rows = points.withColumns({**{f"m{c}": x for c, x in zip("xyz", moved, strict=True)}, **{f"q{c}": x for c, x in zip("xyz", normal, strict=True)}})
    seen = F.coalesce(known & (F.col("mz") > 0), F.lit(False))
    ok = F.when(seen, ok).otherwise(F.lit(False))
    rows = rows.withColumns({"known": known, "seen": ok, "rx": F.when(ok, pixel(u)), "ry": F.when(ok, pixel(v))})
    ref = reference.select("frame", F.col("x").alias("rx"), F.col("y").alias("ry"), *[F.col(c).alias(f"r{c}") for c in (*P, *N)])
    rows = rows.join(ref, ["frame", "rx", "ry"], "left")
    diff = [F.col(f"r{p}") - F.col(f"m{c}") for p, c in zip(P, "xyz", strict=True)]
    along = F.col("qx") * F.col("rnx") + F.col("qy") * F.col("rny") + F.col("qz") * F.col("rnz")
    result = (
        F.when(~F.col("known"), NO_NORMAL)
        .when(~F.col("seen"), NO_PROJECTION)
        .when(F.col("rnx").isNull(), NO_REFERENCE)
        .when(norm(tuple(diff)) > distance, TOO_FAR)
        .when(along < cosine, TOO_STEEP)
        .otherwise(OK)
    )
    n = [F.col(f"r{c}") for c in N]
    m = [F.col(f"m{c}") for c in "xyz"]
    jac = [*n, m[1] * n[2] - m[2] * n[1], m[2] * n[0] - m[0] * n[2], m[0] * n[1] - m[1] * n[0]]
    error = diff[0] * n[0] + diff[1] * n[1] + diff[2] * n[2]
    rows = rows.withColumn("result", result)
    good = F.col("result") == OK
    return rows.select("frame", "x", "y", "result", F.when(good, error).alias("error"), *[F.when(good, j).alias(f"j{k}") for k, j in enumerate(jac)])


def reduce(tracked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of error squared, J^T e, the upper half of J^T J, and counts of results, in one aggregate."""
    products = [(f"e{k}", F.col(f"j{k}") * F.col("error")) for k in range(6)]
    products += [(f"a{i}{j}", F.col(f"j{i}") * F.col(f"j{j}")) for i in range(6) for j in range(i, 6)]
    count = lambda name, *codes: F.count_if(F.col("result").isin(*codes)).alias(name)
    return tracked.groupBy(*(by or [])).agg(
        F.sum(F.col("error") * F.col("error")).alias("error2"),
        *[F.sum(v).alias(n) for n, v in products],
        count("tracked", OK),
        count("too_far", TOO_FAR),
        count("too_steep", TOO_STEEP),
        count("other", NO_NORMAL, NO_PROJECTION, NO_REFERENCE),
    )


def solve(sums: Row) -> np.ndarray:
    """The twist (translation, rotation) that reduces the error most; zero without enough points."""
    a = np.zeros((6, 6))
    for i in range(6):
        for j in range(i, 6):
            a[i, j] = a[j, i] = sums[f"a{i}{j}"] or 0.0
    b = np.array([sums[f"e{k}"] or 0.0 for k in range(6)])
    try:
        np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return np.zeros(6)
    return np.linalg.solve(a, b)


def hat(w: np.ndarray) -> np.ndarray:
    return np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])


def exp(twist: np.ndarray) -> np.ndarray:
    """The rigid motion of a twist."""
    t, w = twist[:3], twist[3:]
    angle = float(np.linalg.norm(w))
    k = hat(w)
    if angle < 1e-9:
        r, v = np.eye(3) + k, np.eye(3) + k / 2
    else:
        s, c = np.sin(angle) / angle, (1 - np.cos(angle)) / angle**2
        r = np.eye(3) + s * k + c * k @ k
        v = np.eye(3) + c * k + (1 - s) / angle**2 * k @ k
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, v @ t
    return out


def good_pose(sums: Row, pixels: int, threshold: float = 0.15, rms: float = 2e-2) -> bool:
    """Whether enough pixels were met closely enough for the pose to stand."""
    n = sums["tracked"]
    return bool(n) and (sums["error2"] / n) ** 0.5 <= rms and n / pixels >= threshold


def align(levels: list[tuple[DataFrame, DataFrame, Pinhole, int]], pose: np.ndarray, threshold: float = 0.15, step: float = 1e-5, **how) -> tuple[np.ndarray, bool]:
    """The pose after ICP from the coarsest of levels (points, reference, camera, iterations) to the finest.

    Each iteration is one job that returns one row. The first pose comes back if the last
    one isn't good.
    """
    now, sums, camera = pose, None, None
    for points, reference, camera, iterations in levels:
        for _ in range(iterations):
            sums = reduce(track(points, reference, now, camera, **how)).first()
            twist = solve(sums)
            now = exp(twist) @ now
            if np.linalg.norm(twist) < step:
                break
    good = sums is not None and good_pose(sums, camera.width * camera.height, threshold)
    return (now if good else pose), good


def result_colour(result: Column) -> tuple[Column, Column, Column]:
    def channel(k: int) -> Column:
        out = F.lit(0)
        for code, rgb in COLOURS.items():
            out = F.when(result == code, rgb[k]).otherwise(out)
        return out

    return channel(0), channel(1), channel(2)

"""Depth images in long form: pixels(frame, x, y, depth in metres; 0 for none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sensors import Pinhole, norm

VALID = 1e-5


def _offsets(low: int, high: int) -> Column:
    """array<struct<dx, dy>> of a square window."""
    spots = [F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for j in range(low, high + 1) for i in range(low, high + 1)]
    return F.array(*spots)


def downsample(pixels: DataFrame, width: int, ratio: int) -> DataFrame:
    """(frame, x, y, depth, idx): the upper median of each tile's valid depths and where it is.

    Of equal depths the first place counts; a tile without depth has 0 and its first place.
    """
    tile = [F.floor(F.col(c) / ratio).cast("int").alias(f"t{c}") for c in "xy"]
    rows = pixels.select("frame", *tile, "depth", (F.col("x") + F.col("y") * width).cast("int").alias("idx"))
    good = F.collect_list(F.when(F.col("depth") >= VALID, F.struct("depth", "idx")))
    rows = rows.groupBy("frame", "tx", "ty").agg(F.sort_array(good).alias("s"), F.min("idx").alias("first"))
    median = F.get("s", F.floor(F.size("s") / 2).cast("int"))
    return rows.select("frame", F.col("tx").alias("x"), F.col("ty").alias("y"), F.coalesce(median["depth"], F.lit(0.0)).alias("depth"), F.coalesce(median["idx"], "first").alias("idx"))


def remap(image: DataFrame, places: DataFrame) -> DataFrame:
    """places (frame, x, y, idx) with the value of image (frame, idx, value) at idx."""
    return places.join(image, ["frame", "idx"]).select("frame", "x", "y", "value")


def half_sample(pixels: DataFrame, width: int, height: int, reach: float, radius: int = 1) -> DataFrame:
    """Half-size images: means of the window's depths within reach of its top-left pixel, clamped at borders."""
    heads = pixels.filter((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).withColumn("o", F.explode(_offsets(1 - radius, radius)))
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c) + F.col(f"o.d{c}"), F.lit(n - 1)))
    heads = heads.select("frame", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("depth").alias("head"), clamp("x", width).alias("x"), clamp("y", height).alias("y"))
    rows = heads.join(pixels, ["frame", "x", "y"]).filter(F.abs(F.col("depth") - F.col("head")) < reach)
    return rows.groupBy("frame", F.floor(F.col("hx") / 2).cast("int").alias("x"), F.floor(F.col("hy") / 2).cast("int").alias("y")).agg(F.avg("depth").alias("depth"))


def point_cloud(pixels: DataFrame, camera: Pinhole) -> DataFrame:
    """pixels with the point (px, py, pz) they measure in the camera's frame, all zero without depth."""
    ray = camera.ray(F.col("x"), F.col("y"))
    return pixels.withColumns({f"p{c}": F.when(F.col("depth") > 0, F.col("depth") * r).otherwise(0.0) for c, r in zip("xyz", ray, strict=True)})


def cloud_to_depth(points: DataFrame, shift: tuple[float, float, float]) -> DataFrame:
    """(frame, x, y, depth): z of the points moved into another camera by a translation."""
    return points.select("frame", "x", "y", (F.col("pz") + F.lit(float(shift[2]))).alias("depth"))


def normals(points: DataFrame, flip: bool = False) -> DataFrame:
    """(frame, x, y, nx, ny, nz): unit normals from differences of neighbours, clamped at borders.

    Null where the point or a neighbour has no depth. flip: images whose y axis points up.
    """
    p = F.struct("px", "py", "pz")
    across, down = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    near = {"l": F.lag(p).over(across), "r": F.lead(p).over(across), "u": F.lag(p).over(down), "d": F.lead(p).over(down)}
    rows = points.withColumns({k: F.coalesce(v, p) for k, v in near.items()})
    if flip:
        rows = rows.withColumns({"u": F.col("d"), "d": F.col("u")})
    diff = lambda a, b: [F.col(f"{a}.p{c}") - F.col(f"{b}.p{c}") for c in "xyz"]
    a, b = diff("r", "l"), diff("d", "u")
    cross = (b[1] * a[2] - b[2] * a[1], b[2] * a[0] - b[0] * a[2], b[0] * a[1] - b[1] * a[0])
    rows = rows.withColumns({f"c{c}": v for c, v in zip("xyz", cross, strict=True)})
    n = norm((F.col("cx"), F.col("cy"), F.col("cz")))
    good = (F.least("pz", "l.pz", "r.pz", "u.pz", "d.pz") > 0) & (n > 0)
    return rows.select("frame", "x", "y", *[F.when(good, F.col(f"c{c}") / n).alias(f"n{c}") for c in "xyz"])


def depth_sigma(depth: Column, factor: float, low: float, high: float, quadratic: bool = False) -> Column:
    """The uncertainty of a depth: proportional to it or its square, clamped; 0 for no depth or NaN."""
    sigma = F.lit(float(factor)) * (depth * depth if quadratic else depth)
    return F.when((depth <= 0) | F.isnan(depth) | depth.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(float(low)), F.least(sigma, F.lit(float(high)))))


def pool(pixels: DataFrame, width: int, height: int, radius: int) -> DataFrame:
    """(frame, x, y, low, high, known, crossing) over the square of this radius around each pixel.

    low and high are of the known depths; known counts them; crossing: the square leaves the image.
    """
    rows = pixels.select("frame", F.col("x").alias("qx"), F.col("y").alias("qy"), "depth", F.explode(_offsets(-radius, radius)).alias("o"))
    rows = rows.select("frame", (F.col("qx") + F.col("o.dx")).alias("x"), (F.col("qy") + F.col("o.dy")).alias("y"), "depth")
    rows = rows.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    good = F.when(F.col("depth") >= VALID, F.col("depth"))
    out = rows.groupBy("frame", "x", "y").agg(F.min(good).alias("low"), F.max(good).alias("high"), F.count(good).cast("int").alias("known"))
    inside = F.col("x").between(radius, width - 1 - radius) & F.col("y").between(radius, height - 1 - radius)
    return out.withColumn("crossing", ~inside)


def pool_boxes(boxes: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(id, low, high, known, unknown, crossing): depths in each box (id, frame, x0, y0, x1, y1), ends included.

    Boxes are cut to the image; one outside it has no pixels and is crossing.
    """
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") < width) & (F.col("y1") < height)
    rows = boxes.withColumn("crossing", ~inside)
    for c, n in (("x", width), ("y", height)):
        low, high = F.greatest(F.col(f"{c}0"), F.lit(0)), F.least(F.col(f"{c}1"), F.lit(n - 1))
        rows = rows.withColumn(c, F.explode_outer(F.when(low <= high, F.sequence(low, high))))
    rows = rows.join(pixels, ["frame", "x", "y"], "left")
    good = F.when(F.col("depth") >= VALID, F.col("depth"))
    return rows.groupBy("id", "crossing").agg(F.min(good).alias("low"), F.max(good).alias("high"), F.count(good).cast("int").alias("known"), (F.count("depth") - F.count(good)).cast("int").alias("unknown"))


def pool_arrays(rows: DataFrame, where: Column, width: int, height: int) -> DataFrame:
    """rows (depth: an image as an array by rows; x0, y0, x1, y1) with low, high, unknown (whether there is any) and crossing of each box, as pool_boxes() has them.

    Looked up in the image beside the box. low and high are null where no depth is known, and where where is false.
    """
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") < width) & (F.col("y1") < height)
    cut = {f"{c}{k}": F.greatest(F.col(f"{c}{k}"), F.lit(0)) if k == 0 else F.least(F.col(f"{c}{k}"), F.lit(n - 1)) for c, n in (("x", width), ("y", height)) for k in (0, 1)}
    rows = rows.withColumn("crossing", ~inside).withColumns(cut)
    some = where & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    line = lambda y: F.slice("depth", y * width + F.col("x0") + 1, F.col("x1") - F.col("x0") + 1)
    rows = rows.withColumn("pooled", F.when(some, F.flatten(F.transform(F.sequence("y0", "y1"), line))))
    good = F.filter("pooled", lambda d: d >= VALID)
    unknown = F.coalesce(F.exists("pooled", lambda d: d < VALID), F.lit(False))
    return rows.withColumns({"low": F.array_min(good), "high": F.array_max(good), "unknown": unknown}).drop("pooled")


def ray_to_z(depth: Column, camera: Pinhole, x: Column, y: Column) -> Column:
    """z of a measurement along the ray."""
    a, b, _ = camera.ray(x, y)
    return depth / F.sqrt(F.lit(1.0) + a * a + b * b)


def destagger(scan: DataFrame, width: int, stagger: tuple[int, ...]) -> DataFrame:
    """(scan, x, y, value) of column-major LiDAR scans (scan, idx, value) whose rows are shifted by stagger."""
    rows = len(stagger)
    y = (F.col("idx") % rows).cast("int")
    x = F.floor(F.col("idx") / rows).cast("int")
    shift = F.element_at(F.array(*[F.lit(s) for s in stagger]), y + 1)
    return scan.select("scan", ((x + shift) % width).cast("int").alias("x"), y.alias("y"), "value")


def to_millimetres(depth: Column) -> Column:
    """Depth as whole millimetres, as images store it."""
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.round(depth * 1000))).cast("int")

"""Readers of image lists, poses, LiDAR streams, raw and depth-image files as DataFrames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings

PIXELS = "path string, frame int, x int, y int, depth double, r int, g int, b int"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without comments and blanks, carriage returns cut off; line is the place in its file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return rows.filter((F.trim("text") != "") & ~F.startswith(F.ltrim("text"), F.lit("#")))


def _all_or_none(rows: DataFrame, good: Column) -> DataFrame:
    """All rows if every one is good, else none."""
    bad = rows.filter(~F.coalesce(good, F.lit(False))).limit(1).select(F.lit(1).alias("bad"))
    return rows.join(bad, F.lit(True), "left_anti")


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts, file) of a list of times and file names; one bad line makes the list empty."""
    rows = _lines(spark, path).withColumn("c", strings.split(F.col("text"), " ", skip_empty=True))
    rows = _all_or_none(rows, (F.size("c") == 2) & strings.is_float(F.get("c", F.lit(0)), non_negative=True))
    return rows.select(F.col("line").alias("id"), F.get("c", F.lit(0)).cast("double").alias("ts"), F.get("c", F.lit(1)).alias("file"))


def pose_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts, tx, ty, tz, qx, qy, qz, qw) of lines of eight numbers; one bad line makes the list empty."""
    rows = _lines(spark, path).withColumn("c", strings.split(F.col("text"), " ", skip_empty=True))
    rows = _all_or_none(rows, (F.size("c") == 8) & F.forall("c", lambda x: strings.is_float(x)))
    names = ["ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    return rows.select(F.col("line").alias("id"), *[F.get("c", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)])


def image_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts, file) of a comma-separated list with a commented header."""
    rows = _lines(spark, path).withColumn("c", F.split("text", ","))
    return rows.filter(F.size("c") == 2).select(F.col("line").alias("id"), F.trim(F.get("c", F.lit(0))).cast("double").alias("ts"), F.trim(F.get("c", F.lit(1))).alias("file"))


def camera_poses(spark: SparkSession, path: str) -> DataFrame:
    """(id, tx, ty, tz, qw, qx, qy, qz) of camera lines of 15 columns, turned by half about x; other lines are skipped."""
    rows = _lines(spark, path).withColumn("c", strings.split(F.col("text"), " ", skip_empty=True)).filter(F.size("c") == 15)
    at = lambda k: F.get("c", F.lit(k)).cast("double")
    w, x, y, z = at(6), at(7), at(8), at(9)
    # The product of the quaternion with (0, 1, 0, 0).
    return rows.select(F.col("line").alias("id"), at(10).alias("tx"), at(11).alias("ty"), at(12).alias("tz"), (-x).alias("qw"), w.alias("qx"), z.alias("qy"), (-y).alias("qz"))


def association(spark: SparkSession, path: str) -> DataFrame:
    """(id, tx..tz, qx..qw, status): the last seven columns of each line are a pose.

    skip: a number isn't finite or the quaternion isn't of unit length; error: fewer columns.
    """
    by = "," if path.endswith(".csv") else " "
    rows = _lines(spark, path).withColumn("c", strings.split(F.col("text"), by, skip_empty=True))
    names = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    at = {n: F.when(F.size("c") >= 7, F.try_element_at("c", F.lit(k - 7))).try_cast("double").alias(n) for k, n in enumerate(names)}
    rows = rows.select(F.col("line").alias("id"), F.size("c").alias("n"), *at.values())
    return rows.select("id", *names, pose_status(F.col("n"), [F.col(n) for n in names]).alias("status"))


def pose_status(columns: Column, pose: list[Column]) -> Column:
    """ok, skip or error of a line with so many columns and these last seven numbers."""
    finite = F.lit(True)
    for c in pose:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    q = pose[3:]
    unit = F.abs(F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]) - 1) <= 1e-3
    return F.when(columns < 7, "error").when(F.coalesce(finite & unit, F.lit(False)), "ok").otherwise("skip")


def lidar_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts, x, y, z, intensity) of a LiDAR stream, ts in nanoseconds."""
    return spark.read.csv(path, header=True, schema="ts long, x double, y double, z double, intensity int").select(F.monotonically_increasing_id().alias("id"), "*")


def trajectory_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts, x, y, z, qw, qx, qy, qz) of a trajectory, ts in nanoseconds."""
    return spark.read.csv(path, header=True, schema="id long, ts long, x double, y double, z double, qw double, qx double, qy double, qz double")


def after_first_pose(rays: DataFrame, poses: DataFrame) -> DataFrame:
    """Rays from the first pose on."""
    first = poses.agg(F.min("ts").alias("first"))
    return rays.join(F.broadcast(first), F.col("ts") >= F.col("first")).drop("first")  # one row


def _binary(spark: SparkSession, path: str, glob: str | None, parse: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = files.option("pathGlobFilter", glob) if glob else files
    out_schema = spark.createDataFrame([], schema).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for columns in parse(name, content):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.load(path).select("path", "content").mapInArrow(read, schema)


def raw_frames(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth (metres) and colour images of a raw file: sizes, millimetres, sizes, RGB, again and again."""
    w, h = struct.unpack_from("<II", content)
    size = 16 + w * h * 5
    for k in range(len(content) // size):
        at = k * size + 8
        depth = np.frombuffer(content, "<u2", w * h, at).reshape(h, w) / 1000.0
        yield depth, np.frombuffer(content, np.uint8, 3 * w * h, at + 2 * w * h + 8).reshape(h, w, 3)


def raw(spark: SparkSession, path: str) -> DataFrame:
    """PIXELS of raw files; a frame cut off by the end is none."""

    def parse(name: str, content: bytes) -> Iterator[tuple]:
        if len(content) < 8:
            return
        for frame, (depth, rgb) in enumerate(raw_frames(content)):
            h, w = depth.shape
            y, x = np.divmod(np.arange(h * w), w)
            yield [name] * (h * w), np.full(h * w, frame), x, y, depth.ravel(), *(rgb[..., k].ravel() for k in range(3))

    return _binary(spark, path, None, parse, PIXELS)


def decode_png(content: bytes) -> np.ndarray:
    """A grey or RGB image of 8 or 16 bits without interlacing."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at + 8 <= len(content):
        n, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += n + 12
    w, h, bits, colour, _, _, interlaced = head
    if colour not in (0, 2) or bits not in (8, 16) or interlaced:
        raise ValueError("only grey or RGB images of 8 or 16 bits")
    step = (3 if colour == 2 else 1) * bits // 8
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    for y in range(h):
        kind, line, up = rows[y, 0], rows[y, 1:].astype(np.int32), out[y - 1].astype(np.int32) if y else np.zeros(w * step, np.int32)
        if kind in (0, 2):
            out[y] = (line + (up if kind == 2 else 0)) & 255
            continue
        for i in range(w * step):
            a = int(out[y, i - step]) if i >= step else 0
            b, c = int(up[i]), int(up[i - step]) if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, i] = (int(line[i]) + {1: a, 3: (a + b) // 2, 4: near}[int(kind)]) & 255
    image = out.reshape(h, w, -1)
    if bits == 16:
        image = image[..., ::2].astype(np.uint16) * 256 + image[..., 1::2]
    return image[..., 0] if image.shape[-1] == 1 else image


def encode_png(image: np.ndarray) -> bytes:
    """A grey image of 16 bits."""
    h, w = image.shape
    rows = np.zeros((h, 1 + 2 * w), np.uint8)
    rows[:, 1::2], rows[:, 2::2] = image >> 8, image & 255
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_pgm(content: bytes) -> np.ndarray:
    """An ASCII PGM image of up to 16 bits."""
    words = [w for line in content.decode().splitlines() for w in line.split("#")[0].split()]
    if words[:1] != ["P2"] or not 0 < int(words[3]) <= 65535:
        raise ValueError("not an ASCII PGM file of 16 bits at most")
    w, h = int(words[1]), int(words[2])
    return np.array(words[4 : 4 + w * h], dtype=np.uint16).reshape(h, w)


def depth_images(spark: SparkSession, path: str, inverse_scale: float = 1 / 5000, glob: str = "*.{png,pgm}") -> DataFrame:
    """PIXELS of 16-bit PNG and PGM files; frame is 0 and colours are null."""

    def parse(name: str, content: bytes) -> Iterator[tuple]:
        image = decode_pgm(content) if name.endswith(".pgm") else decode_png(content)
        h, w = image.shape
        y, x = np.divmod(np.arange(h * w), w)
        none = [None] * (h * w)
        yield [name] * (h * w), np.zeros(h * w), x, y, image.ravel() * inverse_scale, none, none, none

    return _binary(spark, path, glob, parse, PIXELS)


SCAN_FILE = "cloud_[0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9]_[0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9].pcd"


def scans(spark: SparkSession, path: str, rows: int = 64, stagger: tuple[int, ...] = (0, 6, 12, 18)) -> DataFrame:
    """(path, x, y, range) of point-cloud files of column-major scans, rows shifted back into an image."""

    def parse(name: str, content: bytes) -> Iterator[tuple]:
        head, _, body = content.partition(b"DATA ")
        kind, _, body = body.partition(b"\n")
        if kind.strip() == b"ascii":
            points = np.array([line.split()[:3] for line in body.decode().splitlines() if line.strip()], dtype=float)
        else:
            fields = dict(line.split(maxsplit=1) for line in head.decode().splitlines() if " " in line and not line.startswith("#"))
            step = sum(int(s) * int(c) for s, c in zip(fields["SIZE"].split(), fields["COUNT"].split(), strict=True))
            points = np.frombuffer(body[: len(body) // step * step], np.uint8).reshape(-1, step)[:, :12].copy().view("<f4").astype(float)
        n = len(points) // rows * rows
        x, y = np.divmod(np.arange(n), rows)
        x = (x + np.resize(stagger, rows)[y]) % max(n // rows, 1)
        yield [name] * n, x, y, np.linalg.norm(points[:n], axis=1)

    return _binary(spark, path, SCAN_FILE, parse, "path string, x int, y int, range double")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "raw": raw,
    "tum": image_list,
    "interiornet": image_csv,
    "newercollege": scans,
    "leica": lidar_csv,
}


def create(kind: str, spark: SparkSession, path: str) -> DataFrame:
    """A reader by name, in any case."""
    if kind.lower() not in READERS:
        raise ValueError(f"unknown reader {kind!r}; there are {', '.join(READERS)}")
    return READERS[kind.lower()](spark, path)


def pose_of(poses: DataFrame, frame: int) -> DataFrame:
    """The pose of one frame."""
    return poses.filter(F.col("id") == frame)

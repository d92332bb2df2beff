"""Queries over list and pose files, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from .registry import query, table


def folder(spark: SparkSession, name: str = "map") -> str:
    """A new folder in spark.checkpoint.dir (in one of its own where that is unset)."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints/voxelspark'}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str, line: str) -> str:
    """A folder of text files with one line an event."""
    path = folder(spark, "lines")
    table(spark, sf_dir, "events").select(F.expr(line)).write.text(path)
    return path


def _event(columns: str) -> str:
    return f"SELECT {columns} FROM events"


@query(_event("event_id + 0.5::DOUBLE AS ts, 'depth/' || user_id || '.png' AS file"))
def r03_image_list(spark, sf_dir) -> DataFrame:
    path = _written(spark, sf_dir, "concat('# times and files\\r\\n\\n  ', event_id, '.5  depth/', user_id, '.png\\r')")
    return readers.create("TUM", spark, path).select("ts", "file")


_NUMBERS = {"ts": "event_id + 0.25", "tx": "user_id % 9 - 4.5", "ty": "event_id % 13 * 0.125", "tz": "event_id % 3 - 1.0", "qx": "0.0", "qy": "0.5", "qz": "event_id % 2 * 0.25", "qw": "-0.75"}


@query(_event(", ".join(f"({v})::DOUBLE AS {k}" for k, v in _NUMBERS.items())))
def r04_ground_truth(spark, sf_dir) -> DataFrame:
    path = _written(spark, sf_dir, f"concat_ws(' ', {', '.join(f'({v})' for v in _NUMBERS.values())})")
    return readers.pose_list(spark, path).select(*_NUMBERS)


@query(_event("event_id::DOUBLE AS ts, 'cam0/' || event_id || '.png' AS file"))
def r08_image_csv(spark, sf_dir) -> DataFrame:
    path = _written(spark, sf_dir, "concat('#timestamp,file\\n', event_id, ',cam0/', event_id, '.png\\r')")
    return readers.create("InteriorNet", spark, path).select("ts", "file")


#: A turn by half about x after the quaternion (w, x, y, z) is (-x, w, z, -y).
@query(_event("(user_id % 9)::DOUBLE AS tx, 2.5::DOUBLE AS ty, (event_id % 7)::DOUBLE AS tz, -0.25::DOUBLE AS qw, (event_id % 5)::DOUBLE AS qx, 0.75::DOUBLE AS qy, -0.5::DOUBLE AS qz") + " WHERE event_id % 10 <> 3")
def r08_camera_poses(spark, sf_dir) -> DataFrame:
    line = "concat_ws(' ', 1, 2, 3, 4, 5, 6, event_id % 5, 0.25, 0.5, 0.75, user_id % 9, 2.5, event_id % 7, 8, if(event_id % 10 = 3, null, 9))"
    return readers.camera_poses(spark, _written(spark, sf_dir, line)).select("tx", "ty", "tz", "qw", "qx", "qy", "qz")


@query(_event("CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'skip' ELSE 'ok' END AS status, count(*) AS lines") + " GROUP BY 1")
def r17_pose_lines(spark, sf_dir) -> DataFrame:
    """The last seven columns: too few are an error; no finite number or no unit quaternion skips the line."""
    line = "if(event_id % 11 = 0, '1 2 3', concat_ws(' ', event_id, 'a.png', if(event_id % 3 = 0, 'nan', '1.5'), 2, 3, 0, 0, 0.6, if(event_id % 5 = 0, 0.9, 0.8)))"
    return readers.association(spark, _written(spark, sf_dir, line)).groupBy("status").agg(F.count("*").alias("lines"))

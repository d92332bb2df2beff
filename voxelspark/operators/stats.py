"""Performance samples (iter, key, type, value, ts, event_id): aggregates, merges and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units and the order of types in a report.
UNITS = {"COUNT": "#", "CURRENT": "A", "DISTANCE": "m", "DURATION": "s", "ENERGY": "J", "FREQUENCY": "Hz", "MEMORY": "MB", "ORIENTATION": "-", "POSITION": "m", "POWER": "W", "VOLTAGE": "V", "VOLUME": "m^3", "UNDEFINED": "-"}
#: How samples of one iteration merge, by type; others keep the last.
SUMMED, AVERAGED, HIGHEST = ("COUNT", "DURATION"), ("FREQUENCY",), ("CURRENT", "ENERGY", "MEMORY", "POWER", "VOLTAGE", "VOLUME")


def per_iteration(samples: DataFrame) -> DataFrame:
    """mean, last, min, max and sum of each key's samples in each iteration."""
    last = F.max_by("value", F.struct("ts", "event_id"))
    return samples.groupBy("key", "iter").agg(F.avg("value").alias("mean"), last.alias("last"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"))


def overall(samples: DataFrame) -> DataFrame:
    """The same over all iterations; mean is that of the iterations' means."""
    rows = per_iteration(samples)
    return rows.groupBy("key").agg(F.avg("mean").alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))


def merged(samples: DataFrame) -> DataFrame:
    """(iter, key, value): one value for each iteration and key, merged as its type says."""
    last = F.max_by("value", F.struct("ts", "event_id")).cast("double")
    t = F.first("type")
    value = F.when(t.isin(*SUMMED), F.sum("value").cast("double")).when(t.isin(*AVERAGED), F.avg("value")).when(t.isin(*HIGHEST), F.max("value").cast("double")).otherwise(last)
    return samples.groupBy("iter", "key").agg(value.alias("value"))


def unit(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, u in UNITS.items():
        out = F.when(kind == k, F.lit(u)).otherwise(out)
    return out


def header(samples: DataFrame) -> DataFrame:
    """(place, key, type, unit): columns of a report by type, then first appearance."""
    order = F.array_position(F.array(*[F.lit(k) for k in UNITS]), F.col("type"))
    keys = samples.groupBy("key", "type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    place = F.row_number().over(Window.orderBy(order, "first"))  # a handful of keys
    return keys.select(place.alias("place"), "key", "type", unit(F.col("type")).alias("unit"))


def table(samples: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each iteration, a column of six decimals for each key, * for none."""
    rows = merged(samples).groupBy("iter").pivot("key", keys).agg(F.first("value"))
    return rows.select("iter", *[F.coalesce(F.format_string("%.6f", F.col(f"`{k}`")), F.lit("*")).alias(k) for k in keys])


def column_means(report: DataFrame, keys: list[str]) -> DataFrame:
    """(key, mean): means of a report's numeric cells, * for a column without any."""
    cells = report.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.try_to_number(F.col(f"`{k}`"), F.lit("S999999999999.999999")).cast("double").alias("v")) for k in keys])))
    mean = F.coalesce(F.format_string("%.4f", F.avg("v")), F.lit("*"))
    return cells.groupBy("key").agg(F.when(F.count("v") > 0, mean).otherwise("*").alias("mean"))


def summary_lines(samples: DataFrame) -> DataFrame:
    """(key, line): overall statistics as JSON."""
    rows = overall(samples)
    return rows.select("key", F.to_json(F.struct("mean", "min", "max", "sum")).alias("line"))


def pose_samples(poses: DataFrame) -> DataFrame:
    """(iter, key, value): the seven numbers of each pose (iter, tx..tz, qx..qw) as samples."""
    names = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    return poses.select("iter", F.inline(F.array(*[F.struct(F.lit(f"pose_{n}").alias("key"), F.col(n).alias("value")) for n in names])))

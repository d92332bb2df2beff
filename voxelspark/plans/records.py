"""Queries over reading, association, statistics and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import association, stats
from ..sources import readers
from . import fixtures as fx
from .fusion import micro
from .registry import query, table

_M = "CAST(floor({} * 1000000 + 0.37::DOUBLE) AS BIGINT)"
SECOND = 1_000_000
TOLERANCE = 300 * SECOND


@query(f"""WITH a AS {fx.stream_sql('click')}, b AS {fx.stream_sql('view')},
r AS (SELECT a.id, b.id AS match, abs(a.ts - b.ts) AS delta, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.ts - b.ts), b.ts, b.id) AS n FROM a JOIN b ON b.ts BETWEEN a.ts - {TOLERANCE} AND a.ts + {TOLERANCE})
SELECT id, match, delta FROM r WHERE n = 1""")
def r05_nearest_association(spark, sf_dir):
    return association.nearest(fx.stream(spark, sf_dir, "click"), fx.stream(spark, sf_dir, "view"), TOLERANCE)


_POSES = f"p AS {fx.stream_sql('signup')}, iv AS (SELECT ts AS t0, lead(ts) OVER w AS t1, px AS x0, lead(px) OVER w AS x1, py AS y0, lead(py) OVER w AS y1 FROM p WINDOW w AS (ORDER BY ts, id))"
GAP = 7200 * SECOND


@query(f"""WITH a AS {fx.stream_sql('click')}, {_POSES} SELECT a.id, {_M.format("(x0 + (x1 - x0) * ((a.ts - t0)::DOUBLE / (t1 - t0)::DOUBLE))")} AS px_1e6, {_M.format("(y0 + (y1 - y0) * ((a.ts - t0)::DOUBLE / (t1 - t0)::DOUBLE))")} AS py_1e6
FROM a JOIN iv ON t0 <= a.ts AND a.ts < t1 AND t1 - t0 <= {GAP} AND t1 > t0""")
def r06_pose_interpolation(spark, sf_dir):
    rows = association.at_times(fx.stream(spark, sf_dir, "click"), fx.stream(spark, sf_dir, "signup"), ["px", "py"], GAP)
    return rows.select("id", micro(F.col("px")).alias("px_1e6"), micro(F.col("py")).alias("py_1e6"))


@query(f"""WITH a AS {fx.stream_sql('view')}, {_POSES} SELECT a.id, {_M.format("(x0 + (x1 - x0) * ((a.ts - t0)::DOUBLE / (t1 - t0)::DOUBLE))")} AS px_1e6
FROM a JOIN iv ON t0 <= a.ts AND a.ts < t1 AND t1 - t0 <= {12 * GAP} AND t1 > t0""")
def r13_ray_poses(spark, sf_dir):
    rows = association.at_times(fx.stream(spark, sf_dir, "view"), fx.stream(spark, sf_dir, "signup"), ["px"], 12 * GAP)
    return rows.select("id", micro(F.col("px")).alias("px_1e6"))


_SLERP = "e AS (SELECT event_id, (event_id % 50) / 50.0::DOUBLE AS t, cos((event_id % 7) / 5.0::DOUBLE) AS aw, sin((event_id % 7) / 5.0::DOUBLE) AS ax, cos((event_id % 11) / 4.0::DOUBLE) AS bw, sin((event_id % 11) / 4.0::DOUBLE) AS bx FROM events), d AS (SELECT *, aw * bw + ax * bx AS dot FROM e), g AS (SELECT *, acos(least(abs(dot), 1.0)) AS angle, CASE WHEN dot < 0 THEN -1.0 ELSE 1.0 END AS s, abs(dot) > 1 - 1e-12 AS near FROM d)"


@query(f"WITH {_SLERP} SELECT event_id, {_M.format('(CASE WHEN near THEN 1 - t ELSE sin((1.0 - t) * angle) / sin(angle) END * aw + CASE WHEN near THEN t ELSE sin(t * angle) / sin(angle) END * s * bw)')} AS w_1e6 FROM g")
def r06_slerp(spark, sf_dir):
    e = F.col("event_id")
    a, b, zero = (e % 7) / F.lit(5.0), (e % 11) / F.lit(4.0), F.lit(0.0)
    w = association.slerp([F.cos(a), F.sin(a), zero, zero], [F.cos(b), F.sin(b), zero, zero], (e % 50) / F.lit(50.0))[0]
    return table(spark, sf_dir, "events").select("event_id", micro(w).alias("w_1e6"))


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS n FROM {fx.stream_sql('purchase')}), b AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS n FROM {fx.stream_sql('error')}) SELECT CAST(a.n AS INTEGER) AS position, a.id AS id_0, b.id AS id_1 FROM a JOIN b ON a.n = b.n""")
def r09_by_position(spark, sf_dir):
    rows = association.by_position(fx.stream(spark, sf_dir, "purchase").select("id", "ts"), fx.stream(spark, sf_dir, "error").select("id", "ts"))
    return rows.select("position", "id_0", "id_1")


@query(f"WITH r AS {fx.stream_sql('view')}, p AS {fx.stream_sql('signup')} SELECT id, ts FROM r WHERE ts >= (SELECT min(ts) + {GAP} FROM p)")
def r12_rays_after_first_pose(spark, sf_dir):
    poses = fx.stream(spark, sf_dir, "signup").select((F.col("ts") + GAP).alias("ts"))
    return readers.after_first_pose(fx.stream(spark, sf_dir, "view").select("id", "ts"), poses)


@query("""WITH e AS (SELECT event_id, CAST(event_id % 9 AS INTEGER) AS n, (event_id % 13) / 10.0::DOUBLE AS tx, CASE WHEN event_id % 4 = 0 THEN 1.0::DOUBLE ELSE (event_id % 4) / 4.0::DOUBLE END AS qw FROM events)
SELECT event_id, CASE WHEN n < 7 THEN 'error' WHEN abs(sqrt(qw * qw) - 1) <= 1e-3 THEN 'ok' ELSE 'skip' END AS status FROM e""")
def r17_pose_status(spark, sf_dir):
    e = F.col("event_id")
    zero = F.lit(0.0)
    qw = F.when(e % 4 == 0, F.lit(1.0)).otherwise((e % 4) / F.lit(4.0))
    status = readers.pose_status((e % 9).cast("int"), [(e % 13) / F.lit(10.0), zero, zero, zero, zero, zero, qw])
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("SELECT user_id, ['ok', 'skip', 'eof', 'error'][max(event_id % 7 % 4) + 1] AS status, max(event_id % 7 % 4) <= 1 AS good FROM events GROUP BY user_id")
def r18_status_merge(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in association.STATUS])
    rows = table(spark, sf_dir, "events").select("user_id", F.element_at(names, (F.col("event_id") % 7 % 4 + 1).cast("int")).alias("status"))
    return association.merge_status(rows, ["user_id"])


@query(f"SELECT * FROM {fx.stream_sql('signup')} p WHERE id = (SELECT min(event_id) FROM events WHERE event_type = 'signup')")
def r19_pose_of_frame(spark, sf_dir):
    poses = fx.stream(spark, sf_dir, "signup")
    first = poses.agg(F.min("id")).first()[0]
    return readers.pose_of(poses, first)


@query("SELECT event_id AS frame, event_id % 3 = 0 AS keep FROM events")
def r16_paced_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"))
    return association.paced(frames, 30.0, F.lit(0.09))


_S = f"WITH {fx.SAMPLES}"
_ITER = "it AS (SELECT key, iter, avg(value) AS mean, max_by(value, (ts, event_id)) AS last, min(value) AS min, max(value) AS max, CAST(sum(value) AS BIGINT) AS sum FROM sm GROUP BY key, iter)"


@query(f"{_S}, {_ITER} SELECT key, iter, {_M.format('mean')} AS mean_1e6, last, min, max, sum FROM it")
def x01_iteration_stats(spark, sf_dir):
    rows = stats.per_iteration(fx.samples(spark, sf_dir))
    return rows.select("key", "iter", micro(F.col("mean")).alias("mean_1e6"), "last", "min", "max", "sum")


@query(f"{_S}, {_ITER} SELECT key, CAST(floor(avg(mean) * 100 + 0.37::DOUBLE) AS BIGINT) AS mean_1e2, min(min) AS min, max(max) AS max, CAST(sum(sum) AS BIGINT) AS sum FROM it GROUP BY key")
def x02_overall_stats(spark, sf_dir):
    rows = stats.overall(fx.samples(spark, sf_dir))
    return rows.select("key", F.floor(F.col("mean") * 100 + F.lit(0.37)).cast("long").alias("mean_1e2"), "min", "max", "sum")


_MERGED = "mg AS (SELECT iter, key, CASE any_value(type) WHEN 'COUNT' THEN sum(value)::DOUBLE WHEN 'DURATION' THEN sum(value)::DOUBLE WHEN 'FREQUENCY' THEN avg(value) WHEN 'MEMORY' THEN max(value)::DOUBLE ELSE max_by(value, (ts, event_id))::DOUBLE END AS value FROM sm GROUP BY iter, key)"


@query(f"{_S}, {_MERGED} SELECT iter, key, {_M.format('value')} AS value_1e6 FROM mg")
def x03_typed_merge(spark, sf_dir):
    return stats.merged(fx.samples(spark, sf_dir)).select("iter", "key", micro(F.col("value")).alias("value_1e6"))


@query("SELECT event_id AS iter, 'pose_' || n AS key, v AS value FROM (SELECT event_id, unnest(['tx', 'ty', 'tz', 'qx', 'qy', 'qz', 'qw']) AS n, unnest([(event_id % 5)::DOUBLE, (event_id % 7)::DOUBLE, (event_id % 3)::DOUBLE, 0, 0, 0, 1]) AS v FROM events)")
def x04_pose_samples(spark, sf_dir):
    e = F.col("event_id")
    values = {"tx": (e % 5).cast("double"), "ty": (e % 7).cast("double"), "tz": (e % 3).cast("double"), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0), "qw": F.lit(1.0)}
    return stats.pose_samples(table(spark, sf_dir, "events").select(e.alias("iter"), *[v.alias(k) for k, v in values.items()]))


_UNITS = " ".join(f"WHEN '{k}' THEN '{u}'" for k, u in stats.UNITS.items())
_ORDER = "[" + ", ".join(f"'{k}'" for k in stats.UNITS) + "]"


@query(f"{_S}, f AS (SELECT key, type, min((ts, event_id)) AS first FROM sm GROUP BY ALL) SELECT CAST(row_number() OVER (ORDER BY list_position({_ORDER}, type), first) AS INTEGER) AS place, key, type, CASE type {_UNITS} END AS unit FROM f")
def x05_header(spark, sf_dir):
    return stats.header(fx.samples(spark, sf_dir))


#: Strings whose reading as numbers is tested.
NUMBERS = ("42", "-2", "12.42", ".1", "-3.7", "-0.5f", "0-1", "1.3.", "0xD8", "7A", "abc.", "")
_VALUES = ", ".join(f"('{s}')" for s in NUMBERS)


@query(f"""SELECT s, regexp_matches(s, '{strings.INT}') AS is_int, regexp_matches(s, '{strings.FLOAT}') AS is_float, regexp_matches(s, '{strings.INT}') AND s NOT LIKE '-%' AS is_count, regexp_matches(s, '{strings.FLOAT}') AND s NOT LIKE '-%' AS is_size FROM (VALUES {_VALUES}) v(s)""")
def x06_numeric_strings(spark, sf_dir):
    s = F.col("s")
    return spark.createDataFrame([(x,) for x in NUMBERS], "s string").select(s, strings.is_int(s).alias("is_int"), strings.is_float(s).alias("is_float"), strings.is_int(s, non_negative=True).alias("is_count"), strings.is_float(s, non_negative=True).alias("is_size"))


@query("SELECT page_id, starts_with(url, 'https://') AS secure, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS bare, CASE WHEN ends_with(url, '.html') THEN substr(url, 1, length(url) - 5) ELSE url END AS stem FROM pages")
def x07_affixes(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.startswith(url, F.lit("https://")).alias("secure"), strings.remove_prefix(url, "https://").alias("bare"), strings.remove_suffix(url, ".html").alias("stem"))


@query("""WITH p AS (SELECT page_id, url, string_split(url, '/') AS a FROM pages) SELECT page_id, CAST(len(CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END) AS INTEGER) AS parts, regexp_replace(trim(url, '/'), '/+', '|', 'g') AS filled FROM p""")
def x08_split(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.size(strings.split(url, "/")).alias("parts"), F.array_join(strings.split(url, "/", skip_empty=True), "|").alias("filled"))


@query("SELECT page_id, lower(url) AS low, upper(url) AS high FROM pages")
def x09_case(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("low"), F.upper("url").alias("high"))


@query("SELECT page_id, rpad('page:', 33, ' ') || page_id AS line FROM pages")
def x10_labelled(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strings.labelled("page", F.col("page_id")).alias("line"))


_KEYS = sorted(fx.TYPES)


@query(f"{_S}, {_MERGED} SELECT iter, {', '.join(f'''coalesce(printf('%.6f', max(CASE WHEN key = '{k}' THEN value END)), '*') AS {k}''' for k in _KEYS)} FROM mg GROUP BY iter")
def w08_stats_table(spark, sf_dir):
    return stats.table(fx.samples(spark, sf_dir), _KEYS)


@query(f"{_S}, {_MERGED} SELECT key, count(*) > 0 AS known, CAST(floor(avg(round(value, 6)) + 0.37::DOUBLE) AS BIGINT) AS mean FROM mg GROUP BY key")
def w10_column_means(spark, sf_dir):
    rows = stats.column_means(stats.table(fx.samples(spark, sf_dir), _KEYS), _KEYS)
    return rows.select("key", (F.col("mean") != "*").alias("known"), F.floor(F.col("mean").try_cast("double") + F.lit(0.37)).cast("long").alias("mean"))


@query()
def w09_summary_lines(spark, sf_dir):
    return stats.summary_lines(fx.samples(spark, sf_dir))

"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from voxelspark.plans import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(row) -> tuple:
    return tuple(repr(float(v)) if isinstance(v, float) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rows = sorted(plain(r) for r in got.select(*[f"`{n}`" for n in names]).collect())
    if name not in ORACLE:
        assert rows
        return
    cols = ", ".join(f'"{n}"' for n in names)
    want = con.sql(f"select {cols} from ({ORACLE[name]})").fetchall()
    assert rows == sorted(plain(r) for r in want)


def test_sorts_return_every_row(spark):
    for whole, rows in (("s01_sort_keys", "s03_unique_keys"), ("i11_rgb_order", "i11_rgb_arithmetic")):
        n = QUERIES[rows](spark, DATA).count()
        ranks = [r["rank"] for r in QUERIES[whole](spark, DATA).collect()]
        assert n >= 1000 and sorted(ranks) == list(range(1, n + 1))


def test_rays_are_followed_to_the_far_plane(spark, con):
    from voxelspark.plans import tracking

    change = "SELECT *, lag(value) OVER (PARTITION BY id ORDER BY k) AS before FROM al"
    sql = f"{tracking._ALONG}, ch AS ({change}) SELECT id, arg_min((k - 1) * 0.5 + before / (before - value) * 0.5, k) AS t FROM ch WHERE before >= 0 AND value < 0 GROUP BY id"
    want = dict(con.sql(sql).fetchall())
    got = {r["id"]: r["t_1e6"] / 1e6 for r in QUERIES["c04_raycast_surface"](spark, DATA).collect()}
    assert max(want.values()) > 24 and got.keys() == want.keys() and all(abs(got[i] - want[i]) < 3e-6 for i in want)
    assert {r["id"] for r in QUERIES["c06_raycast_volume"](spark, DATA).select("id").collect()} == want.keys()


def test_rays_skip_empty_blocks(spark):
    from voxelspark.operators import raycast
    from voxelspark.plans import tracking

    voxels, rays = tracking.emptied(spark, DATA), tracking.rays(spark, DATA)
    whole = raycast.samples(rays, voxels, 24, 0.5)
    some = raycast.samples(rays, voxels, 24, 0.5, blocks=raycast.occupied_blocks(voxels))
    above = lambda d: sorted(map(tuple, d.filter("value > 0").collect()))
    assert 0 < some.count() < whole.count() and above(some) == above(whole) != []


def test_entry_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/voxelspark", tmp_path / "voxelspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'k05_encode_code' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})

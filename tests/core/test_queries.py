"""Every registered query beside its SQL, on the smallest tables."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trajecta import plans
from trajecta.functions import exprs

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in plans.SQL:
        assert rows
        return
    want = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(value(r[c]) for c in columns) for r in rows)
    assert got == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())


def same(spark, folder, name, tables):
    """The query over own tables (name: Arrow table) gives the rows of its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, want = plans.QUERIES[name](spark, str(folder)), con.sql(plans.SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    rows = sorted(tuple(map(str, r)) for r in df.collect())
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    return rows


def test_logarithms_at_their_limits(spark, tmp_path):
    values = [0.0, -0.0, -0.5, -1.0, -3.0, 0.01, 250.0, None]
    same(spark, tmp_path, "math_scalar", {"events": pa.table({"event_id": range(len(values)), "value": pa.array(values, pa.float64())})})


def corners(seed: int, users: int = 3000) -> pa.Table:
    """Paths of four points and integer steps: each turns back, by a right angle or by 45 degrees."""
    rng, rows = random.Random(seed), []
    for user in range(users):
        a, b = rng.randint(1, 24), rng.randint(-24, 24)
        c, d = rng.choice([(a, b), (-a, -b), (-b, a), (b, -a), (a - b, a + b), (a + b, b - a)])
        e, f = rng.choice([(-d, c), (d, -c), (-c, -d)])
        at = [(200, 200), (200 + a, 200 + b), (200 + a + c, 200 + b + d), (200 + a + c + e, 200 + b + d + f)]
        rows += [(4 * user + k, datetime(2024, 1, 1) + timedelta(hours=k), user, "click", float(x), f'{{"k": {y}}}') for k, (x, y) in enumerate(at)]
    return pa.table(dict(zip(["event_id", "ts", "user_id", "event_type", "value", "props"], map(list, zip(*rows, strict=True)), strict=True)))


@pytest.mark.parametrize("name", ["sym_direction_bins", "sym_turn_bins", "seq_curvature"])
def test_turns_on_the_edges_of_sectors(spark, tmp_path, name):
    same(spark, tmp_path, name, {"events": corners(1)})


def test_symbols_on_the_edges_of_sectors(spark, tmp_path):
    same(spark, tmp_path, "session_symbols", {"events": corners(2, 600)})


def eighths(seed: int, height: int = 1, users: int = 200) -> pa.Table:
    """Paths of three points and a turn by 135 degrees, between steps of which libm doesn't round one to the nearest double. The
    users have no viewport width and a height of 50, so sessions need y multiplied by ``height``."""
    rng, rows = random.Random(seed), []
    steps = [((-79, -161), (240, 82)), ((-155, -78), (233, -77)), ((-97, -75), (172, -22)), ((-77, -61), (138, -16)), ((-103, -55), (158, -48)), ((158, -48), (-206, -110)), ((79, -24), (-103, -55)), ((138, -16), (-154, -122))]
    for user in range(users):
        (a, b), (c, d), x, y = *rng.choice(steps), rng.randint(300, 400), rng.randint(300, 400)
        at = [(x, y), (x + a, y + b), (x + a + c, y + b + d)]
        rows += [(3 * user + k, datetime(2024, 1, 1) + timedelta(hours=k), 162 + 207 * user, "click", float(u), f'{{"k": {height * v}}}') for k, (u, v) in enumerate(at)]
    return pa.table(dict(zip(["event_id", "ts", "user_id", "event_type", "value", "props"], map(list, zip(*rows, strict=True)), strict=True)))


@pytest.mark.parametrize("name", ["sym_turn_bins"])
def test_turns_where_libm_is_not_nearest(spark, tmp_path, name):
    same(spark, tmp_path, name, {"events": eighths(1)})


#: x with two decimals, whose differences aren't exact: at each path's reversal or right angle Java's atan2, libm's or the nearest double differ in what they give.
PATHS = [
    [(23.98, 22), (15.6, 38), (19.79, 30)], [(568.45, 98), (598.1, 188), (509.15, -82)], [(333.85, 5), (299.75, 69), (402.05, -123)], [(396.36, 74), (419.01, 96), (351.06, 30)], [(470.43, 16), (446.83, 84), (494.03, -52)],
    [(328.72, 93), (237.72, 137), (281.72, 228)], [(195.97, 43), (280.97, 3), (240.97, -82)], [(539.34, 3), (471.34, 82), (550.34, 150)], [(517.19, 75), (449.19, -4), (528.19, -72)], [(237.04, 21), (281.04, 112), (190.04, 156)],
]


def decimals(height: int = 1) -> pa.Table:
    """Users as in ``eighths``."""
    rows = [(3 * user + k, datetime(2024, 1, 1) + timedelta(hours=k), 162 + 207 * user, "click", x, f'{{"k": {height * y}}}') for user, path in enumerate(PATHS) for k, (x, y) in enumerate(path)]
    return pa.table(dict(zip(["event_id", "ts", "user_id", "event_type", "value", "props"], map(list, zip(*rows, strict=True)), strict=True)))


def test_curvature_of_paths_with_decimals(spark, tmp_path):
    same(spark, tmp_path, "seq_curvature", {"events": decimals()})


def test_symbols_of_paths_with_decimals(spark, tmp_path):
    same(spark, tmp_path, "session_symbols", {"events": decimals(50)})


def test_symbols_where_libm_is_not_nearest(spark, tmp_path):
    same(spark, tmp_path, "session_symbols", {"events": eighths(2, 50)})


def test_angles_are_rounded_as_by_libm(spark):
    rng = random.Random(3)
    pairs = [(rng.uniform(-490, 490), float(rng.randint(-99, 99))) for _ in range(20_000)]
    pairs += [(x, y) for x in (0.0, 1.0, -2.0, 1e-300, -1e300) for y in (0.0, 1.0, -2.0, 1e-300, -1e300)]
    df = spark.createDataFrame(pa.table({"x": [x for x, _ in pairs], "y": [y for _, y in pairs], "want": [math.atan2(y, x) for x, y in pairs]}))
    made = df.withColumn("angle", exprs.angle_of(F.col("y"), F.col("x")))
    assert made.where("not angle <=> want").count() < len(pairs) / 500  # libm itself misses the nearest double so often
    assert made.where("abs(angle - want) > 1e-15 * abs(want)").count() == 0

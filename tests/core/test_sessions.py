import math

import pytest
from pyspark.sql import functions as F

from trajecta.functions import exprs
from trajecta.operators import flat, sessions
from trajecta.schema import SCALARS, ingest

MOUSE = "array<struct<timestamp_: double, x_: double, y_: double>>"
TOUCH = "array<struct<timestamp: double, x: double, y: double, force: double, radiusX: double, radiusY: double, rotationAngle: double>>"
SCHEMA = f"id long, target int, {', '.join(f'{c} double' for c in SCALARS)}, mouse_events {MOUSE}, touch_events {TOUCH}"
F1 = [(0.0, 0.0, 0.0), (50.0, 3.0, 4.0), (100.0, 3.0, 4.0), (150.0, 6.0, 8.0)]


def session(i, mouse=None, touch=None, **scalars):
    return (i, i % 2, *(scalars.get(c) for c in SCALARS), mouse, touch)


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        session(1, F1, [], viewport_width=1000.0, viewport_height=1000.0, mouse_events_total=120.0, touch_events_total=0.0, pointerdown_x=6.0, pointerdown_y=8.0, pointerup_x=9.0, pointerup_y=12.0, pointerdown_timestamp=10.0, pointerup_timestamp=30.0, hover_x=0.0, hover_y=0.0, hover_timestamp=0.0),
        session(2, None, None),
        session(3, [(5.0, 1.0, 1.0)], None, viewport_width=float("nan"), viewport_height=-1.0),
        session(4, [(10.0, 1.0, 1.0), (0.0, 4.0, 5.0), (10.0, 1.0, 1.0)], [(10.0, 2.0, 2.0, 0.5, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, None)], viewport_width=10.0, viewport_height=10.0),
        session(5, [(0.0, 2.0, 2.0), (1.0, 2.0, 2.0), (2.0, float("nan"), 2.0)], None),
    ]
    return ingest(spark.createDataFrame(rows, SCHEMA)).cache()


def test_ingest_normalises(table):
    rows = {r.id: r for r in table.collect()}
    assert rows[2].mouse_events == [] and rows[2].touch_events == []
    assert rows[3].viewport_width is None and rows[5].mouse_events[2].x is None
    assert rows[1].mouse_events[1].t == 50.0 and rows[4].touch_events[0].force == 0.5


def test_reusable_layer(table):
    df = sessions.reusable_features(table)
    assert len(df.columns) - 1 == 155
    rows = {r.id: r.asDict() for r in df.collect()}
    r = rows[1]
    want = {
        "mouse_path_length": 10, "mouse_straight": 10, "mouse_tortuosity": 1, "mouse_zero_step_ratio": 1 / 3, "mouse_dt_mean": 50, "mouse_dt_std": 0, "mouse_speed_mean": 0.0666667, "mouse_speed_std": 0.0471405,
        "mouse_unique_xy_ratio": 0.75, "mouse_mean_x": 3, "mouse_std_x": 2.1213203, "mouse_std_y": 2.8284271, "mouse_bbox_area": 48, "mouse_q10_x": 0.9, "mouse_q90_x": 5.1, "mouse_turn_mean": 0, "mouse_turn_std": 0.9272952, "mouse_turn_abs_mean": 0.9272952, "mouse_pause_100_ratio": 0,
        "mouse_duration": 150, "mouse_share": 1, "down_x_norm": 0.006,
    }
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-6), k
    assert rows[2]["mouse_n"] == 0 and rows[2]["mouse_path_length"] is None and rows[2]["mouse_first_x"] is None
    assert (rows[3]["mouse_net_dx"], rows[3]["mouse_straight"], rows[3]["mouse_path_length"]) == (0.0, 0.0, None)
    # sorted by time: (0, 4, 5), (10, 1, 1), (10, 1, 1); equal times give no speed
    assert rows[4]["mouse_path_length"] == 5 and rows[4]["mouse_speed_mean"] == 0.5 and rows[4]["touch_force_mean"] == 0.75
    assert rows[5]["mouse_path_length"] == 0 and rows[5]["mouse_tortuosity"] is None


def test_competition_layer(table):
    df = sessions.competition_features(table)
    assert len(df.columns) - 1 == 118
    rows = {r.id: r.asDict() for r in df.collect()}
    r = rows[1]
    want = {"pointer_dist": 5, "click_speed": 0.25, "click_duration": 20, "hover_zero": 1, "mouse_truncated": 1, "mouse_total_minus_len": 116, "only_mouse": 1, "mouse_path": 10, "mouse_last_to_down": 0, "mouse_last_to_up": 5, "mouse_stationary_ratio": 1 / 3, "pd_outside": 0, "mouse_touch_ratio": 121}
    for k, v in want.items():
        assert r[k] == pytest.approx(v), k
    assert rows[2]["mouse_n"] == 0 and rows[2]["hover_zero"] == 0 and rows[2]["pointer_dist"] is None
    assert (rows[3]["mouse_dur"], rows[3]["mouse_path"], rows[3]["viewport_invalid"]) == (0.0, None, 1.0)
    # stored order: time goes back, so speeds can be negative
    assert rows[4]["mouse_speed_min"] == -0.5 and rows[4]["mouse_dt_min"] == -10
    assert rows[5]["mouse_n"] == 2


def test_artifacts(table):
    rows = {r.id: r.asDict(recursive=True) for r in sessions.artifacts(table).collect()}
    r = rows[1]
    assert r["symbol_text"] == "d1_s2_t4_q0 d0_s2_t2_q1 d1_s2_t5_q0"
    assert (r["dir_hash"], r["speed_hash"], r["turn_hash"]) == ("02e7720e7761d968", "3ac810c2e873c517", "1bf784ca8b48111e")
    assert (r["state_hash"], r["dir_speed_hash"], r["dir_turn_dt_hash"]) == ("f755f5b666b1cb46", "7a7d84da3de328ce", "dae5862120ba78d3")
    assert rows[2]["symbol_text"] == "pad" and rows[2]["dir_hash"] == "ad87109bfff0765f" == rows[3]["dir_hash"]
    assert len(r["time_x"]) == 32 and r["time_x"][0] == 0 and r["time_x"][-1] == pytest.approx(0.006)
    # a third of the time is half of the way, then the pointer rests
    assert r["time_x"][15] == pytest.approx(0.003) and r["arc_x"][16] == pytest.approx(0.006 * 16 / 31)
    assert math.hypot(r["unit_x"][-1], r["unit_y"][-1]) == pytest.approx(1)
    assert rows[2]["time_x"] == [0.0] * 32 and len(r["tensor"]) == 100
    assert r["tensor"][4]["is_padding"] == 1 and r["tensor"][3]["is_mouse"] == 1 and r["tensor"][3]["dx"] == pytest.approx(0.003)
    # mouse comes first at equal times
    union = table.where("id = 4").select(F.transform(sessions.union_modalities(F.col("mouse_events"), F.col("touch_events")), lambda e: e.src).alias("s")).first().s
    assert union == [0, 1, 0, 0, 1]


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 1e-9), (1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] is not None for r in df.select(exprs.safe_div(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert [r[0] is not None for r in df.select(exprs.safe_div_strict(F.col("a"), F.col("b"))).collect()] == [False, False, False]
    assert df.select(exprs.wrap_angle(F.lit(1.5 * math.pi))).first()[0] == pytest.approx(-math.pi / 2)
    assert df.select(exprs.binary_entropy(F.lit(0.75))).first()[0] == pytest.approx(0.5623351)
    text = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in text.select(exprs.number("v")).collect()] == [1.5, None, None, None, None]


def test_still_clocks_are_spaced_by_position(spark):
    """Events of one time, and a pointer that doesn't move: the points are evenly spaced."""
    rows = [session(1, [(7.0, 0.0, 0.0), (7.0, 4.0, 0.0), (7.0, 4.0, 8.0)], None, viewport_width=1.0, viewport_height=1.0), session(2, [(0.0, 2.0, 2.0), (9.0, 2.0, 2.0)], None, viewport_width=1.0, viewport_height=1.0), session(3, [(1.0, 5.0, 6.0)], None, viewport_width=1.0, viewport_height=1.0)]
    got = {r.id: r for r in sessions.artifacts(ingest(spark.createDataFrame(rows, SCHEMA)), points=5).collect()}
    assert list(got[1].time_x) == [0, 2, 4, 4, 4] and list(got[1].time_y) == [0, 0, 0, 4, 8]
    assert list(got[2].arc_x) == [2.0] * 5 and list(got[3].time_y) == [6.0] * 5
    flat_rows = spark.createDataFrame([(1, k + 1, 7.0, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 8.0)])] + [(2, 1, 3.0, 5.0, 6.0)], "id long, pos long, t double, x double, y double")
    made = {(r.id, r.k): (r.rx, r.ry) for r in flat.resample(flat_rows, "t", 5).collect()}
    assert [made[1, k] for k in range(5)] == [(0, 0), (2, 0), (4, 0), (4, 4), (4, 8)] and [made[2, k] for k in range(5)] == [(5, 6)] * 5


def test_long_sessions_take_time_in_proportion(spark):
    """A deviation is one pass over its array: 20 000 points, which a pass for each of them would take minutes for."""
    df = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda k: k.cast("double")).alias("v"))
    got = df.select(sessions.spread(F.col("v")).alias("s")).collect()
    assert all(r.s == pytest.approx(((20_000**2 - 1) / 12) ** 0.5) for r in got)

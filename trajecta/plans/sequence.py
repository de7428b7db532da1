"""Trajectory queries: first differences, geometry, timing, derivatives, resampling, tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.exprs import direction_bin, flag, r6
from trajecta.operators import flat, sessions
from trajecta.operators.flat import order, whole
from trajecta.plans.registry import EVENTS, Tables, events, query, steps
from trajecta.plans.registry import r6 as s6


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Keys as they are, all other columns at six decimals; statistics of intervals, which are large, at three."""
    return df.select(*keys, *(r6(c, 3 if c in LARGE else 6).alias(c) for c in df.columns if c not in keys))


LARGE = ("dt_mean", "dt_std", "dt_min", "dt_max")


def per_user(select: str, source: str = "st", more: str = "") -> str:
    return f"{EVENTS} SELECT id, {select} FROM {source} {more} GROUP BY id"


@query(
    "seq_path_geometry",
    EVENTS
    + f""", g AS (
  SELECT id, count(*) AS n, sum(step) AS path, arg_max(x, pos) - arg_min(x, pos) AS gx, arg_max(y, pos) - arg_min(y, pos) AS gy,
    arg_max(t, pos) - arg_min(t, pos) AS duration, avg(speed) AS speed_mean, max(step) AS step_max FROM st GROUP BY id
) SELECT id, n, {s6('path')}, {s6('sqrt(gx*gx+gy*gy)', 'displacement')},
  {s6('CASE WHEN path > 1e-9 THEN sqrt(gx*gx+gy*gy) / path END', 'straightness')},
  {s6('CASE WHEN sqrt(gx*gx+gy*gy) >= 1e-9 THEN path / sqrt(gx*gx+gy*gy) END', 'tortuosity')}, {s6('duration')}, {s6('speed_mean')}, {s6('step_max')} FROM g""",
)
def seq_path_geometry(t: Tables) -> DataFrame:
    return rounded(steps(t).groupBy("id").agg(F.count("*").alias("n"), *flat.path_geometry(), F.avg("speed").alias("speed_mean"), F.max("step").alias("step_max")), "id", "n")


@query("win_lag_diff", EVENTS + f"SELECT id, pos, {s6('dx')}, {s6('dy')}, {s6('dt')} FROM st")
def win_lag_diff(t: Tables) -> DataFrame:
    return rounded(steps(t).select("id", "pos", "dx", "dy", "dt"), "id", "pos")


@query("win_running_sum", EVENTS + f"SELECT id, pos, {s6('sum(coalesce(step, 0)) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)', 'length')} FROM st")
def win_running_sum(t: Tables) -> DataFrame:
    length = F.sum(F.coalesce("step", F.lit(0.0))).over(order().rowsBetween(Window.unboundedPreceding, 0))
    return rounded(steps(t).select("id", "pos", length.alias("length")), "id", "pos")


@query("seq_bbox", per_user(f"{s6('max(x)-min(x)', 'width')}, {s6('max(y)-min(y)', 'height')}, {s6('(max(x)-min(x))*(max(y)-min(y))', 'area')}, {s6('CASE WHEN max(y)-min(y) >= 1e-9 THEN (max(x)-min(x))/(max(y)-min(y)) END', 'aspect')}"))
def seq_bbox(t: Tables) -> DataFrame:
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return rounded(events(t).groupBy("id").agg(w.alias("width"), h.alias("height"), (w * h).alias("area"), F.when(h >= 1e-9, w / h).alias("aspect")), "id")


@query("seq_first_last", per_user(", ".join(f"{s6(f'arg_min({c}, pos)', f'first_{c}')}, {s6(f'arg_max({c}, pos)', f'last_{c}')}" for c in "xyt")))
def seq_first_last(t: Tables) -> DataFrame:
    return rounded(events(t).groupBy("id").agg(*(a for c in "xyt" for a in (F.min_by(c, "pos").alias(f"first_{c}"), F.max_by(c, "pos").alias(f"last_{c}")))), "id")


SQL_STATS = {"mean": "avg({c})", "std": "stddev_pop({c})", "min": "min({c})", "max": "max({c})", "median": "median({c})", "q10": "quantile_cont({c}, 0.1)", "q90": "quantile_cont({c}, 0.9)", "sum": "sum({c})"}


def sql_stats(c: str, prefix: str, *names: str) -> str:
    return ", ".join(s6(SQL_STATS[n].format(c=c), f"{prefix}_{n}", 3 if f"{prefix}_{n}" in LARGE else 6) for n in names)


def statistics(name: str, column: str, *names: str) -> None:
    query(name, per_user(sql_stats(column, column, *names)))(lambda t: rounded(steps(t).groupBy("id").agg(*flat.stats(column, column, *names)), "id"))


statistics("seq_step_stats", "step", "mean", "std", "min", "max", "median")
statistics("seq_dt_stats", "dt", "mean", "std", "min", "max")
statistics("seq_speed_stats", "speed", "mean", "std", "min", "max")


@query("seq_position_stats", per_user(sql_stats("x", "x", "mean", "std", "median", "q10", "q90") + ", " + sql_stats("y", "y", "mean", "std", "median", "q10", "q90")))
def seq_position_stats(t: Tables) -> DataFrame:
    return rounded(events(t).groupBy("id").agg(*(s for c in "xy" for s in flat.stats(c, c, "mean", "std", "median", "q10", "q90"))), "id")


@query("seq_turns", per_user(f"{s6('avg(turn)', 'turn_mean')}, {s6('stddev_pop(turn)', 'turn_std')}, {s6('avg(abs(turn))', 'turn_abs_mean')}"))
def seq_turns(t: Tables) -> DataFrame:
    return rounded(steps(t).groupBy("id").agg(F.avg("turn").alias("turn_mean"), F.stddev_pop("turn").alias("turn_std"), F.avg(F.abs("turn")).alias("turn_abs_mean")), "id")


@query("seq_unique_ratio", per_user(s6("count(DISTINCT (x, y)) / count(*)", "unique_ratio"), "ev"))
def seq_unique_ratio(t: Tables) -> DataFrame:
    return rounded(events(t).groupBy("id").agg((F.countDistinct(F.struct("x", "y")) / F.count("*")).alias("unique_ratio")), "id")


@query("seq_zero_step", per_user(f"{s6('avg(CASE WHEN step < 1e-9 THEN 1.0 WHEN step >= 1e-9 THEN 0.0 END)', 'zero_step_ratio')}, {s6('avg(CASE WHEN step = 0 THEN 1.0 WHEN step <> 0 THEN 0.0 END)', 'stationary_ratio')}"))
def seq_zero_step(t: Tables) -> DataFrame:
    s = F.col("step")
    return rounded(steps(t).groupBy("id").agg(flat.share(s < 1e-9, s).alias("zero_step_ratio"), flat.share(s == 0, s).alias("stationary_ratio")), "id")


@query("seq_pause_ratios", per_user(", ".join(s6(f"avg(CASE WHEN dt > {k} THEN 1.0 WHEN dt <= {k} THEN 0.0 END)", f"pause_{k}") for k in (100, 250, 500, 1000))))
def seq_pause_ratios(t: Tables) -> DataFrame:
    dt = F.col("dt")
    return rounded(steps(t).groupBy("id").agg(*(flat.share(dt > k, dt).alias(f"pause_{k}") for k in (100, 250, 500, 1000))), "id")


@query("seq_series_stats", EVENTS + f"SELECT id, event_type, {sql_stats('x', 'x', 'mean', 'std', 'min', 'max', 'median', 'q10', 'q90')} FROM ev GROUP BY id, event_type")
def seq_series_stats(t: Tables) -> DataFrame:
    return rounded(events(t).groupBy("id", "event_type").agg(*flat.stats("x", "x", "mean", "std", "min", "max", "median", "q10", "q90")), "id", "event_type")


@query("seq_sorted", EVENTS + "SELECT id, string_agg(CAST(event_type AS VARCHAR), '|' ORDER BY pos) AS kinds, count(*) AS n FROM ev GROUP BY id")
def seq_sorted(t: Tables) -> DataFrame:
    return sessions.collected(events(t), "event_type").select("id", F.array_join(F.transform("events", lambda e: e.event_type), "|").alias("kinds"), F.size("events").cast("long").alias("n"))


@query("seq_valid_points", EVENTS + f"SELECT id, count(*) FILTER (WHERE x IS NOT NULL AND y > 20) AS n_valid, {s6('sum(x) FILTER (WHERE x IS NOT NULL AND y > 20)', 'sum_x')} FROM ev GROUP BY id")
def seq_valid_points(t: Tables) -> DataFrame:
    nested = sessions.collected(events(t).withColumn("y", F.when(F.col("y") > 20, F.col("y"))))
    ok = nested.select("id", sessions.valid_points(F.col("events")).alias("events"))
    total = F.when(F.size("events") > 0, F.aggregate("events", F.lit(0.0), lambda s, e: s + e.x))
    return ok.select("id", F.size("events").cast("long").alias("n_valid"), r6(total).alias("sum_x"))


MODES = "CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END"


@query(
    "seq_union_modalities",
    EVENTS + f", u AS (SELECT id, {MODES} AS src, floor(t / 3600000) AS hour, pos FROM ev) SELECT id, string_agg(CAST(src AS VARCHAR), '' ORDER BY hour, src, pos) AS order_of_sources FROM u GROUP BY id",
)
def seq_union_modalities(t: Tables) -> DataFrame:
    rows = events(t).withColumn("t", F.floor(F.col("t") / 3_600_000).cast("double")).withColumn("mouse", F.col("event_type").isin("click", "view"))
    item = F.struct("t", "pos", "x", "y")
    both = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("mouse"), item))).alias("mouse"), F.array_sort(F.collect_list(F.when(~F.col("mouse"), item))).alias("touch"))
    return both.select("id", F.array_join(F.transform(sessions.union_modalities(F.col("mouse"), F.col("touch")), lambda e: e.src.cast("string")), "").alias("order_of_sources"))


VIEW = ", v AS (SELECT *, max(x) OVER (PARTITION BY id) AS vw, max(y) OVER (PARTITION BY id) AS vh FROM st)"


def viewed(df: DataFrame) -> DataFrame:
    """Adds the trajectory's viewport: its largest x and y."""
    return df.withColumns({"vw": F.max("x").over(whole()), "vh": F.max("y").over(whole())})


@query("seq_viewport_norm", EVENTS + VIEW + f"SELECT id, pos, {s6('x / CASE WHEN vw > 0 THEN vw ELSE 1 END', 'nx')}, {s6('y / CASE WHEN vh > 0 THEN vh ELSE 1 END', 'ny')} FROM v")
def seq_viewport_norm(t: Tables) -> DataFrame:
    rows = viewed(events(t))
    widest = lambda c: F.greatest(F.max(F.abs(c)).over(whole()), F.lit(1.0))
    return rounded(rows.select("id", "pos", (F.col("x") / F.when(F.col("vw") > 0, F.col("vw")).otherwise(widest("x"))).alias("nx"), (F.col("y") / F.when(F.col("vh") > 0, F.col("vh")).otherwise(widest("y"))).alias("ny")), "id", "pos")


@query(
    "seq_start_end_norm",
    EVENTS
    + f""", g AS (SELECT id, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x9, arg_max(y, pos) AS y9, sum(step) AS path FROM st GROUP BY id),
s AS (SELECT *, CASE WHEN sqrt((x9-x0)*(x9-x0)+(y9-y0)*(y9-y0)) > 1e-9 THEN sqrt((x9-x0)*(x9-x0)+(y9-y0)*(y9-y0)) WHEN path > 1e-9 THEN path ELSE 1 END AS scale FROM g)
SELECT id, pos, {s6('(x - x0) / scale', 'nx')}, {s6('(y - y0) / scale', 'ny')} FROM ev JOIN s USING (id)""",
)
def seq_start_end_norm(t: Tables) -> DataFrame:
    full = order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = steps(t).withColumns({"x0": F.first("x").over(full), "y0": F.first("y").over(full), "x9": F.last("x").over(full), "y9": F.last("y").over(full), "path": F.sum("step").over(whole())})
    far = F.sqrt((F.col("x9") - F.col("x0")) ** 2 + (F.col("y9") - F.col("y0")) ** 2)
    scale = F.when(far > 1e-9, far).when(F.col("path") > 1e-9, F.col("path")).otherwise(1.0)
    return rounded(rows.select("id", "pos", ((F.col("x") - F.col("x0")) / scale).alias("nx"), ((F.col("y") - F.col("y0")) / scale).alias("ny")), "id", "pos")


@query(
    "seq_dt_validity",
    per_user(f"""count(*) FILTER (WHERE dt < 0) AS n_backward, count(*) FILTER (WHERE dt = 0) AS n_same_time, {s6('count(DISTINCT dt) / nullif(count(dt), 0)', 'dt_unique_ratio')},
  {s6('avg(CASE WHEN dt = 50 THEN 1.0 WHEN dt <> 50 THEN 0.0 END)', 'share_dt_50')}, {s6('avg(CASE WHEN dt % 50 = 0 THEN 1.0 WHEN dt % 50 <> 0 THEN 0.0 END)', 'share_dt_multiple_50')},
  {s6('avg(dt % 50)', 'dt_mod_50_mean')}, {s6('stddev_pop(dt % 50)', 'dt_mod_50_std')}, {s6('median(dt)', 'dt_median')}"""),
)
def seq_dt_validity(t: Tables) -> DataFrame:
    dt, mod = F.col("dt"), F.pmod("dt", F.lit(50.0))
    return rounded(
        steps(t).groupBy("id").agg(
            F.count_if(dt < 0).alias("n_backward"), F.count_if(dt == 0).alias("n_same_time"), (F.countDistinct("dt") / F.when(F.count("dt") > 0, F.count("dt"))).alias("dt_unique_ratio"),
            flat.share(dt == 50, dt).alias("share_dt_50"), flat.share(mod == 0, dt).alias("share_dt_multiple_50"), F.avg(mod).alias("dt_mod_50_mean"), F.stddev_pop(mod).alias("dt_mod_50_std"), F.median(dt).alias("dt_median"),
        ), "id", "n_backward", "n_same_time",
    )


@query("seq_truncation", per_user(f"count(*) AS total, least(count(*), 60) AS kept, count(*) - least(count(*), 60) AS minus_len, CAST(count(*) > 60 AS INTEGER) AS truncated, {s6('min(t) FILTER (WHERE pos > n - 60)', 'saved_first_t')}, {s6('max(t) FILTER (WHERE pos > n - 60)', 'saved_last_t')}", "ev"))
def seq_truncation(t: Tables) -> DataFrame:
    nested = sessions.collected(events(t)).select("id", F.size("events").alias("total"), sessions.last_events(F.col("events"), 60).alias("kept"))
    return nested.select(
        "id", F.col("total").cast("long").alias("total"), F.size("kept").cast("long").alias("kept"), (F.col("total") - F.size("kept")).cast("long").alias("minus_len"),
        flag(F.col("total") > F.size("kept")).alias("truncated"), r6(F.get("kept", F.lit(0)).t).alias("saved_first_t"), r6(F.element_at("kept", -1).t).alias("saved_last_t"),
    )


@query("topk_last_events", EVENTS + f"SELECT id, pos, {s6('x')} FROM ev WHERE pos > n - 10")
def topk_last_events(t: Tables) -> DataFrame:
    return rounded(events(t).where(F.col("pos") > F.col("n") - 10).select("id", "pos", "x"), "id", "pos")


@query("seq_outside_share", EVENTS + f"SELECT id, count(*) FILTER (WHERE x < 50 OR x > 400 OR y < 10 OR y > 90) AS n_outside, {s6('avg(CASE WHEN x < 50 OR x > 400 THEN 1.0 ELSE 0.0 END)', 'share_x')}, {s6('avg(CASE WHEN y < 10 OR y > 90 THEN 1.0 ELSE 0.0 END)', 'share_y')}, {s6('avg(CASE WHEN x < 50 OR x > 400 OR y < 10 OR y > 90 THEN 1.0 ELSE 0.0 END)', 'share_points')} FROM ev GROUP BY id")
def seq_outside_share(t: Tables) -> DataFrame:
    ox, oy = (F.col("x") < 50) | (F.col("x") > 400), (F.col("y") < 10) | (F.col("y") > 90)
    return rounded(events(t).groupBy("id").agg(F.count_if(ox | oy).alias("n_outside"), flat.share(ox).alias("share_x"), flat.share(oy).alias("share_y"), flat.share(ox | oy).alias("share_points")), "id", "n_outside")


DERIVED = """, a0 AS (SELECT *, dx - lag(dx) OVER w AS ax, dy - lag(dy) OVER w AS ay, speed - lag(speed) OVER w AS dv FROM st WINDOW w AS (PARTITION BY id ORDER BY pos)),
a1 AS (SELECT *, ax - lag(ax) OVER w AS jx, ay - lag(ay) OVER w AS jy, CASE WHEN abs(dt) > 1e-9 THEN dv / dt END AS accel FROM a0 WINDOW w AS (PARTITION BY id ORDER BY pos)),
a2 AS (SELECT *, CASE WHEN abs(dt) > 1e-9 THEN (accel - lag(accel) OVER w) / dt END AS jerk, sign(accel) <> sign(lag(accel) OVER w) AS flips FROM a1 WINDOW w AS (PARTITION BY id ORDER BY pos))
"""


def derived(df: DataFrame) -> DataFrame:
    """Adds second and third differences (``ax, ay, jx, jy``) and rates (``accel, jerk``: per ms)."""
    lag = lambda c: F.lag(c).over(order())
    moving = F.abs("dt") > 1e-9
    out = df.withColumns({"ax": F.col("dx") - lag("dx"), "ay": F.col("dy") - lag("dy"), "dv": F.col("speed") - lag("speed")})
    out = out.withColumns({"jx": F.col("ax") - lag("ax"), "jy": F.col("ay") - lag("ay"), "accel": F.when(moving, F.col("dv") / F.col("dt"))})
    return out.withColumns({"jerk": F.when(moving, (F.col("accel") - lag("accel")) / F.col("dt")), "flips": F.signum("accel") != F.signum(lag("accel"))})


@query("seq_derivatives", EVENTS + DERIVED + "SELECT id, pos, " + ", ".join([*(s6(c) for c in ("ax", "ay", "jx", "jy")), s6("1e6 * accel", "accel_rate"), s6("1e12 * jerk", "jerk_rate"), s6("ln(1 + abs(1e6 * accel))", "accel_log")]) + " FROM a2")
def seq_derivatives(t: Tables) -> DataFrame:
    rows = derived(steps(t))
    rate = F.col("accel") * 1e6
    return rounded(rows.select("id", "pos", "ax", "ay", "jx", "jy", rate.alias("accel_rate"), (F.col("jerk") * 1e12).alias("jerk_rate"), F.log1p(F.abs(rate)).alias("accel_log")), "id", "pos")


@query(
    "seq_accel_jerk",
    EVENTS + DERIVED + f"SELECT id, {s6('avg(1e6*accel)', 'accel_mean')}, {s6('stddev_pop(1e6*accel)', 'accel_std')}, {s6('sum(ax*ax+ay*ay)', 'accel_energy')}, {s6('sum(jx*jx+jy*jy)', 'jerk_energy')}, {s6('max(abs(1e6*accel))', 'accel_abs_max')}, count(*) FILTER (WHERE flips) AS sign_changes FROM a2 GROUP BY id",
)
def seq_accel_jerk(t: Tables) -> DataFrame:
    a = F.col("accel") * 1e6
    energy = lambda x, y: F.sum(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    return rounded(
        derived(steps(t)).groupBy("id").agg(F.avg(a).alias("accel_mean"), F.stddev_pop(a).alias("accel_std"), energy("ax", "ay").alias("accel_energy"), energy("jx", "jy").alias("jerk_energy"), F.max(F.abs(a)).alias("accel_abs_max"), F.count_if("flips").alias("sign_changes")),
        "id", "sign_changes",
    )


@query(
    "seq_line_deviation",
    EVENTS
    + f""", g AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, last_value(x) OVER w AS x9, last_value(y) OVER w AS y9 FROM ev WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT id, CASE WHEN sqrt((x9-x0)*(x9-x0)+(y9-y0)*(y9-y0)) > 1e-9 THEN abs((x9-x0)*(y-y0)-(y9-y0)*(x-x0)) / sqrt((x9-x0)*(x9-x0)+(y9-y0)*(y9-y0)) END AS dev FROM g)
SELECT id, {s6('avg(dev)', 'deviation_mean')}, {s6('max(dev)', 'deviation_max')}, {s6('stddev_pop(dev)', 'deviation_std')} FROM d GROUP BY id""",
)
def seq_line_deviation(t: Tables) -> DataFrame:
    full = order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = events(t).withColumns({"x0": F.first("x").over(full), "y0": F.first("y").over(full), "x9": F.last("x").over(full), "y9": F.last("y").over(full)})
    cx, cy = F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0")
    chord = F.sqrt(cx * cx + cy * cy)
    dev = F.when(chord > 1e-9, F.abs(cx * (F.col("y") - F.col("y0")) - cy * (F.col("x") - F.col("x0"))) / chord)
    return rounded(rows.groupBy("id").agg(F.avg(dev).alias("deviation_mean"), F.max(dev).alias("deviation_max"), F.stddev_pop(dev).alias("deviation_std")), "id")


@query(
    "seq_speed_profile",
    EVENTS
    + f""", p AS (SELECT *, 1e6 * speed AS v, avg(1e6 * speed) OVER (PARTITION BY id) AS m, lag(speed) OVER w < speed AND lead(speed) OVER w < speed AS peak FROM st WINDOW w AS (PARTITION BY id ORDER BY pos)),
q AS (SELECT id, avg(v) AS m1, avg((v-m)*(v-m)) AS m2, avg((v-m)*(v-m)*(v-m)) AS m3, avg((v-m)*(v-m)*(v-m)*(v-m)) AS m4, quantile_cont(v, 0.1) AS q10, median(v) AS q50, quantile_cont(v, 0.9) AS q90,
  quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, count(*) FILTER (WHERE peak) AS n_peaks, arg_min(pos, (-v, pos)) / max(n) AS peak_at FROM p WHERE v IS NOT NULL GROUP BY id)
SELECT id, {s6('q10')}, {s6('q50')}, {s6('q90')}, {s6('iqr')}, {s6('CASE WHEN abs(m1) > 1e-9 THEN sqrt(m2) / m1 END', 'cv')}, {s6('CASE WHEN m2 > 1e-12 THEN m3 / (m2 * sqrt(m2)) END', 'skew')}, {s6('CASE WHEN m2 > 1e-12 THEN m4 / (m2 * m2) - 3 END', 'kurtosis')}, n_peaks, {s6('peak_at')} FROM q""",
)
def seq_speed_profile(t: Tables) -> DataFrame:
    v = F.col("v")
    rows = steps(t).withColumn("v", F.col("speed") * 1e6)
    rows = rows.withColumns({"c": v - F.avg("v").over(whole()), "peak": (F.lag("speed").over(order()) < F.col("speed")) & (F.lead("speed").over(order()) < F.col("speed"))}).where(v.isNotNull())
    c = F.col("c")
    q = rows.groupBy("id").agg(
        F.avg(v).alias("m1"), F.avg(c * c).alias("m2"), F.avg(c * c * c).alias("m3"), F.avg(c * c * c * c).alias("m4"), F.percentile(v, [0.1, 0.25, 0.5, 0.75, 0.9]).alias("q"),
        F.count_if("peak").alias("n_peaks"), (F.min_by("pos", F.struct(-v, "pos")) / F.max("n")).alias("peak_at"),
    )
    m1, m2 = F.col("m1"), F.col("m2")
    return rounded(
        q.select("id", F.col("q")[0].alias("q10"), F.col("q")[2].alias("q50"), F.col("q")[4].alias("q90"), (F.col("q")[3] - F.col("q")[1]).alias("iqr"), F.when(F.abs(m1) > 1e-9, F.sqrt(m2) / m1).alias("cv"),
                 F.when(m2 > 1e-12, F.col("m3") / (m2 * F.sqrt(m2))).alias("skew"), F.when(m2 > 1e-12, F.col("m4") / (m2 * m2) - 3).alias("kurtosis"), "n_peaks", "peak_at"),
        "id", "n_peaks",
    )


@query("seq_curvature", per_user(f"{s6('sum(turn)', 'turn_sum')}, {s6('sum(abs(turn))', 'turn_abs_sum')}, {s6('sum(turn*turn)', 'energy')}, " + ", ".join(f"count(*) FILTER (WHERE abs(turn) > radians({k})) AS sharp_{k}" for k in (30, 60, 90)) + f", {s6('avg(CASE WHEN abs(turn) < radians(10) THEN 1.0 WHEN turn IS NOT NULL THEN 0.0 END)', 'straight_share')}"))
def seq_curvature(t: Tables) -> DataFrame:
    turn = F.col("turn")
    sharp = [F.count_if(F.abs(turn) > F.radians(F.lit(float(k)))).alias(f"sharp_{k}") for k in (30, 60, 90)]
    return rounded(steps(t).groupBy("id").agg(F.sum(turn).alias("turn_sum"), F.sum(F.abs(turn)).alias("turn_abs_sum"), F.sum(turn * turn).alias("energy"), *sharp, flat.share(F.abs(turn) < F.radians(F.lit(10.0)), turn).alias("straight_share")), "id", "sharp_30", "sharp_60", "sharp_90")


@query(
    "seq_minjerk",
    EVENTS
    + f""", c AS (SELECT id, pos, sum(coalesce(step, 0)) OVER w AS len, t / nullif(max(t) OVER (PARTITION BY id), 0) AS tau, sum(step) OVER (PARTITION BY id) AS path FROM st WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT id, len / nullif(path, 0) AS s, 10*tau*tau*tau - 15*tau*tau*tau*tau + 6*tau*tau*tau*tau*tau AS ideal FROM c)
SELECT id, {s6('avg((s-ideal)*(s-ideal))', 'mse')}, {s6('avg(abs(s-ideal))', 'mae')}, {s6('max(abs(s-ideal))', 'max_error')}, {s6('corr(s, ideal)', 'fit')} FROM m GROUP BY id""",
)
def seq_minjerk(t: Tables) -> DataFrame:
    rows = steps(t).withColumns({"len": F.sum(F.coalesce("step", F.lit(0.0))).over(order().rowsBetween(Window.unboundedPreceding, 0)), "path": F.sum("step").over(whole()), "end": F.max("t").over(whole())})
    tau = F.when(F.col("end") != 0, F.col("t") / F.col("end"))
    rows = rows.select("id", F.when(F.col("path") != 0, F.col("len") / F.col("path")).alias("s"), (10 * tau * tau * tau - 15 * tau * tau * tau * tau + 6 * tau * tau * tau * tau * tau).alias("ideal"))
    error = F.col("s") - F.col("ideal")
    return rounded(rows.groupBy("id").agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.max(F.abs(error)).alias("max_error"), F.corr("s", "ideal").alias("fit")), "id")


@query(
    "seq_corrections",
    EVENTS
    + f""", f AS (SELECT *, sqrt((x - last_value(x) OVER w)*(x - last_value(x) OVER w) + (y - last_value(y) OVER w)*(y - last_value(y) OVER w)) AS far FROM st WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
h AS (SELECT *, far > lag(far) OVER (PARTITION BY id ORDER BY pos) AS away FROM f)
SELECT id, count(*) FILTER (WHERE away) AS n_away, {s6('coalesce(sum(step) FILTER (WHERE 3 * pos > 2 * n), 0) / nullif(sum(step), 0)', 'last_third_path')}, {s6('stddev_pop(far) FILTER (WHERE pos > n - 5)', 'end_jitter')} FROM h GROUP BY id""",
)
def seq_corrections(t: Tables) -> DataFrame:
    full = order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = steps(t).withColumns({"ex": F.col("x") - F.last("x").over(full), "ey": F.col("y") - F.last("y").over(full)})
    rows = rows.withColumn("far", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))).withColumn("away", F.col("far") > F.lag("far").over(order()))
    total = F.sum("step")
    late = F.coalesce(F.sum(F.when(3 * F.col("pos") > 2 * F.col("n"), F.col("step"))), F.lit(0.0))
    return rounded(rows.groupBy("id").agg(F.count_if("away").alias("n_away"), F.when(total != 0, late / total).alias("last_third_path"), F.stddev_pop(F.when(F.col("pos") > F.col("n") - 5, F.col("far"))).alias("end_jitter")), "id", "n_away")


GRID = """, ck AS (SELECT *, CASE WHEN max({clock}) OVER (PARTITION BY id) - min({clock}) OVER (PARTITION BY id) <= 1e-9 THEN pos ELSE {clock} END AS ck FROM {source}),
seg AS (SELECT id, ck AS c0, lead(ck) OVER w AS c1, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, min(ck) OVER (PARTITION BY id) AS cb, max(ck) OVER (PARTITION BY id) AS ce FROM ck WINDOW w AS (PARTITION BY id ORDER BY pos)),
grid AS (SELECT seg.*, k, cb + k * (ce - cb) / 31 AS g FROM seg, range(32) r(k) WHERE ce - cb > 1e-12
  AND k >= ceil((c0 - cb) / ((ce - cb) / 31) - 1e-9) AND (c1 IS NULL OR k < ceil((c1 - cb) / ((ce - cb) / 31) - 1e-9)))
SELECT id, CAST(k AS INTEGER) AS k, {rx}, {ry} FROM grid"""
LERP = "{a} + CASE WHEN c1 IS NULL OR c1 <= c0 THEN 0 ELSE (g - c0) / (c1 - c0) * ({b} - {a}) END"


def sql_grid(clock: str, source: str) -> str:
    return GRID.format(clock=clock, source=source, rx=s6(LERP.format(a="x", b="x1"), "rx"), ry=s6(LERP.format(a="y", b="y1"), "ry"))


@query("seq_resample_time", EVENTS + sql_grid("t", "ev"))
def seq_resample_time(t: Tables) -> DataFrame:
    return rounded(flat.resample(events(t), "t", 32), "id", "k")


@query("seq_resample_arc", EVENTS + ", arc AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS len FROM st)" + sql_grid("len", "arc"))
def seq_resample_arc(t: Tables) -> DataFrame:
    rows = steps(t).withColumn("len", F.sum(F.coalesce("step", F.lit(0.0))).over(order().rowsBetween(Window.unboundedPreceding, 0)))
    return rounded(flat.resample(rows, "len", 32), "id", "k")


@query(
    "seq_tensor_channels",
    EVENTS + DERIVED + ", z AS (SELECT *, max(x) OVER (PARTITION BY id) AS vw, max(y) OVER (PARTITION BY id) AS vh FROM a2)" + f"SELECT id, pos - greatest(n - 100, 0) AS slot, {s6('x / vw', 'nx')}, {s6('y / vh', 'ny')}, {s6('coalesce(dx / vw, 0)', 'ndx')}, {s6('coalesce(dy / vh, 0)', 'ndy')}, {s6('ln(1 + coalesce(dt, 0))', 'log_dt')}, {s6('coalesce(sin(angle), 0)', 'sin_angle')}, {s6('coalesce(cos(angle), 0)', 'cos_angle')}, {s6('coalesce(turn, 0)', 'turn')}, {s6('coalesce(ax, 0)', 'ax')}, {s6('coalesce(jx, 0)', 'jx')}, CAST({MODES} = 0 AS INTEGER) AS is_mouse FROM z WHERE pos > n - 100",
)
def seq_tensor_channels(t: Tables) -> DataFrame:
    rows = viewed(derived(steps(t))).where(F.col("pos") > F.col("n") - 100)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rounded(
        rows.select(
            "id", (F.col("pos") - F.greatest(F.col("n") - 100, F.lit(0).cast("long"))).alias("slot"), (F.col("x") / F.col("vw")).alias("nx"), (F.col("y") / F.col("vh")).alias("ny"), zero(F.col("dx") / F.col("vw")).alias("ndx"), zero(F.col("dy") / F.col("vh")).alias("ndy"),
            F.log1p(zero(F.col("dt"))).alias("log_dt"), zero(F.sin("angle")).alias("sin_angle"), zero(F.cos("angle")).alias("cos_angle"), zero(F.col("turn")).alias("turn"), zero(F.col("ax")).alias("ax"), zero(F.col("jx")).alias("jx"), flag(F.col("event_type").isin("click", "view")).alias("is_mouse"),
        ), "id", "slot", "is_mouse",
    )


L1 = [("x", ("mean", "std", "median", "q10", "q90")), ("y", ("mean", "std", "median", "q10", "q90")), ("step", ("mean", "std", "min", "max", "median")), ("dt", ("mean", "std", "min", "max")), ("speed", ("mean", "std", "min", "max"))]


@query("seq_summary_l1", per_user("count(*) AS n, " + ", ".join(sql_stats(c, c, *names) for c, names in L1) + f", {s6('avg(abs(turn))', 'turn_abs_mean')}"))
def seq_summary_l1(t: Tables) -> DataFrame:
    return rounded(steps(t).groupBy("id").agg(F.count("*").alias("n"), *(s for c, names in L1 for s in flat.stats(c, c, *names)), F.avg(F.abs("turn")).alias("turn_abs_mean")), "id", "n")


@query("seq_summary_l2", EVENTS + f", b AS (SELECT *, floor(t / 21600000) AS part FROM st) SELECT id, part, count(*) AS n, {s6('max(t) - min(t)', 'dur')}, {s6('sum(step)', 'path')}, {s6('max(x) - min(x)', 'x_range')}, {s6('avg(speed)', 'speed_mean')}, {s6('count(DISTINCT (x, y)) / count(*)', 'unique_ratio')} FROM b GROUP BY id, part")
def seq_summary_l2(t: Tables) -> DataFrame:
    rows = steps(t).withColumn("part", F.floor(F.col("t") / 21_600_000).cast("double"))
    return rounded(
        rows.groupBy("id", "part").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("dur"), F.sum("step").alias("path"), (F.max("x") - F.min("x")).alias("x_range"), F.avg("speed").alias("speed_mean"), (F.countDistinct(F.struct("x", "y")) / F.count("*")).alias("unique_ratio")),
        "id", "part", "n",
    )


@query(
    "seq_touch_consistency",
    EVENTS + f"SELECT id, count(DISTINCT y) AS y_unique, CAST(count(DISTINCT y) = 1 AS INTEGER) AS y_constant, {s6('avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END)', 'y_zero_share')}, {s6('avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END)', 'y_one_share')}, {s6('avg(x / y) FILTER (WHERE abs(y) > 1e-9)', 'ratio_mean')} FROM ev WHERE {MODES} = 1 GROUP BY id",
)
def seq_touch_consistency(t: Tables) -> DataFrame:
    rows = events(t).where(~F.col("event_type").isin("click", "view"))
    y = F.col("y")
    return rounded(rows.groupBy("id").agg(F.countDistinct("y").alias("y_unique"), flag(F.countDistinct("y") == 1).alias("y_constant"), flat.share(y == 0).alias("y_zero_share"), flat.share(y == 1).alias("y_one_share"), F.avg(F.when(F.abs(y) > 1e-9, F.col("x") / y)).alias("ratio_mean")), "id", "y_unique", "y_constant")


@query("sym_direction_bins", EVENTS + f"SELECT id, CAST(least(floor((((angle % (2*pi())) + 2*pi()) % (2*pi())) / (2*pi()/8)), 7) AS INTEGER) AS sector, count(*) AS n FROM st WHERE angle IS NOT NULL GROUP BY ALL")
def sym_direction_bins(t: Tables) -> DataFrame:
    return steps(t).where("angle is not null").groupBy("id", direction_bin(F.col("angle")).alias("sector")).agg(F.count("*").alias("n"))

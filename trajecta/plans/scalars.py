"""Session-scalar queries: projections, predicates, scalar functions, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.functions.exprs import binary_entropy, bucketize, clip, digitize, distance, flag, logarithm, logit, safe_div, safe_div_strict
from trajecta.operators import encode, flat, quality
from trajecta.plans.registry import EVENTS, Tables, events, query, steps
from trajecta.plans.registry import r6 as s6
from trajecta.plans.sequence import rounded

POINTERS = {"down": "click", "up": "purchase", "hover": "view"}


def sessions(t: Tables) -> DataFrame:
    """One row per user: pointer events are the first of a type, the viewport is the largest x and y."""
    kind = F.col("event_type")
    pointer = [flat.first_where(c, kind == v).alias(f"{k}_{c}") for k, v in POINTERS.items() for c in "txy"]
    mouse = kind.isin("click", "view")
    return events(t).groupBy("id").agg(
        *pointer, flat.first_where("t", kind == "signup").alias("init_t"), F.max("x").alias("vw"), F.max("y").alias("vh"), F.count_if(mouse).alias("mouse"), F.count_if(~mouse).alias("touch"),
        F.max_by("x", "pos").alias("last_x"), F.max_by("y", "pos").alias("last_y"), F.min_by("x", "pos").alias("first_x"), F.min_by("y", "pos").alias("first_y"),
    )


_pointer_sql = ", ".join(f"arg_min({c}, pos) FILTER (WHERE event_type = '{v}') AS {k}_{c}" for k, v in POINTERS.items() for c in "txy")
SESSIONS = EVENTS + f""", se AS (SELECT id, {_pointer_sql}, arg_min(t, pos) FILTER (WHERE event_type = 'signup') AS init_t, max(x) AS vw, max(y) AS vh,
  count(*) FILTER (WHERE event_type IN ('click', 'view')) AS mouse, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS touch,
  arg_max(x, pos) AS last_x, arg_max(y, pos) AS last_y, arg_min(x, pos) AS first_x, arg_min(y, pos) AS first_y FROM ev GROUP BY id)
"""


def sql_flag(condition: str, name: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INTEGER) AS {name}"


def sql_dist(x1, y1, x2, y2) -> str:
    return f"sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"


RAW = ["down_t", "down_x", "down_y", "up_t", "up_x", "up_y", "hover_t", "hover_x", "hover_y", "init_t", "vw", "vh"]


@query("proj_raw_numeric", SESSIONS + "SELECT id, mouse, touch, " + ", ".join(s6(c) for c in RAW) + " FROM se")
def proj_raw_numeric(t: Tables) -> DataFrame:
    return rounded(sessions(t).select("id", "mouse", "touch", *RAW), "id", "mouse", "touch")


TIMES = {"click_duration": ("up_t", "down_t"), "time_init_down": ("down_t", "init_t"), "time_init_up": ("up_t", "init_t"), "time_hover_down": ("down_t", "hover_t"), "time_hover_up": ("up_t", "hover_t"), "init_to_hover": ("hover_t", "init_t")}


@query("proj_timing", SESSIONS + "SELECT id, " + ", ".join(s6(f"{a} - {b}", k) for k, (a, b) in TIMES.items()) + " FROM se")
def proj_timing(t: Tables) -> DataFrame:
    return rounded(sessions(t).select("id", *((F.col(a) - F.col(b)).alias(k) for k, (a, b) in TIMES.items())), "id")


GEOMETRY = {"pointer_dist": ("down", "up"), "hover_down_dist": ("hover", "down"), "hover_up_dist": ("hover", "up"), "last_to_down": ("last", "down"), "last_to_up": ("last", "up"), "last_to_hover": ("last", "hover"), "first_to_hover": ("first", "hover")}


def far(a: str, b: str):
    return distance(*(F.col(f"{p}_{c}") for p in (a, b) for c in "xy"))


def sql_far(a: str, b: str) -> str:
    return sql_dist(*(f"{p}_{c}" for p in (a, b) for c in "xy"))


@query("proj_geometry", SESSIONS + f"SELECT id, {s6('up_x - down_x', 'pointer_dx')}, {s6('up_y - down_y', 'pointer_dy')}, " + ", ".join(s6(sql_far(*v), k) for k, v in GEOMETRY.items()) + f", {s6('CASE WHEN abs(up_t - down_t) > 1e-9 THEN 1e6 * ' + sql_far('down', 'up') + ' / (up_t - down_t) END', 'click_speed')} FROM se")
def proj_geometry(t: Tables) -> DataFrame:
    made = {k: far(*v) for k, v in GEOMETRY.items()}
    speed = safe_div_strict(made["pointer_dist"] * 1e6, F.col("up_t") - F.col("down_t"))
    return rounded(sessions(t).select("id", (F.col("up_x") - F.col("down_x")).alias("pointer_dx"), (F.col("up_y") - F.col("down_y")).alias("pointer_dy"), *(v.alias(k) for k, v in made.items()), speed.alias("click_speed")), "id")


@query("seq_endpoint_dist", SESSIONS + "SELECT id, " + ", ".join(s6(sql_far(a, b), f"{a}_to_{b}") for a in ("first", "last") for b in ("down", "up", "hover")) + " FROM se")
def seq_endpoint_dist(t: Tables) -> DataFrame:
    return rounded(sessions(t).select("id", *(far(a, b).alias(f"{a}_to_{b}") for a in ("first", "last") for b in ("down", "up", "hover"))), "id")


@query("pred_flags", SESSIONS + "SELECT id, " + ", ".join([sql_flag("hover_t = 0 AND hover_x = 0 AND hover_y = 0", "hover_zero"), sql_flag("vw <= 0 OR vh <= 0", "viewport_invalid"), sql_flag("vw > 0 AND vw <= 480", "mobile_like"), sql_flag("vw >= 485 AND vh >= 98", "desktop_like"), sql_flag("vw >= 488", "wide_screen"), s6("vw * vh", "viewport_area"), s6("CASE WHEN abs(vh) > 1e-9 THEN vw / vh END", "viewport_aspect")]) + " FROM se")
def pred_flags(t: Tables) -> DataFrame:
    c = F.col
    return rounded(
        sessions(t).select(
            "id", flag((c("hover_t") == 0) & (c("hover_x") == 0) & (c("hover_y") == 0)).alias("hover_zero"), flag((c("vw") <= 0) | (c("vh") <= 0)).alias("viewport_invalid"), flag((c("vw") > 0) & (c("vw") <= 480)).alias("mobile_like"),
            flag((c("vw") >= 485) & (c("vh") >= 98)).alias("desktop_like"), flag(c("vw") >= 488).alias("wide_screen"), (c("vw") * c("vh")).alias("viewport_area"), safe_div_strict(c("vw"), c("vh")).alias("viewport_aspect"),
        ), "id", "hover_zero", "viewport_invalid", "mobile_like", "desktop_like", "wide_screen",
    )


@query("proj_log1p", SESSIONS + "SELECT id, " + ", ".join(s6(f"ln(1 + greatest({c}, 0))", f"{c}_log") for c in ("vw", "vh", "mouse", "touch", "init_t")) + f", {s6('ln(1 + greatest(vw * vh, 0))', 'area_log')} FROM se")
def proj_log1p(t: Tables) -> DataFrame:
    log = lambda c: F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(0.0))))
    # DuckDB's greatest skips NULL, so the oracle gives ln(1) for a missing time; the engine keeps it missing
    return rounded(sessions(t).select("id", *(log(F.coalesce(F.col(c), F.lit(0.0))).alias(f"{c}_log") for c in ("vw", "vh", "mouse", "touch", "init_t")), log(F.col("vw") * F.col("vh")).alias("area_log")), "id")


NORMS = [(p, c, v) for p in POINTERS for c, v in (("x", "vw"), ("y", "vh"))]


@query("proj_norm", SESSIONS + "SELECT id, " + ", ".join(s6(f"CASE WHEN abs({v}) > 1e-9 THEN {p}_{c} / {v} END", f"{p}_{c}_norm") for p, c, v in NORMS) + " FROM se")
def proj_norm(t: Tables) -> DataFrame:
    return rounded(sessions(t).select("id", *(safe_div_strict(F.col(f"{p}_{c}"), F.col(v)).alias(f"{p}_{c}_norm") for p, c, v in NORMS)), "id")


@query("proj_to_center", SESSIONS + "SELECT id, " + ", ".join(s6(sql_dist("0.5", "0.5", f"{p}_x / greatest(vw, 1)", f"{p}_y / greatest(vh, 1)"), f"{p}_to_center") for p in POINTERS) + " FROM se")
def proj_to_center(t: Tables) -> DataFrame:
    size = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1.0)), F.lit(1.0))
    half = F.lit(0.5)
    return rounded(sessions(t).select("id", *(distance(half, half, F.col(f"{p}_x") / size("vw"), F.col(f"{p}_y") / size("vh")).alias(f"{p}_to_center") for p in POINTERS)), "id")


@query("pred_range_or", SESSIONS + "SELECT id, " + ", ".join(sql_flag(f"coalesce({p}_x < 100, false) OR coalesce({p}_y < 20, false) OR coalesce({p}_x > 0.8 * vw, false) OR coalesce({p}_y > 0.8 * vh, false)", f"{p}_outside") for p in POINTERS) + " FROM se")
def pred_range_or(t: Tables) -> DataFrame:
    c = F.col
    return sessions(t).select("id", *(F.greatest(flag(c(f"{p}_x") < 100), flag(c(f"{p}_y") < 20), flag(c(f"{p}_x") > 0.8 * c("vw")), flag(c(f"{p}_y") > 0.8 * c("vh"))).alias(f"{p}_outside") for p in POINTERS))


@query("agg_modality_share", SESSIONS + f"SELECT id, mouse + touch AS events_sum, {s6('(mouse + 1) / (touch + 1)', 'mouse_touch_ratio')}, {s6('CASE WHEN mouse + touch > 0 THEN mouse / (mouse + touch) END', 'mouse_share')}, {sql_flag('mouse > 0', 'has_mouse')}, {sql_flag('touch > 0', 'has_touch')}, {sql_flag('mouse > 0 AND touch = 0', 'only_mouse')}, {sql_flag('touch > 0 AND mouse = 0', 'only_touch')} FROM se")
def agg_modality_share(t: Tables) -> DataFrame:
    m, n = F.col("mouse"), F.col("touch")
    return rounded(
        sessions(t).select("id", (m + n).alias("events_sum"), ((m + 1) / (n + 1)).alias("mouse_touch_ratio"), safe_div(m.cast("double"), (m + n).cast("double")).alias("mouse_share"), flag(m > 0).alias("has_mouse"), flag(n > 0).alias("has_touch"), flag((m > 0) & (n == 0)).alias("only_mouse"), flag((n > 0) & (m == 0)).alias("only_touch")),
        "id", "events_sum", "has_mouse", "has_touch", "only_mouse", "only_touch",
    )


ORDERS = {"hover_before_init": "hover_t < init_t", "down_before_hover": "down_t < hover_t", "up_before_down": "up_t < down_t", "negative_click": "up_t - down_t < 0", "zero_click": "up_t - down_t = 0"}


@query("pred_event_order", SESSIONS + "SELECT id, " + ", ".join(sql_flag(v, k) for k, v in ORDERS.items()) + " FROM se")
def pred_event_order(t: Tables) -> DataFrame:
    return sessions(t).select("id", *(flag(F.expr(v)).alias(k) for k, v in ORDERS.items()))


GRAMMAR = {"both_modalities": "mouse > 0 AND touch > 0", "no_movement": "mouse + touch < 2", "pointer_but_no_mouse": "down_t IS NOT NULL AND mouse = 0", "mouse_without_pointer": "mouse > 0 AND down_t IS NULL", "touch_without_pointer": "touch > 0 AND down_t IS NULL"}


@query("pred_grammar", SESSIONS + "SELECT id, " + ", ".join(sql_flag(v, k) for k, v in GRAMMAR.items()) + " FROM se")
def pred_grammar(t: Tables) -> DataFrame:
    return sessions(t).select("id", *(flag(F.expr(v)).alias(k) for k, v in GRAMMAR.items()))


@query("proj_tiny_set", SESSIONS + f"SELECT id, {s6('vw')}, {s6('vh')}, mouse, touch, {s6('up_t - down_t', 'down_to_up_ms')}, {s6('CASE WHEN hover_t > 0 THEN down_t - hover_t END', 'hover_to_down_ms')}, {s6('down_x / vw', 'down_x_norm')}, {s6('down_y / vh', 'down_y_norm')} FROM se")
def proj_tiny_set(t: Tables) -> DataFrame:
    c = F.col
    return rounded(sessions(t).select("id", "vw", "vh", "mouse", "touch", (c("up_t") - c("down_t")).alias("down_to_up_ms"), F.when(c("hover_t") > 0, c("down_t") - c("hover_t")).alias("hover_to_down_ms"), (c("down_x") / c("vw")).alias("down_x_norm"), (c("down_y") / c("vh")).alias("down_y_norm")), "id", "mouse", "touch")


@query("math_safe_div", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {s6('CASE WHEN abs(l_discount) >= 0.05 THEN l_tax / l_discount END', 'inclusive')}, {s6('CASE WHEN abs(l_discount) > 0.05 THEN l_tax / l_discount END', 'strict')} FROM lineitem")
def math_safe_div(t: Tables) -> DataFrame:
    a, b = F.col("l_tax"), F.col("l_discount")
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", safe_div(a, b, 0.05).alias("inclusive"), safe_div_strict(a, b, 0.05).alias("strict")), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


MATH = {"log1p": "ln(1 + value)", "root": "sqrt(value)", "magnitude": "abs(value - 250)", "sine": "sin(value)", "cosine": "cos(value)", "angle": "atan2(value, 3)", "log": "ln(value)", "clipped": "least(greatest(value, 100), 300)", "expm1": "exp(value / 100) - 1"}


@query("math_scalar", "SELECT event_id, CAST(floor(value) AS BIGINT) AS whole, " + ", ".join(s6(v, k) for k, v in MATH.items()) + " FROM events")
def math_scalar(t: Tables) -> DataFrame:
    v = F.col("value")
    made = {"log1p": logarithm(F.log1p(v), v + 1), "root": F.sqrt(v), "magnitude": F.abs(v - 250), "sine": F.sin(v), "cosine": F.cos(v), "angle": F.atan2(v, F.lit(3.0)), "log": logarithm(F.log(v), v), "clipped": clip(v, 100.0, 300.0), "expm1": F.expm1(v / 100)}
    return rounded(t.events.select("event_id", F.floor(v).alias("whole"), *(c.alias(k) for k, c in made.items())), "event_id", "whole")


EDGES = [50.0, 100.0, 200.0, 400.0]


@query("sym_digitize", "SELECT event_id, " + ", ".join(f"CAST({' + '.join(f'CAST(round(value) {op} {e} AS INTEGER)' for e in EDGES)} AS INTEGER) AS {name}" for name, op in (("right_open", ">="), ("left_open", ">"))) + " FROM events")
def sym_digitize(t: Tables) -> DataFrame:
    v = F.round("value")
    return t.events.select("event_id", digitize(v, EDGES).alias("right_open"), bucketize(v, EDGES).alias("left_open"))


@query("calib_logit", f"SELECT event_id, {s6('ln(least(greatest(value / 500, 1e-6), 1 - 1e-6) / (1 - least(greatest(value / 500, 1e-6), 1 - 1e-6)))', 'logit')} FROM events")
def calib_logit(t: Tables) -> DataFrame:
    return rounded(t.events.select("event_id", logit(F.col("value") / 500).alias("logit")), "event_id")


@query("oof_label_entropy", f"WITH m AS (SELECT source, least(greatest(avg(toxic), 1e-6), 1 - 1e-6) AS p FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, {s6('-(p * ln(p) + (1 - p) * ln(1 - p))', 'entropy')} FROM m")
def oof_label_entropy(t: Tables) -> DataFrame:
    joined = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return rounded(joined.groupBy("source").agg(binary_entropy(F.avg("toxic")).alias("entropy")), "source")


@query("json_props_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("scan_events", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def scan_events(t: Tables) -> DataFrame:
    return t.events


@query("scan_projected", "SELECT toxic FROM labels")
def scan_projected(t: Tables) -> DataFrame:
    return t.labels.select("toxic")


@query("scan_rowcount", "SELECT count(*) AS n FROM lineitem")
def scan_rowcount(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("n"))


@query("filter_predicate", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value BETWEEN 100 AND 300")
def filter_predicate(t: Tables) -> DataFrame:
    return t.events.where((F.col("event_type") == "click") & F.col("value").between(100, 300)).select("event_id", "value")


@query("dq_output_checks", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT event_id) AS n_duplicate_ids, count(*) FILTER (WHERE value IS NULL) AS n_null, count(*) FILTER (WHERE value < 0 OR value > 400) AS n_out_of_range FROM events")
def dq_output_checks(t: Tables) -> DataFrame:
    return quality.output_checks(t.events, "event_id", "value", 0.0, 400.0)


@query("dq_quantization", f"SELECT event_type, {s6('avg(CASE WHEN value = floor(value) THEN 1.0 ELSE 0.0 END)', 'integer_share')}, {s6('avg(CASE WHEN 2 * value = floor(2 * value) THEN 1.0 ELSE 0.0 END)', 'half_share')}, count(DISTINCT round((value % 1) * 100)) AS n_fractions FROM events GROUP BY event_type")
def dq_quantization(t: Tables) -> DataFrame:
    return rounded(quality.quantization(t.events, "value", "event_type"), "event_type", "n_fractions")


PROFILED = ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"]


@query("prune_columns_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS n_values, CAST(count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) > 1 AND count({c}) > 0 AS INTEGER) AS usable FROM o" for c in [*PROFILED, "fixed"]).join(["WITH o AS (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS half, 1 AS fixed FROM orders) ", ""]))
def prune_columns_profile(t: Tables) -> DataFrame:
    return quality.profile(t.orders.withColumn("fixed", F.lit(1)), [*PROFILED, "fixed"])


NOISY = {"status": "o_orderstatus", "again": "o_orderstatus", "nearly": "CASE WHEN o_orderkey % 500 = 0 THEN 2 ELSE 1 END", "rare": "CASE WHEN o_orderkey % 50 = 0 THEN o_custkey END", "price": "o_totalprice"}


@query(
    "prune_noise",
    f"WITH o AS (SELECT {', '.join(f'{v} AS {k}' for k, v in NOISY.items())} FROM orders), c AS ({' UNION ALL '.join(f'SELECT {k!r} AS column_name, CAST({k} AS VARCHAR) AS v FROM o' for k in NOISY)}), g AS (SELECT column_name, v, count(*) AS c FROM c GROUP BY ALL), "
    + f"s AS (SELECT column_name, 1 - sum(c) FILTER (WHERE v IS NOT NULL) / sum(c) AS m, max(c) FILTER (WHERE v IS NOT NULL) / sum(c) FILTER (WHERE v IS NOT NULL) AS t FROM g GROUP BY column_name) SELECT column_name, {s6('m', 'missing_share')}, {s6('t', 'top_share')}, CASE WHEN column_name = 'again' THEN 'status' END AS twin, CAST(m > 0.95 OR t > 0.99 OR column_name = 'again' AS INTEGER) AS noisy FROM s",
)
def prune_noise(t: Tables) -> DataFrame:
    return rounded(quality.noise(t.orders.select(*(F.expr(v).alias(k) for k, v in NOISY.items())), list(NOISY)), "column_name", "twin", "noisy")


@query("filter_position", "SELECT event_id, user_id, value FROM events WHERE event_id >= 100 AND event_id < 900")
def filter_position(t: Tables) -> DataFrame:
    return encode.position_filter(t.events, 100, 900, "event_id").select("event_id", "user_id", "value")


@query("impute_median", f"WITH v AS (SELECT event_id, CASE WHEN value < 400 THEN value END AS v FROM events) SELECT event_id, {s6('coalesce(v, (SELECT median(v) FROM v))', 'v')} FROM v")
def impute_median(t: Tables) -> DataFrame:
    return rounded(quality.impute_median(t.events.select("event_id", F.when(F.col("value") < 400, F.col("value")).alias("v")), ["v"]), "event_id")


@query("standardize", f"SELECT event_id, {s6('(value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)', 'value')} FROM events")
def standardize(t: Tables) -> DataFrame:
    return rounded(quality.standardize(t.events.select("event_id", "value"), ["value"]), "event_id")


@query("shift_audit_psi", f"""WITH s AS (SELECT value AS v, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS b FROM events), k AS (SELECT quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM s WHERE b = 0),
n AS (SELECT len(list_filter(q, lambda e: v > e)) AS bin, count(*) FILTER (WHERE b = 0) AS n0, count(*) FILTER (WHERE b = 1) AS n1 FROM s, k GROUP BY 1), p AS (SELECT bin, n0 / (SELECT sum(n0) FROM n) AS p0, n1 / (SELECT sum(n1) FROM n) AS p1 FROM n)
SELECT {s6('sum((p1 - p0) * ln(greatest(p1, 1e-6) / greatest(p0, 1e-6)))', 'psi')}, {s6('max(ks)', 'ks')} FROM (SELECT *, abs(sum(p1 - p0) OVER (ORDER BY bin)) AS ks FROM p)""")
def shift_audit_psi(t: Tables) -> DataFrame:
    return rounded(quality.shift(t.events.where("event_id % 2 <> 0"), t.events.where("event_id % 2 = 0"), "value"))


@query("agg_global", f"SELECT count(*) AS n, {s6('avg(value)', 'mean')}, {s6('stddev_pop(value)', 'std')} FROM events")
def agg_global(t: Tables) -> DataFrame:
    return rounded(t.events.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), "n")


@query("agg_distinct", "SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT (user_id, round(value))) AS n_pairs FROM events GROUP BY event_type")
def agg_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("user_id", F.round("value")).alias("n_pairs"))


@query("agg_quantiles", f"SELECT l_returnflag, {s6('median(l_extendedprice)', 'median')}, {s6('quantile_cont(l_extendedprice, 0.1)', 'q10')}, {s6('quantile_cont(l_extendedprice, 0.9)', 'q90')} FROM lineitem GROUP BY l_returnflag")
def agg_quantiles(t: Tables) -> DataFrame:
    p = "l_extendedprice"
    return rounded(t.lineitem.groupBy("l_returnflag").agg(F.median(p).alias("median"), F.percentile(p, 0.1).alias("q10"), F.percentile(p, 0.9).alias("q90")), "l_returnflag")


@query("pseudo_label_select", "WITH p AS (SELECT event_id, value / 500 AS p FROM events) SELECT event_id, CAST(p > 0.95 AS INTEGER) AS label, 0.25 AS weight FROM p WHERE p > 0.95 OR p < 0.05".replace("0.25 AS weight", "CAST(0.25 AS DOUBLE) AS weight"))
def pseudo_label_select(t: Tables) -> DataFrame:
    return encode.pseudo_labels(t.events.select("event_id", (F.col("value") / 500).alias("p")), "p", 0.95, 0.05, 0.25).select("event_id", "label", "weight")


@query("feature_blocks_join", SESSIONS + f"SELECT id, se.mouse, {s6('a.path', 'path')}, coalesce(b.n_types, 0) AS n_types FROM se JOIN (SELECT id, sum(step) AS path FROM st GROUP BY id) a USING (id) LEFT JOIN (SELECT id, count(DISTINCT event_type) AS n_types FROM ev WHERE x > 250 GROUP BY id) b USING (id)")
def feature_blocks_join(t: Tables) -> DataFrame:
    moved = steps(t).groupBy("id").agg(F.sum("step").alias("path"))
    kinds = events(t).where("x > 250").groupBy("id").agg(F.countDistinct("event_type").alias("n_types"))
    return rounded(encode.join_blocks(sessions(t).select("id", "mouse"), moved, kinds).fillna(0, ["n_types"]), "id", "mouse", "n_types")


@query("date_bucket_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, " + s6("sum(o_totalprice)", "total", 2) + " FROM orders GROUP BY 1")
def date_bucket_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), (F.round(F.sum("o_totalprice"), 2) + F.lit(0.0)).alias("total"))



"""Trajectory operators on flat event tables: one row per event, windows over the trajectory's id.

All window columns share one partitioning and order, so a family of features costs one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajecta.functions.exprs import angle_of, number, wrap_angle


def order() -> WindowSpec:
    return Window.partitionBy("id").orderBy("pos")


def whole() -> WindowSpec:
    return Window.partitionBy("id")


def trajectory(df: DataFrame, id_col: str, ts_col: str, tie_col: str, x: Column, y: Column, *keep: str) -> DataFrame:
    """``id, pos, n, t`` (ms since the id's first event)``, x, y``; ``pos`` counts from 1 in order of time, then tie column."""
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    rows = df.select(F.col(id_col).alias("id"), micros.alias("us"), F.col(tie_col).alias("tie"), number(x).alias("x"), number(y).alias("y"), *keep)
    order = Window.partitionBy("id").orderBy("us", "tie")
    return rows.select(
        "id", F.row_number().over(order).cast("long").alias("pos"), F.count("*").over(whole()).alias("n"), ((F.col("us") - F.min("us").over(whole())) / 1000.0).cast("double").alias("t"), "x", "y", *keep
    )


def with_steps(df: DataFrame) -> DataFrame:
    """Adds first differences ``dx, dy, dt``, ``step``, ``speed`` (NULL where dt is 0), ``angle`` and ``turn``.

    A turn is between the angles of two steps of its row: a window after the angles would shuffle again."""
    lag = lambda c: F.lag(c).over(order())
    angle = lambda dx, dy: F.when(F.col(dx).isNotNull(), angle_of(F.col(dy), F.col(dx)))
    out = df.withColumns({"dx": F.col("x") - lag("x"), "dy": F.col("y") - lag("y"), "dt": F.col("t") - lag("t")})
    out = out.withColumns({"step": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "dx0": lag("dx"), "dy0": lag("dy")})
    out = out.withColumns({"angle": angle("dx", "dy"), "angle0": angle("dx0", "dy0")})
    return out.withColumns({"speed": F.when(F.abs("dt") > 1e-9, F.col("step") / F.col("dt")), "turn": wrap_angle(F.col("angle") - F.col("angle0"))}).drop("dx0", "dy0", "angle0")


def first_where(value: str, condition: Column) -> Column:
    """Aggregate: the value at the first position that the condition holds for."""
    return F.min_by(F.col(value), F.when(condition, F.col("pos")))


def stats(c: str, prefix: str, *names: str) -> list[Column]:
    """Aggregates of a column: mean, population std, min, max, median, q10, q90."""
    made = {
        "mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c), "max": F.max(c), "median": F.median(c),
        "q10": F.percentile(c, 0.1), "q90": F.percentile(c, 0.9), "sum": F.sum(c),
    }
    return [made[n].alias(f"{prefix}_{n}") for n in names]


def share(condition: Column, among: Column | None = None) -> Column:
    """Aggregate: the share of rows (of those where ``among`` isn't NULL) for which the condition holds."""
    value = F.coalesce(condition.cast("double"), F.lit(0.0))
    return F.avg(value if among is None else F.when(among.isNotNull(), value))


def path_geometry() -> list[Column]:
    """Aggregates after with_steps: path, displacement, straightness, tortuosity, duration."""
    path = F.sum("step")
    dx, dy = F.max_by("x", "pos") - F.min_by("x", "pos"), F.max_by("y", "pos") - F.min_by("y", "pos")
    displacement = F.sqrt(dx * dx + dy * dy)
    return [
        path.alias("path"), displacement.alias("displacement"), F.when(path > 1e-9, displacement / path).alias("straightness"),
        F.when(displacement >= 1e-9, path / displacement).alias("tortuosity"), (F.max_by("t", "pos") - F.min_by("t", "pos")).alias("duration"),
    ]


def resample(df: DataFrame, clock: str, points: int) -> DataFrame:
    """``id, k, rx, ry``: x and y interpolated at ``points`` even places of the clock column (time or running length).

    Each segment makes the grid points that fall into it, so there is no range join: a point belongs to the last
    segment that begins at or before it. Along a clock that stands still the positions are evenly spaced."""
    stands = F.max(clock).over(whole()) - F.min(clock).over(whole()) <= 1e-9
    df = df.withColumn(clock, F.when(stands, F.col("pos").cast("double")).otherwise(F.col(clock)))
    end = F.max(clock).over(whole())
    begin = F.min(clock).over(whole())
    seg = df.withColumns({"c0": F.col(clock), "c1": F.lead(clock).over(order()), "x1": F.lead("x").over(order()), "y1": F.lead("y").over(order()), "cb": begin, "ce": end})
    step = (F.col("ce") - F.col("cb")) / (points - 1)
    still = F.col("ce") - F.col("cb") <= 1e-12
    place = lambda c: F.ceil((c - F.col("cb")) / step - 1e-9).cast("int")
    last = F.col("c1").isNull()
    lo = F.when(still, F.lit(0)).otherwise(F.greatest(place(F.col("c0")), F.lit(0)))
    hi = F.when(last, F.lit(points - 1)).otherwise(F.least(place(F.col("c1")) - 1, F.lit(points - 1)))
    made = seg.where(F.when(still, last).otherwise(lo <= hi)).withColumn("k", F.explode(F.sequence(lo, hi)))
    share_of = F.when(last | (F.col("c1") <= F.col("c0")), F.lit(0.0)).otherwise((F.col("cb") + F.col("k") * step - F.col("c0")) / (F.col("c1") - F.col("c0")))
    at = lambda a, b: F.col(a) + share_of * F.coalesce(F.col(b) - F.col(a), F.lit(0.0))
    return made.select("id", "k", at("x", "x1").alias("rx"), at("y", "y1").alias("ry"))

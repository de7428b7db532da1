"""Queries over the driver's tables, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators import flat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when they are named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; ``sql`` may use the common table expressions of EVENTS."""

    def add(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def events(t: Tables) -> DataFrame:
    """Events as trajectories of users: x is the value, y the number in props."""
    return flat.trajectory(t.events, "user_id", "ts", "event_id", F.col("value"), F.get_json_object("props", "$.k"), "event_type")


def steps(t: Tables) -> DataFrame:
    return flat.with_steps(events(t))


EVENTS = """WITH e0 AS (
  SELECT user_id AS id, epoch_us(ts) AS us, event_id AS tie, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y, event_type FROM events
), ev AS (
  SELECT id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY id) AS n, (us - min(us) OVER (PARTITION BY id)) / 1000.0 AS t, x, y, event_type
  FROM e0 WINDOW w AS (PARTITION BY id ORDER BY us, tie)
), d0 AS (
  SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt FROM ev WINDOW w AS (PARTITION BY id ORDER BY pos)
), d1 AS (
  SELECT *, sqrt(dx * dx + dy * dy) AS step, CASE WHEN dx IS NOT NULL THEN atan2(dy, dx) END AS angle FROM d0
), st AS (
  SELECT *, CASE WHEN abs(dt) > 1e-9 THEN step / dt END AS speed,
    ((((angle - lag(angle) OVER w) + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi() AS turn
  FROM d1 WINDOW w AS (PARTITION BY id ORDER BY pos)
)
"""


def r6(sql: str, name: str | None = None, digits: int = 6) -> str:
    """The SQL twin of exprs.r6."""
    return f"round(CAST({sql} AS DOUBLE), {digits}) + 0.0 AS {name or sql}"

import math
import random

import pytest
from pyspark.sql import functions as F

from trajecta.llm import topk


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in ok if i % 50 == 0}):
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("wave", [2_000_000, 150])
def test_equals_brute_force(spark, wave, monkeypatch):
    monkeypatch.setattr(topk, "WAVE_NUMBERS", wave)
    rng = random.Random(4)
    base = [rng.gauss(0, 1) for _ in range(40)]
    rows = [(i, [rng.gauss(0, 1) + (b if i % 3 else 0) for b in base]) for i in range(900)]
    rows += [(i, base) for i in range(900, 1000)] + [(50, rows[50][1]), (951, base)]
    rows += [(2000, None), (2050, []), (2100, [1.0, None] * 20), (2150, [float("nan")] * 40), (2200, [float("inf")] * 40), (2250, [1.0, 2.0]), (2251, [0.5, -0.5]), (None, base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 1.0]), (2, [3e9, 2.0]), (3, [-1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    q = [256 * 3 * 10**9, 256]
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert got == [(0, 1, 1, clip(q[0] ** 2 + 256 * 256)), (0, 2, 2, clip(q[0] ** 2 + 256 * 512)), (0, 3, 3, -(2**63))]


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_one_wave_is_held_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE_NUMBERS", 100)
    live, most, given = set(), [], type(spark.sparkContext).broadcast

    def broadcast(context, value):
        made = given(context, value)
        live.add(id(made))
        most.append(len(live))
        destroy = made.destroy
        made.destroy = lambda *a: (live.discard(id(made)), destroy(*a))
        return made

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in range(400)], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 4 == 0, k=2).count() == 200
    assert len(most) > 5 and max(most) == 1 and not live

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trajecta.operators import encode, metrics, neighbours, quality, symbols


def test_target_encoding_fixture(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1)], "k string, y int")
    te = encode.fit_target_encoding(df, ["k"], "y")
    new = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "k string")
    got = {r.k: (round(r.te, 9), r.freq) for r in encode.apply_target_encoding(new, te, ["k"], 0.75).collect()}
    assert got == {"a": (0.8, 2), "b": (0.7, 2), "new": (0.75, 0), None: (0.75, 0)}


def test_out_of_fold_stats_never_see_the_row(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([*"abc", None]), rng.randrange(2), i % 3) for i in range(60)] + [(60, "once", 1, 0)]
    schema = "id long, k string, y int, fold int"
    flipped = [(i, k, 1 - y if i == 7 else y, f) for i, k, y, f in rows]
    a, b = ({r.id: r for r in encode.out_of_fold_stats(spark.createDataFrame(x, schema), "k", "y").collect()} for x in (rows, flipped))
    assert a[7].target_mean == b[7].target_mean and len(a) == len(rows)
    for i, k, _, f in rows:
        other = [y for _, k2, y, f2 in rows if k2 == k and f2 != f] or [y for _, _, y, f2 in rows if f2 != f]
        assert a[i].target_mean == pytest.approx(sum(other) / len(other)) and a[i].pos_count + a[i].neg_count == len(other)
    null = {r.id: r for r in encode.out_of_fold_stats(spark.createDataFrame(rows, schema), "k", "y", fallback="null").collect()}
    assert null[60].target_mean is None


def test_ranking_metrics(spark):
    rows = [("perfect", y, y + 0.0) for y in (0, 1) * 20] + [("constant", y, 0.5) for y in (0, 1) * 20] + [("reversed", y, 1.0 - y) for y in (0, 1) * 20] + [("one class", 1, 0.1)]
    df = spark.createDataFrame(rows, "m string, y int, s double")
    pauc = {r.m: r.pauc for r in metrics.partial_auc(df, "y", "s", 0.1, "m").collect()}
    auc = {r.m: r.auc for r in metrics.auc(df, "y", "s", "m").collect()}
    assert pauc["perfect"] == pytest.approx(1) and pauc["constant"] == pytest.approx(0.5) and pauc["reversed"] < 0.5 and pauc["one class"] is None
    assert auc == {"perfect": 1.0, "constant": 0.5, "reversed": 0.0, "one class": None}
    with pytest.raises(ValueError):
        metrics.weighted_mean({"a": 0.0})
    ranks = metrics.rank_percent(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "s double"), "s")
    assert sorted(r.rank_pct for r in ranks.collect()) == [0.25, 0.625, 0.625, 1.0]
    direct = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "s double").select(metrics.average_rank_percent(F.col("s")).alias("p"))
    assert sorted(r.p for r in direct.collect()) == [0.25, 0.625, 0.625, 1.0]


def test_lempel_ziv():
    def brute(s):
        i, n = 0, 0
        while i < len(s):
            k = 1
            while i + k <= len(s) and any(s[j : j + k] == s[i : i + k] for j in range(i)):
                k += 1
            n, i = n + 1, i + k
        return n

    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randrange(40)))
        assert symbols.lempel_ziv(s) == brute(s)
    assert symbols.lempel_ziv("a" * 30) == 2
    assert symbols.lempel_ziv([]) == 0 and symbols.lempel_ziv([7, None, 7]) == 3
    long = [rng.randrange(3) for _ in range(200_000)]  # beyond what a search of all earlier symbols can do
    assert symbols.lempel_ziv(long * 2) == symbols.lempel_ziv(long) + 1


def test_stratified_folds_deal_each_label_in_turn(spark):
    rows = [(i, i % 3 if i % 4 else None) for i in range(500)] + [(None, 1), (None, None), (7, 1), (7, 1)]
    df = spark.createDataFrame(rows, "id long, __n int").withColumnRenamed("__n", "y").withColumn("n", F.lit(0))
    got = encode.stratified_folds(df, "id", "y", 5, 3)
    assert got.columns == ["id", "y", "n", "fold"] and got.count() == len(rows)
    dealt = {}
    for r in got.collect():
        dealt.setdefault(r.y, []).append((r.id is not None, hashlib.md5(f"{r.id}:3".encode()).hexdigest() if r.id is not None else "", r.fold))
    for some in dealt.values():
        some.sort(key=lambda x: x[:2])
        ties = {}
        for place, (*key, fold) in enumerate(some):
            ties.setdefault(tuple(key), []).append((place % 5, fold))
        assert all(sorted(a for a, _ in x) == sorted(b for _, b in x) for x in ties.values())
    assert encode.stratified_folds(df.limit(0), "id", "y").collect() == []


def test_entropy_bounds(spark):
    df = spark.createDataFrame([(1, p, s) for p, s in enumerate("aabbccdd")] + [(2, p, "x") for p in range(5)], "id long, pos long, symbol string")
    got = {r.id: r for r in symbols.entropy_of(df, "id").collect()}
    assert got[1].normalised == pytest.approx(1) and (got[2].entropy, got[2].normalised) == (0.0, 0.0)


def test_nearest_with_duplicates_and_waves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WAVE_NUMBERS", 60)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 2) for i in range(50)] + [(100 + i, [0.5] * 4, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, label int")
    exact = {r.id: list(r.vector) for r in df.collect()}
    got = {}
    for r in neighbours.nearest(df, df, 3, same=True).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for i, v in exact.items():
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) ** 0.5, j) for j, w in exact.items() if j != i)
        assert [j for _, j in sorted(got[i])] == [j for _, j in order[:3]]


def test_quality(spark):
    df = spark.createDataFrame([(1, 1.0, None, 5.0), (2, None, None, 5.0), (3, 3.0, None, 5.0)], "id long, a double, b double, c double")
    assert quality.usable_columns(df, ["a", "b", "c"]) == ["a"]
    assert [r.a for r in quality.impute_median(df, ["a"]).orderBy("id").collect()] == [1.0, 2.0, 3.0]
    assert [r.c for r in quality.standardize(df, ["c"]).collect()] == [0.0] * 3
    assert quality.select_or_null(df, ["c", "zz"]).columns == ["c", "zz"]
    assert quality.shift(df.select("a"), df.select("a"), "a").first().psi == pytest.approx(0)

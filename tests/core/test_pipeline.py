import random

import pytest
from pyspark.sql import functions as F

from tests.core.test_sessions import SCHEMA, session
from trajecta import sources, streaming
from trajecta.plans import pipeline
from trajecta.schema import ingest, with_row_ids


def table(spark, n, seed, split):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        human = i % 2
        step = (lambda: rng.uniform(1, 9)) if human else (lambda: 5.0)
        points, x, y = [], 0.0, 0.0
        for k in range(rng.randrange(4, 15)):
            x, y = x + step(), y + step()
            points.append((50.0 * k, x, y))
        rows.append(session(i, points, None, viewport_width=rng.choice([400.0, 1200.0, None]), viewport_height=800.0, mouse_events_total=float(len(points)), touch_events_total=0.0, pointerdown_x=x, pointerdown_y=y))
    return ingest(spark.createDataFrame(rows, SCHEMA), split=split)


def test_train_and_predict(spark, tmp_path):
    train, test = table(spark, 60, 1, "train"), table(spark, 20, 2, "test")
    model = pipeline.train_and_predict(train, test, f"{tmp_path}/out", folds=2, models=["logit"], folder=f"{tmp_path}/cache")
    assert set(model.weights) == {"logit"} and model.scores["logit"]["auc"] > 0.8
    got = {r.id: r.probability for r in sources.read_submission(spark, f"{tmp_path}/out").collect()}
    assert sorted(got) == list(range(20)) and all(0.001 <= p <= 0.999 for p in got.values())
    assert sum((got[i] > 0.5) == bool(i % 2) for i in got) >= 15


def test_template_features(spark, tmp_path):
    splits = {"train": table(spark, 12, 1, "train"), "test": table(spark, 6, 2, "test").withColumn("id", F.col("id") + 100)}
    out = pipeline.template_features(splits, folds=3, folder=f"{tmp_path}/cache")
    rows = out.collect()
    assert len(rows) == 18 and len(out.columns) == 2 + 6 * (3 + 5)
    # rows without labels get the labelled split's statistics
    assert all(r.dir_hash_pos_count is not None and r.dir_hash_target_mean is not None for r in rows)
    assert all(r.dir_hash_count_all == r.dir_hash_count_train + r.dir_hash_count_test for r in rows)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id long, probability double")
    sources.write_submission(df, f"{tmp_path}/s")
    assert sorted(map(tuple, sources.read_submission(spark, f"{tmp_path}/s").collect())) == [(1, 0.5), (2, None)]
    sources.write_json(df, f"{tmp_path}/j")
    assert sources.read_json(spark, f"{tmp_path}/j", "id long, probability double").count() == 2
    sources.write_text(df, "probability", f"{tmp_path}/t")
    assert sorted(r.value for r in sources.read_text(spark, f"{tmp_path}/t").collect()) == ["", "0.5"]
    df.write.parquet(f"{tmp_path}/p")
    scan = spark.read.parquet(f"{tmp_path}/p")
    first = sources.cached(scan.where("id = 1"), f"{tmp_path}/c", {"k": 1})
    assert first.count() == 1 and first.inputFiles() == sources.cached(scan.where("id = 1"), f"{tmp_path}/c", {"k": 1}).inputFiles()
    assert first.inputFiles() != sources.cached(scan, f"{tmp_path}/c", {"k": 2}).inputFiles()
    assert sources.row_count(spark, f"{tmp_path}/p") == 2
    numbered = with_row_ids(spark.createDataFrame([("a",), ("b",)], "v string"))
    assert sorted(map(tuple, numbered.collect())) == [("a", 0), ("b", 1)]


def test_stream_dedup_and_sliding(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:01", 1.0), (2, "2024-01-01 00:07:00", 2.0)]
    spark.createDataFrame(rows, "event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streaming.event_stream(spark, f"{tmp_path}/in")
    once = streaming.run_to_end(streaming.deduplicated(stream, "event_id", "1 hour"), f"{tmp_path}/w", "append")
    assert sorted(r.event_id for r in once.collect()) == [1, 2]
    slid = streaming.run_to_end(streaming.sliding(stream, "10 minutes", "5 minutes", "1 hour"), f"{tmp_path}/w")
    assert sorted(r.n for r in slid.collect()) == [1, 2, 3]


def test_reduced(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), None if i == 4 else 1.0 * i) for i in range(9)], "id long, a double, b double, c double")
    out = pipeline.reduced(df, ["a", "b", "c"], k=2)
    assert out.columns == ["id", "pca_0", "pca_1"] and out.count() == 9
    with pytest.raises(Exception):
        pipeline.reduced(df, ["missing"])


def test_command_line_fits_saves_loads_and_predicts_in_batches(spark, tmp_path):
    from trajecta.__main__ import main

    table(spark, 60, 1, "train").drop("split").write.parquet(f"{tmp_path}/train")
    table(spark, 20, 2, "test").drop("split", "target").write.parquet(f"{tmp_path}/test")
    main(["fit", f"{tmp_path}/train", f"{tmp_path}/model", "--models", "logit", "--folds", "2"])
    main(["predict", f"{tmp_path}/model", f"{tmp_path}/test", f"{tmp_path}/out", "--batch", "7"])
    main(["predict", f"{tmp_path}/model", f"{tmp_path}/test", f"{tmp_path}/whole"])
    got, whole = ({r.id: r.probability for r in sources.read_submission(spark, f"{tmp_path}/{name}").collect()} for name in ("out", "whole"))
    assert sorted(got) == list(range(20)) and got == pytest.approx(whole)


def test_ensemble_and_cross_validation(spark):
    from pyspark.ml.classification import LogisticRegression

    rng = random.Random(3)
    rows = [(i, i % 2, (i // 2) % 3, i % 2 + rng.gauss(0, 0.6), rng.gauss(0, 1)) for i in range(120)]
    train = spark.createDataFrame(rows, "id long, target int, fold int, a double, b double")
    spec = LogisticRegression(labelCol="target", regParam=0.01)
    checked = pipeline.cross_validate(spec, train, ["a", "b"], 0.1)
    assert checked.out_of_fold.count() == 120 and len(checked.fold_scores) == 3 and checked.mean > 0.6
    assert checked.mean == pytest.approx(sum(checked.fold_scores) / 3)
    made = pipeline.train_ensemble(train, train.drop("target", "fold").limit(30), {"good": (spec, ["a"]), "bad": (spec, ["b"]), "out": (spec, ["a", "b"])}, ablate=("out",))
    assert set(made.weights) == {"good", "bad"} and sum(made.weights.values()) == pytest.approx(1) and made.weights["good"] > made.weights["bad"]
    assert made.scores["ensemble"]["pauc_01"] > made.scores["bad"]["pauc_01"] and made.predictions.count() == 30
    ranks = {r.id: r for r in made.out_of_fold.collect()}
    order = {m: sorted(getattr(r, m) for r in ranks.values()) for m in ("good", "bad")}
    one = ranks[5]
    assert one.ensemble == pytest.approx(sum(w * (order[m].index(getattr(one, m)) + 1) / 120 for m, w in made.weights.items()))
    fitted = pipeline.pseudo_label_rounds(train, train.select("id", "a", "b").withColumn("id", F.col("id") + 1000), spec, ["a", "b"], high=0.9, low=0.1)
    assert pipeline.scored(fitted, train, "p").where("(p > 0.5) = (target = 1)").count() > 80


def test_template_block_and_clusters(spark, tmp_path):
    from trajecta.operators import neighbours

    splits = {"train": table(spark, 24, 1, "train"), "test": table(spark, 8, 2, "test").withColumn("id", F.col("id") + 100)}
    out = pipeline.template_block(splits, folds=2, clusters=(3,), k=4, folder=f"{tmp_path}/cache")
    # with a column less a split in each: hashes 6 x 8, text 4, trajectories 4, neighbours 15, clusters 11
    assert len(out.columns) == 2 + 48 + 4 + 4 + 15 + 11
    rows = out.collect()
    assert len(rows) == 32 and all(r.cluster_3_size_all == r.cluster_3_size_train + r.cluster_3_size_test for r in rows)
    assert all(r.knn_dist_1 <= r.knn_dist_10_mean and r.knn_train_label_mean_3 is not None and r.cluster_3_target_mean is not None for r in rows)
    df = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(60)] + [(None, [1.0, 1.0]), (99, None), (98, [1.0])], "id long, vector array<double>")
    assert neighbours.fit_clusters(df.where("id < 90"), 4) == neighbours.fit_clusters(df.where("id < 90").repartition(1), 4)
    found = neighbours.nearest(df, df, 2, same=True).collect()
    assert {r.query_id for r in found} == set(range(60)) and all(r.id < 60 for r in found)


def test_waves_of_queries_give_the_same(spark, monkeypatch):
    from trajecta.operators import neighbours

    rng = random.Random(8)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(80)], "id long, vector array<double>")
    once = sorted(map(tuple, neighbours.nearest(df, df, 3, same=True).collect()))
    monkeypatch.setattr(neighbours, "WAVE_NUMBERS", 100)
    assert sorted(map(tuple, neighbours.nearest(df, df, 3, same=True).collect())) == once

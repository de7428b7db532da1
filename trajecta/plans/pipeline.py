"""Train and predict on session tables: features, target encodings, pruning, cross-validated models, blend, calibration, and
ensembles over feature families with the template block.

Feature tables are lazy; only fits, one-row summaries and the sink are actions. Folds are a column, and the
encodings of a fold are made from its training part alone, so a row never sees its own label.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators import encode, metrics, neighbours, quality, sessions, text
from trajecta.sources import cached, read_batches, work_folder, write_submission

#: Groups of columns whose combinations are target-encoded.
TE_GROUPS = {
    "vp": ["viewport_width", "viewport_height"],
    "counts": ["mouse_events_total", "touch_events_total"],
    "vp_counts": ["viewport_width", "viewport_height", "mouse_events_total", "touch_events_total"],
    "vp_hover": ["viewport_width", "viewport_height", "hover_zero"],
}
HASHES = ["dir_hash", "speed_hash", "turn_hash", "state_hash", "dir_speed_hash", "dir_turn_dt_hash"]
FOLDS, SEED, MAX_FPR = 5, 42, 0.1


@dataclass
class Encodings:
    rate: float
    groups: dict[str, DataFrame]


@dataclass
class Model:
    columns: list[str]
    encodings: Encodings
    fitted: dict
    weights: dict[str, float]
    calibration: tuple[float, float]
    scores: dict[str, dict[str, float]] = field(default_factory=dict)


def specifications(n: int, seed: int = SEED) -> dict:
    """Classifiers by name; the logistic regression's penalty is that of inverse strength 0.2 on n rows."""
    return {
        "logit": LogisticRegression(labelCol="target", regParam=1 / (0.2 * max(n, 1)), maxIter=200),
        "forest": RandomForestClassifier(labelCol="target", numTrees=100, maxDepth=8, seed=seed),
        "boosted": GBTClassifier(labelCol="target", maxIter=40, maxDepth=4, seed=seed),
    }


def fit_encodings(train: DataFrame, label: str = "target") -> Encodings:
    rate = train.agg(F.avg(label)).first()[0]
    return Encodings(rate or 0.0, {name: encode.fit_target_encoding(train, keys, label) for name, keys in TE_GROUPS.items()})


def encoded(df: DataFrame, encodings: Encodings) -> DataFrame:
    """Adds ``te_<group>`` and ``freq_<group>``."""
    for name, table in encodings.groups.items():
        df = encode.apply_target_encoding(df, table, TE_GROUPS[name], encodings.rate).withColumnsRenamed({"te": f"te_{name}", "freq": f"freq_{name}"})
    return df.withColumns({f"freq_{name}": F.col(f"freq_{name}").cast("double") for name in encodings.groups})


def assembler(columns: list[str]) -> list:
    """Median imputation, assembly and scaling."""
    filled = [f"filled_{c}" for c in columns]
    return [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def scored(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction", *(c for c in model.stages[0].getOutputCols()))


def fit(train_sessions: DataFrame, label: str = "target", folds: int = FOLDS, max_fpr: float = MAX_FPR, models: list[str] | None = None, folder: str | None = None) -> Model:
    """Trains on normalised sessions with a label. With ``folder`` the features are cached there by content."""
    features = sessions.competition_features(train_sessions).join(train_sessions.select("id", label), "id")
    # read once for each fold and model, so the features are computed once
    features = cached(features, folder or f"{work_folder(features.sparkSession)}/features", {"features": "competition"})
    train = encode.stratified_folds(features.withColumnRenamed(label, "target") if label != "target" else features, "id", "target", folds)
    base = [c for c in features.columns if c not in ("id", label)]
    columns = [*quality.usable_columns(train, base), *(f"{p}_{g}" for g in TE_GROUPS for p in ("te", "freq"))]
    specs = {k: v for k, v in specifications(train.count()).items() if models is None or k in models}
    # out-of-fold predictions
    parts = []
    for fold in range(folds):
        inner, outer = encode.fold_filter(train, fold, False), encode.fold_filter(train, fold, True)
        encodings = fit_encodings(inner)
        inner, outer = encoded(inner, encodings), encoded(outer, encodings)
        prepared = Pipeline(stages=assembler(columns)).fit(inner)
        given, asked = prepared.transform(inner), prepared.transform(outer)
        for name, spec in specs.items():
            asked = spec.fit(given).transform(asked).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        parts.append(asked.select("id", "target", "fold", *specs))
    out_of_fold = encode.reduce(lambda a, b: a.unionByName(b), parts).persist()
    scores = {}
    for name in specs:
        row = out_of_fold.agg(metrics.log_loss(F.col("target"), F.col(name)).alias("logloss"), metrics.brier(F.col("target"), F.col(name)).alias("brier")).first()
        scores[name] = {"logloss": row.logloss, "brier": row.brier, "auc": metrics.auc(out_of_fold, "target", name).first()[0], "pauc": metrics.partial_auc(out_of_fold, "target", name, max_fpr).first()[0]}
    weights = {name: 1 / s["logloss"] ** 2 for name, s in scores.items()}
    blend = out_of_fold.select("target", metrics.weighted_mean(weights).alias("p"))
    calibration = metrics.fit_calibration(blend, "target", "p")
    out_of_fold.unpersist()
    encodings = fit_encodings(train)
    whole = encoded(train, encodings)
    fitted = {name: Pipeline(stages=[*assembler(columns), spec]).fit(whole) for name, spec in specs.items()}
    return Model(columns, encodings, fitted, weights, calibration, scores)


def predict(model: Model, new_sessions: DataFrame) -> DataFrame:
    """``id, probability``, calibrated."""
    rows = encoded(sessions.competition_features(new_sessions), model.encodings)
    rows = quality.select_or_null(rows, ["id", *model.columns])
    for name, fitted in model.fitted.items():
        rows = scored(fitted, rows, name)
    return rows.select("id", metrics.calibrated(metrics.weighted_mean(model.weights), *model.calibration).alias("probability"))


def save(model: Model, folder: str) -> None:
    """Writes the model: settings as JSON, encodings as Parquet, fitted pipelines in their own format."""
    spark = SparkSession.getActiveSession()
    settings = {"columns": model.columns, "rate": model.encodings.rate, "weights": model.weights, "calibration": list(model.calibration), "scores": model.scores}
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings")
    for name, table in model.encodings.groups.items():
        table.write.mode("overwrite").parquet(f"{folder}/encodings/{name}")
    for name, fitted in model.fitted.items():
        fitted.write().overwrite().save(f"{folder}/models/{name}")


def load(spark: SparkSession, folder: str) -> Model:
    settings = json.loads("".join(r.value for r in spark.read.text(f"{folder}/settings").collect()))
    encodings = Encodings(settings["rate"], {name: spark.read.parquet(f"{folder}/encodings/{name}") for name in TE_GROUPS})
    fitted = {name: PipelineModel.load(f"{folder}/models/{name}") for name in settings["weights"]}
    return Model(settings["columns"], encodings, fitted, settings["weights"], tuple(settings["calibration"]), settings["scores"])


def predict_to_csv(model: Model, new_sessions: DataFrame, path: str, batch: int | None = None) -> None:
    """Writes ``id, probability`` as CSV, with ``batch`` so many consecutive ids at a time."""
    for k, part in enumerate(read_batches(new_sessions, batch) if batch else [new_sessions]):
        write_submission(predict(model, part), path, append=k > 0)


def train_and_predict(train: DataFrame, test: DataFrame, path: str, **options) -> Model:
    """Fits on one session table and writes the other one's predictions as CSV."""
    model = fit(train, **options)
    predict_to_csv(model, test, path)
    return model


@dataclass
class CrossValidated:
    out_of_fold: DataFrame  # id, target, fold, score
    fold_scores: list[float]
    mean: float
    std: float


def cross_validate(estimator, train: DataFrame, columns: list[str], max_fpr: float = 0.035) -> CrossValidated:
    """Out-of-fold scores of an estimator on (id, target, fold, columns) and the folds' partial areas, with mean and deviation.
    Any fold column will do: stratified, by group (``hashed_folds``) or repeated (call once a seed)."""
    folds = sorted(r.fold for r in train.select("fold").distinct().collect())
    parts = []
    for fold in folds:
        fitted = Pipeline(stages=[*assembler(columns), estimator]).fit(encode.fold_filter(train, fold, False))
        parts.append(scored(fitted, encode.fold_filter(train, fold, True), "score").select("id", "target", "fold", "score"))
    found = encode.reduce(lambda a, b: a.unionByName(b), parts)
    by_fold = {r.fold: r.pauc for r in metrics.partial_auc(found, "target", "score", max_fpr, "fold").collect()}
    scores = [by_fold[k] for k in folds]
    known = [x for x in scores if x is not None]
    mean = sum(known) / len(known) if known else float("nan")
    return CrossValidated(found, scores, mean, (sum((x - mean) ** 2 for x in known) / len(known)) ** 0.5 if known else float("nan"))


@dataclass
class Ensemble:
    weights: dict[str, float]
    scores: dict[str, dict[str, float]]  # by model, and "ensemble"
    out_of_fold: DataFrame  # id, target, a column a model, ensemble
    predictions: DataFrame  # id, a column a model, ensemble


def quality_scores(df: DataFrame, column: str) -> dict[str, float]:
    row = df.agg(metrics.log_loss(F.col("target"), F.col(column)).alias("logloss"), metrics.brier(F.col("target"), F.col(column)).alias("brier")).first()
    return {"pauc_01": metrics.partial_auc(df, "target", column, 0.1).first()[0], "pauc_0035": metrics.partial_auc(df, "target", column, 0.035).first()[0], **row.asDict()}


def train_ensemble(train: DataFrame, test: DataFrame, specs: dict[str, tuple], ablate: tuple[str, ...] = ()) -> Ensemble:
    """Models on feature families: ``specs`` has for each name an estimator and its columns, ``train`` (id, target, fold and all columns),
    ``test`` (id and all columns). Weights are in proportion to the out-of-fold partial areas; the ensemble is the weighted mean of
    ranks. Models named in ``ablate`` are scored but get no weight."""
    found, asked, scores = train.select("id", "target"), test.select("id"), {}
    for name, (estimator, columns) in specs.items():
        found = found.join(cross_validate(estimator, train, columns).out_of_fold.select("id", F.col("score").alias(name)), "id")
        fitted = Pipeline(stages=[*assembler(columns), estimator]).fit(train)
        asked = asked.join(scored(fitted, quality.select_or_null(test, ["id", *columns]), name).select("id", name), "id")
    folder = work_folder(train.sparkSession)
    found, asked = (cached(x, f"{folder}/ensemble", {"part": k, "models": sorted(specs)}) for k, x in enumerate((found, asked)))
    for name in specs:
        scores[name] = quality_scores(found, name)
    weights = metrics.partial_auc_weights({name: s["pauc_01"] for name, s in scores.items() if name not in ablate})
    found, asked = (x.join(metrics.rank_average(x, weights, "id", "ensemble"), "id") for x in (found, asked))
    return Ensemble(weights, scores | {"ensemble": quality_scores(found, "ensemble")}, found, asked)


def pseudo_label_rounds(train: DataFrame, unlabelled: DataFrame, estimator, columns: list[str], rounds: int = 2, high: float = 0.995, low: float = 0.005, weight: float = 0.25):
    """A pipeline fitted on the labelled rows (weight 1) and, in each round, on the rows of ``unlabelled`` that the last one was certain of."""
    spec = estimator.copy().setWeightCol("weight")
    own = train.select("id", "target", *columns).withColumn("weight", F.lit(1.0))
    fitted = Pipeline(stages=[*assembler(columns), spec]).fit(own)
    for _ in range(rounds):
        certain = encode.pseudo_labels(scored(fitted, unlabelled.select("id", *columns), "p"), "p", high, low, weight)
        fitted = Pipeline(stages=[*assembler(columns), spec]).fit(own.unionByName(certain.select("id", F.col("label").alias("target"), *columns, "weight")))
    return fitted


def template_features(splits: dict[str, DataFrame], label: str = "target", labelled: str = "train", folds: int = FOLDS, folder: str | None = None) -> DataFrame:
    """Template block of all splits (normalised sessions): per hash its counts by split and label statistics, out of fold on the
    labelled split. One name for every split: ``<hash>_count_*`` and ``<hash>_<statistic>``. With ``folder`` the hashes are
    cached there; without it each hash's block reads the sessions again."""
    rows = encode.union_splits(splits)
    made = sessions.artifacts(rows).select("id", *HASHES).join(rows.select("id", "split", F.col(label).alias("target")), "id")
    made = cached(made, folder, {"features": "template"}) if folder else made
    train = encode.stratified_folds(made.where(F.col("split") == labelled), "id", "target", folds)
    rest = made.where(F.col("split") != labelled).withColumn("fold", F.lit(-1))
    stats = ["pos_count", "neg_count", "target_mean", "target_std", "label_entropy"]
    everyone = train.unionByName(rest.select(*train.columns))
    out = everyone.select("id", "split")
    for h in HASHES:
        counts = encode.hash_counts(everyone, h, "split", list(splits))
        # rows without a label are in a fold of their own, so the other folds are the whole labelled split;
        # each block starts from the base table, so the plan grows by one block a hash
        block = encode.null_safe(encode.out_of_fold_stats(everyone.select("id", "fold", "target", h), h, "target"), counts, [h])
        out = out.join(block.select("id", *(F.col(c).alias(f"{h}_{c}") for c in [*(c for c in counts.columns if c != h), *stats])), "id")
    return out


def reduced(df: DataFrame, columns: list[str], k: int = 16, prefix: str = "pca") -> DataFrame:
    """``id`` and the k principal components of the imputed and scaled columns, as many as there are columns at most."""
    k = max(1, min(k, len(columns)))
    fitted = Pipeline(stages=[*assembler(columns), PCA(k=k, inputCol="features", outputCol="components")]).fit(df)
    parts = vector_to_array("components")
    return fitted.transform(df).select("id", *(parts[i].alias(f"{prefix}_{i}") for i in range(k)))


def text_block(made: DataFrame, k: int = 16, min_df: int = 3, most: int = 4000) -> DataFrame:
    """``id, text_svd_*``: symbol texts (id, symbol_text) in the space of their 2- to 4-grams' k largest singular values."""
    counts = text.term_counts(made.select("id", F.split("symbol_text", " ").alias("tokens")), "id", "tokens", 2, 4)
    counts = cached(counts, f"{work_folder(made.sparkSession)}/terms", {"ngrams": "2-4"})
    terms = text.vocabulary(counts, min_df, most)
    terms = cached(terms, f"{work_folder(made.sparkSession)}/terms", {"vocabulary": [min_df, most]})
    n = terms.count()
    ids = made.select("id")
    if not n:
        return ids
    reduced_text = text.svd(text.tfidf(counts, terms, made.count()), terms, k)
    # texts without a term of the vocabulary are the origin
    return ids.join(reduced_text, "id", "left").select("id", *(F.coalesce(F.get("reduced", F.lit(i)), F.lit(0.0)).alias(f"text_svd_{i}") for i in range(min(k, n))))


def template_block(splits: dict[str, DataFrame], label: str = "target", labelled: str = "train", folds: int = FOLDS, clusters: tuple[int, ...] = (50, 100), k: int = 16, folder: str | None = None) -> DataFrame:
    """``id, split`` and the whole template block of normalised sessions: hashes (9 columns each), text, trajectories, neighbours and
    clusters. Neighbours and clusters are in the space of the text's, the trajectories' and the competition features' components."""
    rows = encode.union_splits(splits)
    store = folder or f"{work_folder(rows.sparkSession)}/template"
    paths = [f"{a}_{c}" for a in ("time", "arc", "unit") for c in "xy"]
    made = cached(sessions.artifacts(rows).select("id", "symbol_text", *paths).join(rows.select("id", "split", F.col(label).alias("target")), "id"), store, {"features": "trajectories"})
    points = [f"{p}_{i}" for p in paths for i in range(32)]
    wide = made.select("id", *(F.get(p, F.lit(i)).alias(f"{p}_{i}") for p in paths for i in range(32)))
    manual = cached(sessions.competition_features(rows), store, {"features": "competition"})
    used = quality.usable_columns(manual, [c for c in manual.columns if c != "id"])
    parts = [text_block(made, k), reduced(wide, quality.usable_columns(wide, points), k, "traj_pca"), reduced(manual, used, k, "manual_pca")]
    space = encode.join_blocks(made.select("id", "split", "target"), *parts)
    components = [c for c in space.columns if c not in ("id", "split", "target")]
    train = encode.stratified_folds(space.where(F.col("split") == labelled), "id", "target", folds)
    rest = space.where(F.col("split") != labelled).withColumns({"fold": F.lit(-1), "target": F.lit(None).cast("int")})
    vectors = train.unionByName(rest.select(*train.columns)).select("id", "split", F.col("target").alias("label"), "fold", F.array(*components).alias("vector"))
    vectors = cached(vectors, store, {"features": "space"})
    n = vectors.count()
    blocks = [neighbours.knn_block(vectors, list(splits), folds)]
    blocks += [neighbours.cluster_block(vectors, neighbours.fit_clusters(vectors, min(c, n)), f"cluster_{c}", list(splits)) for c in clusters]
    hashes = template_features(splits, label, labelled, folds, folder)
    return encode.join_blocks(hashes, *parts[:2], *blocks)


def families(base: list[str], template: list[str]) -> dict[str, list[str]]:
    """Feature families: the manual columns, the template block, and both."""
    return {"manual": base, "template": template, "full": [*base, *template]}

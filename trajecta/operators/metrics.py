"""Ranking and probability metrics, ensembles and calibration as DataFrame aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.exprs import clip, logit


def roc_points(df: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """``keys, score, tp, fp, p, n``: running counts by falling score; equal scores are one point."""
    points = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("dp"), F.count_if(F.col(label) == 0).alias("dn"))
    if keys:
        falling, total = Window.partitionBy(*keys).orderBy(F.desc("score")), Window.partitionBy(*keys)
        return points.select(*keys, "score", F.sum("dp").over(falling).alias("tp"), F.sum("dn").over(falling).alias("fp"), "dp", "dn", F.sum("dp").over(total).alias("p"), F.sum("dn").over(total).alias("n"))
    # without keys, ranges of scores are summed first, so that no task ranks all of them; probabilities make a thousand ranges
    points = points.withColumn("range", F.floor(F.col("score") * 1000))
    ranges = points.groupBy("range").agg(F.sum("dp").alias("rp"), F.sum("dn").alias("rn"))
    above, everything = Window.partitionBy().orderBy(F.desc("range")), Window.partitionBy()
    ranges = ranges.select(F.col("range").alias("r"), *((F.sum(f"r{c}").over(above) - F.col(f"r{c}")).alias(f"before_{c}") for c in "pn"), F.sum("rp").over(everything).alias("p"), F.sum("rn").over(everything).alias("n"))
    falling = Window.partitionBy("range").orderBy(F.desc("score"))
    joined = points.join(ranges, F.col("range").eqNullSafe(F.col("r")))
    return joined.select("score", (F.col("before_p") + F.sum("dp").over(falling)).alias("tp"), (F.col("before_n") + F.sum("dn").over(falling)).alias("fp"), "dp", "dn", "p", "n")


def auc(df: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """``keys, auc``: area under the ROC curve; NULL with one class."""
    area = F.col("dn") * (F.col("tp") - F.col("dp") / 2)
    return roc_points(df, label, score, *keys).groupBy(*keys).agg(F.when((F.max("p") > 0) & (F.max("n") > 0), F.sum(area) / (F.max("p").cast("double") * F.max("n"))).alias("auc"))


def partial_auc(df: DataFrame, label: str, score: str, max_fpr: float, *keys: str) -> DataFrame:
    """``keys, pauc``: area up to a false-positive rate, standardised so that chance is 0.5 and a perfect ranking 1."""
    m = float(max_fpr)
    points = roc_points(df, label, score, *keys)
    x1, x0 = F.col("fp") / F.col("n"), (F.col("fp") - F.col("dn")) / F.col("n")
    y1, y0 = F.col("tp") / F.col("p"), (F.col("tp") - F.col("dp")) / F.col("p")
    # the segment's part left of m, its upper end interpolated
    end = F.least(x1, F.lit(m))
    y_end = F.when(x1 > x0, y0 + (y1 - y0) * (end - x0) / (x1 - x0)).otherwise(y1)
    part = F.when((F.col("p") > 0) & (F.col("n") > 0), F.when(x0 < m, (end - x0) * (y0 + y_end) / 2).otherwise(0.0))
    area = F.sum(part)
    low = m * m / 2
    return points.groupBy(*keys).agg((0.5 * (1 + (area - low) / (m - low))).alias("pauc"))


def log_loss(label: Column, p: Column, clip_at: float = 1e-6) -> Column:
    """Aggregate: mean negative log-likelihood."""
    q = clip(p, clip_at, 1 - clip_at)
    return F.avg(-(label * F.log(q) + (1 - label) * F.log(1 - q)))


def brier(label: Column, p: Column) -> Column:
    return F.avg((p - label) * (p - label))


def average_rank_percent(score: Column, *keys: str) -> Column:
    """Mean of tied ranks over the number of rows. Without keys all rows are ranked in one task; give a key such as the model or split."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ties = Window.partitionBy(*keys, score) if keys else Window.partitionBy(score)
    return (F.rank().over(by.orderBy(score)) + (F.count("*").over(ties) - 1) / 2.0) / F.count("*").over(by)


def rank_percent(df: DataFrame, score: str, *keys: str) -> DataFrame:
    """Adds ``rank_pct`` like average_rank_percent, from the counts of distinct scores, which are what is ranked."""
    counts = df.groupBy(*keys, F.col(score).alias("__s")).agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("c").over(by.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), "__s", ((below + (F.col("c") + 1) / 2.0) / F.sum("c").over(by)).alias("rank_pct"))
    on = df[score].eqNullSafe(ranks["__s"])
    for k in keys:
        on = on & df[k].eqNullSafe(ranks[f"__{k}"])
    return df.join(ranks, on).drop("__s", *(f"__{k}" for k in keys))


def inverse_square_weights(losses: DataFrame, loss: str) -> DataFrame:
    """Adds ``weight``, proportional to 1 / loss squared; one row per model."""
    w = 1 / (F.col(loss) * F.col(loss))
    return losses.withColumn("weight", w / F.sum(w).over(Window.partitionBy()))


def weighted_mean(scores: dict[str, float]) -> Column:
    """Blend of score columns; weights at or below 0 are skipped, and their sum must be positive."""
    used = {c: w for c, w in scores.items() if w > 0}
    if not used:
        raise ValueError("the weights' sum must be positive")
    return sum(F.col(c) * w for c, w in used.items()) / sum(used.values())


def rank_average(df: DataFrame, weights: dict[str, float], id_col: str = "id", name: str = "score") -> DataFrame:
    """``id`` and the weighted mean of the score columns' ranks (average of ties, as shares of the rows). Weights at or below 0 are
    skipped, and their sum must be positive."""
    used = {c: float(w) for c, w in weights.items() if w > 0}
    if not used:
        raise ValueError("the weights' sum must be positive")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("model"), F.lit(w).alias("weight"), F.col(c).cast("double").alias("value")) for c, w in used.items())))
    ranked = rank_percent(df.select(id_col, each.alias("m")).select(id_col, "m.*"), "value", "model")
    return ranked.groupBy(id_col).agg((F.sum(F.col("rank_pct") * F.col("weight")) / sum(used.values())).alias(name))


def partial_auc_weights(scores: dict[str, float], floor: float = 1e-6) -> dict[str, float]:
    """Weights in proportion to the models' partial areas, each at least ``floor``."""
    raw = {name: max(v, floor) for name, v in scores.items()}
    return {name: v / sum(raw.values()) for name, v in raw.items()}


def calibrated(p: Column, slope: float, intercept: float, share: float = 0.7, low: float = 0.001, high: float = 0.999) -> Column:
    """Platt scaling of the logit, blended with the raw probability and cut to the output range."""
    platt = 1 / (1 + F.exp(-(logit(p) * slope + intercept)))
    return clip(platt * share + p * (1 - share), low, high)


def fit_calibration(df: DataFrame, label: str, p: str) -> tuple[float, float]:
    """(slope, intercept) of a logistic regression on the logit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["z"], outputCol="features").transform(df.select(logit(F.col(p)).alias("z"), F.col(label).cast("double").alias("label")))
    model = LogisticRegression(maxIter=100).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)

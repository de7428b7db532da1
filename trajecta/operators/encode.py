"""Target encoding, out-of-fold label statistics, hash counts, folds, feature blocks.

Encodings are aggregates joined back on null-safe keys. Joins are left to the optimiser, which broadcasts a
side only by its measured size. Out-of-fold statistics subtract a fold's part from the total, so the table isn't scanned per fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.exprs import binary_entropy, flag

SMOOTHING = 8.0


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which missing keys match one another; the left side's keys stay."""
    renamed = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys))
    return left.join(renamed, on, how).drop(*(f"__{k}" for k in keys))


def fit_target_encoding(df: DataFrame, keys: list[str], label: str, smoothing: float = SMOOTHING) -> DataFrame:
    """``keys, te, freq``: (sum + rate * smoothing) / (count + smoothing), and the count."""
    rate = df.agg(F.avg(label).alias("rate"))
    sums = df.groupBy(*keys).agg(F.sum(label).alias("s"), F.count(label).alias("freq"))
    return sums.crossJoin(F.broadcast(rate)).select(*keys, ((F.col("s") + F.col("rate") * smoothing) / (F.col("freq") + smoothing)).alias("te"), "freq")


def apply_target_encoding(df: DataFrame, encoding: DataFrame, keys: list[str], rate: float | Column) -> DataFrame:
    """Adds ``te`` (the global rate for unseen keys) and ``freq`` (0 for them)."""
    fallback = rate if isinstance(rate, Column) else F.lit(rate)
    return null_safe(df, encoding, keys).withColumns({"te": F.coalesce("te", fallback), "freq": F.coalesce("freq", F.lit(0))})


def hash_counts(df: DataFrame, key: str, split: str, splits: list[str]) -> DataFrame:
    """``key, count_all`` and ``count_<split>``: how often a key occurs in each split."""
    return df.groupBy(key).agg(F.count("*").alias("count_all"), *(F.count_if(F.col(split) == s).alias(f"count_{s}") for s in splits))


def stratified_folds(df: DataFrame, id_col: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: rows of each label are dealt in turn, in the order of a hash of id and seed.

    Each label's rows meet in one task here, with two columns; use ``hashed_folds`` for tables beyond that."""
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary"))
    turn = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("fold", ((turn - 1) % folds).cast("int"))


def hashed_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` from a hash of the key alone, so that equal keys share a fold; no shuffle."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int"))


def position_filter(df: DataFrame, start: int, stop: int | None = None, id_col: str = "id") -> DataFrame:
    """Rows at positions ``start`` (from 0) up to but not including ``stop``; the id is the position, as ``with_row_ids`` numbers rows."""
    return df.where((F.col(id_col) >= start) & (F.lit(True) if stop is None else F.col(id_col) < stop))


def fold_filter(df: DataFrame, fold: int, held_out: bool) -> DataFrame:
    return df.where((F.col("fold") == fold) if held_out else (F.col("fold") != fold))


def label_stats(s: Column, n: Column, squares: Column) -> dict[str, Column]:
    """Positive and negative counts, mean, population deviation and binary entropy from three sums."""
    mean = F.when(n > 0, s / n)
    return {"pos_count": s, "neg_count": n - s, "target_mean": mean, "target_std": F.sqrt(F.greatest(squares / F.when(n > 0, n) - mean * mean, F.lit(0.0))), "label_entropy": binary_entropy(mean)}


def out_of_fold_stats(df: DataFrame, key: str, label: str, fold: str = "fold", fallback: str = "global_count") -> DataFrame:
    """Adds label statistics of the row's key over the other folds. A key unseen there gets, by ``fallback``, the other
    folds' overall statistics (``global_count``) or NULL (``null``)."""
    # a fold without labels adds nothing to the others, whose statistics its rows get
    summed = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    parts = df.groupBy(key, fold).agg(summed(label).alias("s"), F.count(label).cast("double").alias("n"), summed(F.col(label) * F.col(label)).alias("q"))
    by_key, everything, by_fold = Window.partitionBy(key), parts.agg(F.sum("s").alias("as"), F.sum("n").alias("an"), F.sum("q").alias("aq")), parts.groupBy(fold).agg(*(F.sum(c).alias(f"f{c}") for c in "snq"))
    rest = parts.withColumns({f"o{c}": F.sum(c).over(by_key) - F.col(c) for c in "snq"})
    rest = rest.join(F.broadcast(by_fold), fold).crossJoin(F.broadcast(everything))
    seen = F.col("on") > 0
    pick = lambda c: F.when(seen, F.col(f"o{c}")).otherwise(F.col(f"a{c}") - F.col(f"f{c}") if fallback == "global_count" else F.lit(None))
    stats = rest.select(key, fold, *(v.alias(k) for k, v in label_stats(pick("s"), pick("n"), pick("q")).items()))
    return null_safe(df, stats, [key, fold])


def join_blocks(first: DataFrame, *others: DataFrame, id_col: str = "id") -> DataFrame:
    """Feature blocks side by side by id; all are partitioned by id once."""
    return reduce(lambda a, b: a.join(b, id_col, "left"), others, first)


def pseudo_labels(df: DataFrame, p: str, high: float = 0.995, low: float = 0.005, weight: float = 0.25) -> DataFrame:
    """Rows that are certain enough, with ``label`` and ``weight``."""
    return df.where((F.col(p) > high) | (F.col(p) < low)).withColumns({"label": flag(F.col(p) > high), "weight": F.lit(weight)})


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Splits under one another, with a ``split`` column; columns that a split lacks are missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn("split", F.lit(name)) for name, d in splits.items()))

"""Data quality, column pruning, imputation, scaling and distribution shift; each one pass over its input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.exprs import flag
from trajecta.operators import flat


def output_checks(df: DataFrame, id_col: str, value_col: str, low: float, high: float) -> DataFrame:
    """One row of counts: rows, repeated ids, missing values, values out of range. All but the first should be 0."""
    v = F.col(value_col)
    return df.agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct(id_col)).alias("n_duplicate_ids"), F.count_if(v.isNull()).alias("n_null"), F.count_if((v < low) | (v > high)).alias("n_out_of_range")
    )


def quantization(df: DataFrame, value_col: str, *keys: str) -> DataFrame:
    """Shares of whole and half values, and the number of different fractions in hundredths."""
    v = F.col(value_col)
    return df.groupBy(*keys).agg(
        flat.share(v == F.floor(v)).alias("integer_share"), flat.share(2 * v == F.floor(2 * v)).alias("half_share"), F.countDistinct(F.round(F.pmod(v, F.lit(1.0)) * 100)).alias("n_fractions")
    )


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_null, n_values`` (a missing value counts as one) and ``usable``: not all missing, more than one value."""
    sums = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"k{i}") for i, c in enumerate(columns)), *(F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(columns)))
    item = lambda i, c: F.struct(F.lit(c).alias("column_name"), (F.col("n") - F.col(f"k{i}")).alias("n_null"), (F.col(f"d{i}") + flag(F.col("n") > F.col(f"k{i}"))).alias("n_values"), F.col(f"k{i}").alias("k"))
    rows = sums.select(F.inline(F.array(*(item(i, c) for i, c in enumerate(columns)))))
    return rows.select("column_name", "n_null", "n_values", flag((F.col("n_values") > 1) & (F.col("k") > 0)).alias("usable"))


def usable_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns worth keeping; one value per column goes to the driver."""
    kept = {r.column_name for r in profile(df, columns).where("usable = 1").collect()}
    return [c for c in columns if c in kept]


#: Parts of the names of reusable-layer columns that the final model does without.
PRUNED_NAMES = ("q10", "q90", "pause_", "hover_to_center")


def named_prune(columns: list[str], parts: tuple[str, ...] = PRUNED_NAMES) -> list[str]:
    """The columns whose names hold none of the parts."""
    return [c for c in columns if not any(p in c for p in parts)]


def noise(df: DataFrame, columns: list[str], most_missing: float = 0.95, most_common: float = 0.99) -> DataFrame:
    """``column_name, missing_share, top_share`` (of the most frequent value among those present), ``twin`` (the first column of equal
    values everywhere) and ``noisy``: mostly missing, near-constant or a duplicate. Values are counted per column, and columns
    are equal if two sums over hashes of their values with the rows' own hashes agree."""
    own = F.xxhash64(*columns)
    sums = df.withColumn("__own", own).agg(F.count("*").alias("n"), *(F.count(c).alias(f"k{i}") for i, c in enumerate(columns)), *(F.bit_xor(F.xxhash64("__own", F.col(c).cast("string"))).alias(f"h{i}") for i, c in enumerate(columns)))
    rows = sums.select(F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column_name"), F.col("n"), F.col(f"k{i}").alias("k"), F.col(f"h{i}").alias("h")) for i, c in enumerate(columns)))))
    values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*").where("v is not null")
    top = values.groupBy("column_name", "v").agg(F.count("*").alias("c")).groupBy("column_name").agg(F.max("c").alias("top"))
    # one row a column from here on
    first = F.first("column_name").over(Window.partitionBy("h").orderBy("place"))
    made = rows.withColumn("first", first).join(top, "column_name", "left").select(
        "column_name", (1 - F.col("k") / F.col("n")).alias("missing_share"), (F.col("top") / F.col("k")).alias("top_share"), F.when(F.col("first") != F.col("column_name"), F.col("first")).alias("twin")
    )
    return made.withColumn("noisy", flag((F.col("missing_share") > most_missing) | (F.col("top_share") > most_common) | F.col("twin").isNotNull()))


def select_or_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in this order; those that the table lacks are missing doubles."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column's median; the medians are one row, which is broadcast."""
    medians = df.agg(*(F.median(c).alias(f"median_{c}") for c in columns))
    joined = df.crossJoin(F.broadcast(medians))
    return joined.withColumns({c: F.coalesce(c, f"median_{c}") for c in columns}).drop(*(f"median_{c}" for c in columns))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with mean 0 and population standard deviation 1; constant columns become 0."""
    sums = df.agg(*(a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))))
    joined = df.crossJoin(F.broadcast(sums))
    scaled = {c: F.when(F.col(f"std_{c}") > 0, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return joined.withColumns(scaled).drop(*(x for c in columns for x in (f"mean_{c}", f"std_{c}")))


def shift(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``psi`` and ``ks`` between two samples of a column, over the first one's quantile bins."""
    edges = expected.agg(F.percentile(column, [k / bins for k in range(1, bins)]).alias("q"))
    both = expected.select(F.col(column).alias("v"), F.lit(0).alias("b")).unionByName(actual.select(F.col(column).alias("v"), F.lit(1).alias("b")))
    bin_of = reduce(lambda a, b: a + b, (flag(F.col("v") > F.col("q")[k]) for k in range(bins - 1)))
    counts = both.crossJoin(F.broadcast(edges)).groupBy(bin_of.alias("bin")).agg(F.count_if(F.col("b") == 0).alias("n0"), F.count_if(F.col("b") == 1).alias("n1"))
    # at most `bins` rows from here on
    everything, up_to = Window.partitionBy(), Window.partitionBy().orderBy("bin")
    p = counts.select("bin", (F.col("n0") / F.sum("n0").over(everything)).alias("p0"), (F.col("n1") / F.sum("n1").over(everything)).alias("p1"))
    d = F.col("p1") - F.col("p0")
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-6))
    return p.withColumn("ks", F.abs(F.sum(d).over(up_to))).agg(F.sum(d * F.log(floor("p1") / floor("p0"))).alias("psi"), F.max("ks").alias("ks"))

"""Symbolic dynamics of flat sequences (``id, pos, symbol``): entropies, transitions, runs, ordinal patterns, complexity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy_of(df: DataFrame, *keys: str) -> DataFrame:
    """``keys, entropy, normalised, unique_ratio`` of the symbols in each group: counts first, then one aggregate over them."""
    counts = df.groupBy(*keys, "symbol").agg(F.count("*").alias("c"))
    # with n rows: -sum(c/n ln(c/n)) = ln n - sum(c ln c) / n
    n, k = F.sum("c"), F.count("*")
    h = F.greatest(F.log(n) - F.sum(F.col("c") * F.log("c")) / n, F.lit(0.0))
    return counts.groupBy(*keys).agg(h.alias("entropy"), F.when(k > 1, h / F.log(k)).otherwise(0.0).alias("normalised"), (k / n).alias("unique_ratio"))


def transitions(df: DataFrame) -> DataFrame:
    """``id, entropy`` of the next symbol given the current one, ``unique_ratio`` and ``top_share`` of symbol pairs."""
    following = F.lead("symbol").over(Window.partitionBy("id").orderBy("pos"))
    pairs = df.withColumn("next", following).where("next is not null").groupBy("id", "symbol", "next").agg(F.count("*").alias("c"))
    by_symbol = Window.partitionBy("id", "symbol")
    pairs = pairs.withColumn("m", F.sum("c").over(by_symbol))
    n = F.sum("c")
    return pairs.groupBy("id").agg((F.sum(-F.col("c") * F.log(F.col("c") / F.col("m"))) / n + F.lit(0.0)).alias("entropy"), (F.count("*") / n).alias("unique_ratio"), (F.max("c") / n).alias("top_share"))


def runs(df: DataFrame) -> DataFrame:
    """``id, n_runs, longest, mean_length, ratio`` of runs of equal symbols."""
    order = Window.partitionBy("id").orderBy("pos")
    new = F.coalesce((F.col("symbol") != F.lag("symbol").over(order)).cast("int"), F.lit(1))
    sizes = df.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "run").agg(F.count("*").alias("c"))
    return sizes.groupBy("id").agg(F.count("*").alias("n_runs"), F.max("c").alias("longest"), F.avg("c").alias("mean_length"), (F.count("*") / F.sum("c")).alias("ratio"))


def ordinal_pattern(values: list[Column]) -> Column:
    """The order of consecutive values as text: for each, how many of the others precede it (ties by place)."""
    ranks = [sum(((w < v) if j > i else (w <= v)).cast("int") for j, w in enumerate(values) if j != i) for i, v in enumerate(values)]
    return F.concat(*(r.cast("string") for r in ranks))


def permutation_symbols(df: DataFrame, value: str, order: int) -> DataFrame:
    """``id, pos, symbol``: the ordinal pattern of each ``order`` consecutive values."""
    w = Window.partitionBy("id").orderBy("pos")
    lagged = [F.lag(value, order - 1 - k).over(w) if k < order - 1 else F.col(value) for k in range(order)]
    return df.select("id", "pos", ordinal_pattern(lagged).alias("symbol")).where("symbol is not null")


def thirds(df: DataFrame) -> DataFrame:
    """Adds ``third`` (1 to 3) by position."""
    n = F.count("*").over(Window.partitionBy("id"))
    return df.withColumn("third", F.ceil(3 * F.col("pos") / n).cast("int"))


def turn_category(turn: Column) -> Column:
    """left or right, sharp (beyond 60 degrees) or slight (beyond 15), or straight."""
    d = F.degrees(turn)
    return F.when(d > 60, "sharp_left").when(d > 15, "left").when(d >= -15, "straight").when(d >= -60, "right").when(d < -60, "sharp_right")


def lempel_ziv(symbols: Sequence) -> int:
    """Number of phrases of the 1976 parsing: each is the shortest that doesn't occur earlier (overlap allowed).

    A suffix automaton knows where each substring first ends, so time and memory are linear in the length."""
    follow: list[dict] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, symbol in enumerate(symbols):
        new, p = len(follow), last
        follow.append({}), link.append(0), size.append(size[last] + 1), first.append(i)
        while p >= 0 and symbol not in follow[p]:
            follow[p][symbol], p = new, link[p]
        if p >= 0:
            q = follow[p][symbol]
            if size[q] > size[p] + 1:  # q also holds longer substrings, which end in fewer places
                copy = len(follow)
                follow.append(dict(follow[q])), link.append(link[q]), size.append(size[p] + 1), first.append(first[q])
                link[q] = copy
                while p >= 0 and follow[p].get(symbol) == q:
                    follow[p][symbol], p = copy, link[p]
                q = copy
            link[new] = q
        last = new
    count, state, within = 0, 0, False
    for i, symbol in enumerate(symbols):
        count += not within
        state = follow[state][symbol]
        within = first[state] < i
        state = state if within else 0
    return count


def lz_complexity(df: DataFrame) -> DataFrame:
    """``id, n, complexity, normalised``. Parsing is sequential, so ordered sequences go through Arrow."""
    ordered = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("s"))
    text = ordered.select("id", F.transform("s", lambda e: e.symbol.cast("string")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes = [], []
            for symbols in batch.column("s").to_pylist():
                counts.append(lempel_ziv(symbols))
                sizes.append(len(symbols))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n", "complexity"])

    out = text.mapInArrow(run, "id long, n long, complexity long")
    return out.withColumn("normalised", F.when(F.col("n") > 1, F.col("complexity") * F.log2("n") / F.col("n")))

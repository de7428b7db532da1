"""Token n-grams, TF-IDF with sublinear term frequency, and a truncated SVD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngrams_of(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` tokens, joined by spaces."""

    def of(n: int) -> Column:
        places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def term_counts(df: DataFrame, id_col: str, tokens: str, low: int = 2, high: int = 4) -> DataFrame:
    """``id, term, tf``."""
    return df.select(F.col(id_col).alias("id"), F.explode(ngrams_of(F.col(tokens), low, high)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, min_df: int = 3, most: int = 4000) -> DataFrame:
    """``term, df, cf``: terms in at least ``min_df`` texts, the ``most`` frequent ones (ties by term)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(most)


def tfidf(counts: DataFrame, terms: DataFrame, n_texts: Column | int) -> DataFrame:
    """``id, term, weight``: (1 + ln tf) * (1 + ln((1 + n) / (1 + df))), rows of length 1."""
    n = F.lit(n_texts) if isinstance(n_texts, int) else n_texts
    w = (1 + F.log(F.col("tf").cast("double"))) * (1 + F.log((1 + n) / (1 + F.col("df"))))
    weighed = counts.join(terms, "term").select("id", "term", w.alias("w"))
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def svd(weights: DataFrame, terms: DataFrame, k: int = 16) -> DataFrame:
    """``id, reduced array<double>``: texts in the space of the k largest singular values. Signs are arbitrary."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    places = {r.term: i for i, r in enumerate(terms.select("term").orderBy("term").collect())}  # the vocabulary is bounded
    shared = weights.sparkSession.sparkContext.broadcast(places)
    rows = weights.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("w")).rdd.map(lambda r: (r.id, Vectors.sparse(len(shared.value), sorted((shared.value[x.term], x.weight) for x in r.w))))
    rows.cache()
    v = RowMatrix(rows.map(lambda r: r[1])).computeSVD(min(k, len(places)), computeU=False).V.toArray()
    wide = weights.sparkSession.sparkContext.broadcast(v)
    return rows.map(lambda r: (r[0], [float(x) for x in r[1].toArray() @ wide.value])).toDF("id long, reduced array<double>")

"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What ASCII characters count as: all but letters as spaces, or only white space and control characters.
LETTERS = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
VISIBLE = np.array([max(c, 32) if c != 127 else 32 for c in range(128)], np.uint32)


def ngrams(found: list[str], sizes: tuple[int, ...], bits: int, ascii_as: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every n-gram of the texts' characters, in lower case, padded with spaces."""
    data = [f" {t.lower()} ".encode("utf-32-le") for t in found]
    buf = np.frombuffer(b"".join(data), np.uint32)
    buf = np.where(buf < 128, ascii_as[np.minimum(buf, 127)], buf).astype(np.uint64) + np.uint64(1)
    text = np.repeat(np.arange(len(data)), [len(d) // 4 for d in data])
    gram, buckets, owners = buf, [], []
    for n in range(1, max(sizes) + 1):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x100000001B3) + buf[n - 1 :]
        if n in sizes:
            inside = text[: len(gram)] == text[n - 1 :]
            h = (gram[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64))
            owners.append(text[: len(gram)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def sample_per_class(df: DataFrame, label: str, per_class: int, id_col: str) -> DataFrame:
    """At most ``per_class`` rows of each label, in the order of a hash of the id; equal rows of (id, label)
    count once. Rows are thinned by the hash before the window, so no task gets a whole class."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    if not counts:
        return rows.limit(0)
    share = F.create_map(*(x for r in counts for x in (F.lit(r.label), F.lit(min(1.0, 3.0 * per_class / r.n)))))
    thinned = rows.withColumn("h", F.xxhash64("doc_id", F.lit("sample"))).where(F.pmod("h", F.lit(1_000_000)) < share[F.col("label")] * 1_000_000)
    order = Window.partitionBy("label").orderBy("h", "doc_id")
    return thinned.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_class).select("doc_id", "label")

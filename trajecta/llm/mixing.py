"""Mixing sources to target weights by temperature.

Weights are the sources' token shares raised to an exponent and normalised: 1 keeps the shares, 0 makes
all sources equal. The exponent is bisected until the mix meets a target entropy, or until the most
repeated source is repeated no more than a limit. Tokens are words separated by white space.

The weights are realised as budgeted block permutations. Each source's documents are dealt by a hash of
the id into blocks of about ``block_tokens`` tokens; each epoch passes through the blocks in an order of
its own, and through a block's documents in a hashed order. A source gets whole epochs and a part of one: blocks
in that epoch's order until the source's budget is met, and in the last block documents until it is met.
The default budget is the least that leaves no document out.

Tokens are counted in one pass over the texts, whose counts are written; all else works on the counts. The
exponent needs sums over sources, which are aggregated, a grid of exponents at a time; where a budget ends is found among
ranges of the blocks' order, then among the blocks of one range, then among the documents of one block, so no task
gets a source. Sources, however many, stay a table that documents are joined with. Texts are shuffled only if
that table is too large for the optimiser to broadcast.

Defined results: a null source is a source of its own; a null or blank text has no tokens; a source without
tokens is passed through once; repeated rows get the same result each, and rows that share an id are drawn together; rows
without an id are dealt by their text; an empty table gives an empty mix; a budget that no exponent can meet raises.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.llm.shared import materialise

MAX_REPEATS = 2.0
BLOCK_TOKENS = 200_000
SEED = 17
#: Parts that the exponent's interval is cut into at a time, and how many times: 60 halvings.
PARTS, TIMES = 16, 15
#: Leading bits of the blocks' order that make ranges.
RANGE_BITS = 10


@dataclass
class Plan:
    exponent: float
    budget: float
    weights: dict  # source -> share of the mix
    repeats: dict  # source -> passes through the source


#: exponents -> for each, the sum of the shares' powers and the entropy of the normalised powers
Moments = Callable[[list[float]], list[tuple[float, float]]]


def weights_at(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    powers = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = sum(powers.values())
    return {s: p / norm for s, p in powers.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisected(total: int, least: int, most: int, moments: Moments, max_repeats: float | None, target_entropy: float | None, budget: float | None) -> tuple[float, float, float]:
    """(exponent, sum of the shares' powers, budget), given the tokens of all sources, of the smallest and of the largest. With
    an entropy, the exponent whose weights have it (as near as exponents from 0 to 1 come); else the smallest
    exponent at which no source is repeated more than ``max_repeats`` times. At exponents up to 1 the smallest source is repeated most."""
    if target_entropy is None and max_repeats is None:
        raise ValueError("give max_repeats or target_entropy")
    if target_entropy is None and budget and budget > max_repeats * total * (1 + 1e-9):
        raise ValueError(f"{budget} tokens need more than {max_repeats} repeats of {total}")

    def enough(exponents: list[float]) -> list[bool]:
        if target_entropy is not None:
            return [e <= target_entropy for _, e in moments(exponents)]
        if budget:
            return [(least / total) ** (a - 1) / norm * budget / total <= max_repeats for a, (norm, _) in zip(exponents, moments(exponents), strict=True)]
        return [(most / least) ** (1 - a) <= max_repeats for a in exponents]

    low, high = 0.0, 1.0
    if enough([low])[0]:
        high = low
    for _ in range(TIMES if high else 0):
        grid = [low + (high - low) * k / PARTS for k in range(PARTS + 1)]
        first = next((k for k, met in enumerate(enough(grid[1:-1]), 1) if met), PARTS)
        low, high = grid[first - 1], grid[first]
    norm = moments([high])[0][0]
    return high, norm, budget or total * norm * (most / total) ** (1 - high)


def plan(tokens: dict, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: float | None = None) -> Plan:
    """The plan of given sources."""
    some = [n for n in tokens.values() if n]
    if not some:
        return Plan(1.0, 0.0, {s: 0.0 for s in tokens}, {s: 1.0 for s in tokens})
    total = sum(some)
    moments = lambda exponents: [(sum((n / total) ** a for n in some), entropy(weights_at(tokens, a))) for a in exponents]
    exponent, _, b = bisected(total, min(some), max(some), moments, max_repeats, target_entropy, budget)
    w = weights_at(tokens, exponent)
    return Plan(exponent, b, w, {s: w[s] * b / n if n else 1.0 for s, n in tokens.items()})


def planned(sources: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: float | None, block_tokens: int) -> DataFrame:
    """``s, n, weight, repeats, whole`` (epochs), ``part`` (tokens of a further one) and ``blocks`` of sources (s, n)."""
    total, least, most = sources.where("n > 0").agg(F.sum("n"), F.min("n"), F.max("n")).first()
    share = F.col("n") / F.lit(float(total or 1))

    def moments(exponents: list[float]) -> list[tuple[float, float]]:
        sums = [x for a in exponents for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.ln(share)))]
        row = sources.where("n > 0").agg(*(x.alias(f"m{k}") for k, x in enumerate(sums))).first()
        return [(norm, math.log(norm) - a * log / norm) for a, norm, log in zip(exponents, row[::2], row[1::2], strict=True)]

    exponent, norm, b = bisected(total, least, most, moments, max_repeats, target_entropy, budget) if total else (1.0, 1.0, 0.0)
    with_weight = sources.withColumn("weight", F.when(F.col("n") > 0, F.pow(share, F.lit(exponent)) / norm).otherwise(0.0))
    repeats = F.when(F.col("n") > 0, F.col("weight") * b / F.col("n")).otherwise(1.0)
    whole = F.floor(F.col("repeats") + 1e-9).cast("int")
    return with_weight.withColumn("repeats", repeats).withColumn("whole", whole).select(
        "s", "n", "weight", "repeats", "whole", (F.greatest(F.col("repeats") - F.col("whole"), F.lit(0.0)) * F.col("n")).alias("part"), F.greatest(F.ceil(F.col("n") / block_tokens), F.lit(1)).cast("long").alias("blocks")
    )


def token_count(text_col: str) -> F.Column:
    trimmed = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.translate(trimmed, " ", "")) + 1).cast("long")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
    budget: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per draw: ``doc_id, source, n_tokens, weight, epoch, block, position`` and the columns in ``keep``.
    In order of ``position`` (0 to 1) the sources are mixed evenly; a block of an epoch begins at a random place,
    and its documents follow over a block's length."""
    own = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), text_col)).otherwise(F.xxhash64(id_col))
    rest = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(0)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), token_count(text_col).alias("n_tokens"), own.alias("own"), rest.alias("rest"))
    counted = materialise(rows.drop("rest"), "mix-counts")
    rows = rows if keep else counted.withColumn("rest", rest)
    sources = materialise(counted.groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("n")), "mix-sources")
    sources = materialise(planned(sources, max_repeats, target_entropy, budget, block_tokens), "mix-plan")

    block = F.pmod(F.xxhash64("own", F.lit(seed)), F.col("blocks"))
    order = F.xxhash64(F.lit(seed), "whole", "block")
    place = F.xxhash64(F.lit(seed), "whole", "own")
    dealt = lambda r, with_plan: r.join(with_plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block)
    same_source = lambda name: F.col("s").eqNullSafe(F.col(name))

    def ahead(by: list[str], keys: tuple[str, ...] = ("s",)) -> F.Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # The last epoch of a source ends in one block: the first in that epoch's order with which the budget is met.
    blocks = dealt(counted, sources.drop("n")).where("part > 0").groupBy("s", "block", "whole", "part").agg(F.sum("n_tokens").alias("n")).withColumn("order", order)
    blocks = materialise(blocks.withColumn("range", F.shiftright("order", 64 - RANGE_BITS)), "mix-blocks")
    ends = blocks.groupBy("s", "range", "part").agg(F.sum("n").alias("n")).withColumn("before", ahead(["range"])).where("before < part and before + n >= part")
    ends = ends.select(F.col("s").alias("e"), F.col("range").alias("end_range"), F.col("before").alias("before_range"))
    ends = blocks.join(ends, same_source("e") & (F.col("range") == F.col("end_range"))).withColumn("before", F.col("before_range") + ahead(["order", "block"]))
    ends = materialise(ends.where("before < part and before + n >= part").select(F.col("s").alias("e"), F.col("block").alias("end_block"), F.col("order").alias("end_order"), "before"), "mix-ends")
    # Documents of these blocks, one block a source; equal rows stand and fall together.
    within_end = dealt(counted, sources.drop("n")).join(ends, same_source("e") & (F.col("block") == F.col("end_block"))).withColumn("place", place)
    grouped = within_end.groupBy("s", "place", "own", "part", "before").agg(F.sum("n_tokens").alias("n"))
    stops = grouped.withColumn("ahead", ahead(["place", "own"])).where("before + ahead < part").groupBy(F.col("s").alias("t")).agg(F.max("place").alias("stop"))
    limits = sources.drop("n").join(ends.drop("before"), same_source("e"), "left").join(stops, same_source("t"), "left").drop("e", "t")
    drawn = dealt(rows, materialise(limits, "mix-limits")).withColumn("order", order).withColumn("place", place)
    again = F.col("end_block").isNotNull() & (
        (F.col("order") < F.col("end_order")) | ((F.col("order") == F.col("end_order")) & (F.col("block") < F.col("end_block"))) | ((F.col("block") == F.col("end_block")) & (F.col("place") <= F.col("stop")))
    )
    passes = F.col("whole") + F.coalesce(again, F.lit(False)).cast("int")
    drawn = drawn.withColumn("epoch", F.explode(F.when(passes > 0, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))))
    unit = lambda c: F.pmod(c, F.lit(2**31)) / float(2**31)
    within = (unit(F.xxhash64(F.lit(seed), "epoch", "block")) * F.col("blocks") + unit(F.xxhash64(F.lit(seed), "epoch", "own"))) / (F.col("blocks") + 1)
    position = F.least((F.col("epoch") + within) / F.greatest("repeats", F.col("epoch") + within, F.lit(1e-12)), F.lit(1.0))
    return drawn.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", position.alias("position"), *(F.col(f"rest.`{c}`").alias(c) for c in keep if c not in ("doc_id", "source", "n_tokens")))

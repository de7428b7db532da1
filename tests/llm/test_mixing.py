import math
import random
from collections import Counter, defaultdict

import pytest

from trajecta.llm import mixing


def table(spark, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["hot"] * 12 + ["b", "c", "d", None]), i) for i in range(1500)]
    rows += [(None, " ".join(["w"] * rng.randrange(1, 40) + [str(k)]), "hot", k) for k in range(100)]
    rows += [(5000, None, "empty", 0), (5001, "  \n ", "empty", 0), rows[7]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, weight int").repartition(3)


def test_plan_meets_its_targets():
    tokens = {"a": 900, "b": 90, "c": 10, "none": 0}
    p = mixing.plan(tokens, max_repeats=3)
    assert math.isclose(max(p.repeats.values()), 3, rel_tol=1e-6) and math.isclose(min(p.repeats[s] for s in "abc"), 1)
    assert math.isclose(sum(p.weights.values()), 1)
    # closed form of the exponent: (900 / 10) ** (1 - exponent) = 3
    assert math.isclose(p.exponent, 1 - math.log(3) / math.log(90), rel_tol=1e-6)
    e = mixing.plan(tokens, target_entropy=0.8)
    assert math.isclose(mixing.entropy(e.weights), 0.8, rel_tol=1e-6)
    assert mixing.plan(tokens, max_repeats=1e9).exponent == 0
    assert mixing.plan({"a": 5}).repeats == {"a": 1.0} and mixing.plan({"a": 0}).repeats == {"a": 1.0} and mixing.plan({}).repeats == {}


@pytest.mark.parametrize("options", [{}, {"max_repeats": 2.7}, {"budget": 6000.0, "target_entropy": 1.2}])
def test_mix_realises_the_plan(spark, options):
    rows, df = table(spark)
    got = mixing.mix(df, block_tokens=300, **options).collect()
    count = lambda t: len((t or "").split())
    tokens = defaultdict(int)
    for _, t, s, _ in rows:
        tokens[s] += count(t)
    p = mixing.plan(dict(tokens), **options)
    drawn, draws = defaultdict(int), Counter()
    for r in got:
        drawn[r.source] += r.n_tokens
        draws[r.doc_id] += r.doc_id is not None
        assert 0 <= r.position <= 1 and math.isclose(r.weight, p.weights[r.source], rel_tol=1e-9, abs_tol=1e-12)
    largest = max(count(t) for _, t, _, _ in rows)
    for s, n in tokens.items():
        if n:
            assert 0 <= drawn[s] - p.weights[s] * p.budget <= 2 * largest, s
    for i, _, s, _ in (r for r in rows if r[0] is not None):
        times = draws[i] / (2 if i == rows[7][0] else 1)
        assert times in (math.floor(p.repeats[s] + 1e-9), math.floor(p.repeats[s] + 1e-9) + 1)
    if not options.get("budget"):
        assert set(draws) - {None} == {r[0] for r in rows} - {None}
    # each pass holds a document once
    assert max(Counter((r.doc_id, r.epoch) for r in got if r.doc_id not in (None, rows[7][0])).values()) == 1


def test_positions_and_rows_without_ids(spark):
    """A block's documents lie within a block's length, sources are spread evenly, and rows without an id over many blocks."""
    _, df = table(spark)
    got = mixing.mix(df, block_tokens=300).collect()
    n_blocks = {s: len({r.block for r in got if r.source == s}) for s in ("hot", "b", None)}
    for s in n_blocks:
        rows = [r for r in got if r.source == s and r.epoch == 0]
        repeats = max(x.epoch for x in got if x.source == s) + 1
        spans = defaultdict(list)
        for r in rows:
            spans[r.block].append(r.position)
        # block numbers are below the source's number of blocks, so its length is at most 1 / (blocks + 1) of a pass
        assert all(max(x) - min(x) <= 1 / (max(spans) + 1) for x in spans.values()), repeats
    hot = sorted(r.position for r in got if r.source == "hot")
    assert all(abs(x - (k + 0.5) / len(hot)) < 0.2 for k, x in enumerate(hot))
    assert len({r.block for r in got if r.doc_id is None}) > 10


def test_budget_that_cannot_be_met_raises():
    with pytest.raises(ValueError):
        mixing.plan({"a": 400, "b": 600}, max_repeats=1.0, budget=5000)


def test_partial_epoch_follows_the_block_order(spark):
    _, df = table(spark, 2)
    got = [r for r in mixing.mix(df, block_tokens=300).collect() if r.source == "b"]
    last = [r for r in got if r.epoch == max(x.epoch for x in got)]
    whole, blocks = {b for b in {r.block for r in got}}, Counter(r.block for r in last)
    first = Counter(r.block for r in got if r.epoch == 0)
    assert sum(0 < blocks[b] < first[b] for b in whole) <= 1


def test_empty_table_and_kept_columns(spark):
    _, df = table(spark)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, keep=("text",)).where("text is not null").count() > 1000

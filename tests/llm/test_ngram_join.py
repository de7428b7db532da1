import random

import pytest

from trajecta.llm import ngram_join


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs: list[tuple]) -> dict:
    """Row number -> (class id, links, copies)."""
    sets = [shingles(t) for _, t in docs]
    linked = lambda a, b: a == b or (a and b and len(a & b) >= 0.8 * len(a | b))
    links = [[j for j in range(len(docs)) if j != i and linked(sets[i], sets[j])] for i in range(len(docs))]
    key = lambda x: -(2**63) if x is None else x
    out, root = {}, list(range(len(docs)))
    for i in range(len(docs)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min((docs[j][0] for j in seen), key=key)
        out[i] = (root[i], len(links[i]), sum(s == sets[i] for s in sets))
    return out


def corpus() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = [f"w{k}é" for k in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs: list = [None, "", "  \n", "One two", "one TWO", "a b c d e", "a b c d e f"]
    boiler = fresh(30)
    for size in (2, 3, 12, 25):
        base = fresh(120)
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append(" ".join(words))
        docs.append(docs[-1].upper())
    docs += [" ".join(boiler + fresh(rng.randrange(5, 40))) for _ in range(30)]
    rng.shuffle(docs)
    ids: list = list(range(10, 10 + len(docs)))
    ids[3] = None
    return [*zip(ids, docs, strict=True), (ids[8], docs[8])]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, small, monkeypatch):
    if small:  # large buckets are split, and leaves are compared in blocks
        monkeypatch.setattr(ngram_join, "LEAF_SETS", 4)
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    docs = corpus()
    recall = 0.99999 if small else ngram_join.RECALL
    df = spark.createDataFrame([(i, t, b"x") for i, t in docs], "doc_id long, text string, gid binary").repartition(3)
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(df, recall=recall).collect()), key=str)
    want = sorted(((docs[i][0], *v) for i, v in brute(docs).items()), key=str)
    assert got == want


def thue_morse(flip: int) -> str:
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(1024))


def test_different_texts_stay_apart(spark):
    """Texts that narrow or polynomial hashes take for one another."""
    texts = ["item number 345508", "item number 820832", thue_morse(0), thue_morse(1), *(f"{w} {thue_morse(k)} {w} {w} {w}" for w in ("x", "yy") for k in (0, 1))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_copies) for r in ngram_join.join(df).collect()) == [(k, k, 1) for k in range(len(texts))]
    assert ngram_join.representatives(df).count() == len(texts)


def test_recall_as_shipped(spark):
    """Links of groups around the threshold, at the shipped recall and threshold, against brute force."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for _ in range(400):
        base = fresh(100)
        for _ in range(2):
            words = list(base)
            # two changed words lose at most ten of 96 shingles: similarity 0.81 or more
            for k in rng.sample(range(100), rng.choice([0, 1, 1])):
                words[k] = fresh(1)[0]
            docs.append(" ".join(words))
    want = sum(v[1] for v in brute([(k, t) for k, t in enumerate(docs)]).values())
    got = ngram_join.join(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).agg({"n_links": "sum"}).first()[0]
    assert 0.999 * want <= got <= want


def test_ids_that_are_null_or_shared(spark):
    base = [" ".join(f"{c}{k}" for k in range(40)) for c in "pqrs"]
    rows = [(None, base[0]), (None, base[1]), (None, base[0]), (5, base[2]), (5, base[3]), (1, base[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(df).collect()), key=str)
    assert got == sorted([(None, None, 1, 2), (None, None, 1, 2), (None, None, 0, 1), (5, 1, 1, 2), (1, 1, 1, 2), (5, 5, 0, 1)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.representatives(df).collect()), key=str)
    assert kept == sorted([(None, base[0]), (None, base[1]), (1, base[2]), (5, base[3])], key=str)


def test_odd_inputs(spark):
    """Bytes that aren't UTF-8, a very long text, and an id that isn't a number."""
    rows = spark.createDataFrame([(1, b"a\xff b c"), (2, b"a\xff  B c"), (3, " ".join(map(str, range(300_000))).encode())], "doc_id int, raw binary")
    got = ngram_join.join(rows.selectExpr("doc_id", "cast(raw as string) as text")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_copies) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    with pytest.raises(TypeError):
        ngram_join.join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 99}


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import random
import zlib

from trajecta.llm import language, toxicity

WORDS = {"aa": ["the", "ing", "tion", "with"], "bb": ["der", "schön", "keit", "ung"], "cc": ["les", "été", "eaux", "que"]}


def docs():
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40)))
        rows.append((i, text, lang if i % 5 else None, lang))
    return rows


def test_language_of_held_out_texts(spark):
    rows = docs()
    extra = [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 -- 3", "bb", None), (None, "the tion", None, None), (3, rows[3][1], rows[3][2], rows[3][3])]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string").repartition(3)
    got = language.identify(df, per_language=40, landmarks=30).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in got}
    for i, _, _, lang in rows:
        assert by_id[i].lang_pred == lang and 0 <= by_id[i].score <= 1
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[None].lang_pred == "aa" and by_id[None].held_out is False


def test_ngrams_are_of_characters():
    """As many as the padded text has; digits and marks count where they are asked for."""
    from trajecta.llm.features import LETTERS, VISIBLE, ngrams

    for text in ("", "x", "été 漢字", "a1!\tb"):
        size = len(text) + 2
        bucket, owner = ngrams([text], (2, 3), 30, VISIBLE)
        assert len(bucket) == len(owner) == sum(max(0, size - n + 1) for n in (2, 3))
    same = lambda a, b, table: ngrams([a], (2, 3), 30, table)[0].tolist() == ngrams([b], (2, 3), 30, table)[0].tolist()
    assert same("A1!b", "a  b", LETTERS) and not same("a1!b", "a  b", VISIBLE) and same("a\tb", "A b", VISIBLE)
    assert not same("é", "è", LETTERS)


def test_label_column_of_any_name(spark):
    rows = [(i, t, lang) for i, t, _, lang in docs()]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = language.identify(df, label_col="label", per_language=40, landmarks=30).collect()
    assert all(r.lang_pred == lang for r, (_, _, lang) in zip(sorted(got), sorted(rows), strict=True))


def test_kernel_weights_equal_landmark_sums():
    import numpy as np

    found = ["the tion with", "der schön ung", "thing with the", "keit der"]
    bits = [np.packbits(language.presence([t], (2, 3))[0]).tobytes() for t in found]
    names, weights = language.train(bits, ["a", "b", "a", "b"], 4, 1e-3)
    sets = [set(np.flatnonzero(language.presence([t], (2, 3))[0])) for t in found]
    kernel = np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in sets] for x in sets])
    # all texts are landmarks: ridge regression in their space is weighted kernel ridge regression
    target = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0]])
    dual = np.linalg.solve(kernel + 2e-3 * np.eye(4), target)
    direct = np.array([[sum(weights[b, k] for b in s) / len(s) ** 0.5 for k in range(2)] for s in sets])
    assert names == ["a", "b"] and np.allclose(direct, kernel @ dual, atol=1e-3)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language.identify(df).collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.classify(df, labels).collect()] == [0.5]
    assert toxicity.classify(df.limit(0), labels).count() == 0


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS["aa"]) + rng.choice(WORDS["bb"]) for _ in range(rng.randrange(3, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilexq", "grubzo"]) + rng.choice(["", "ing"]))
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(toxic)))
    rows += [(900, None, 1), (901, "", 1)]
    labels += [(2, None), (5000, 1), (1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    got = {r.doc_id: r for r in toxicity.classify(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    wrong = [i for i in range(400) if got[i].predicted != int(i % 4 == 0)]
    assert len(wrong) <= 4 and got[900].score == got[901].score < 0.5
    assert got[0].held_out == (zlib.crc32(b"0") % 5 == 0)


def test_toxicity_counts_all_labelled_texts(spark):
    import numpy as np

    rng = random.Random(3)
    rows, labels, rare = [], [], []
    for i in range(1600):
        words = [rng.choice(WORDS["aa"]) + rng.choice(WORDS["bb"]) for _ in range(rng.randrange(3, 12))]
        toxic = i % 2 == 0
        if toxic:
            rare += [i] * (i % 50 == 0)
            words.insert(rng.randrange(len(words)), "grubzo" if i % 50 == 0 else "vilexq")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(df, known, per_class=40).collect()}
    assert [i for i in rare if got[i].predicted != 1] == []
    assert sum(got[i].predicted for i in range(1, 1600, 2)) <= 8
    counts = {r.bucket: (r.n0, r.n1) for r in toxicity.count(df.join(known, "doc_id").withColumnRenamed("toxic", "label")).collect()}
    sets = [set(toxicity.ngrams([t], toxicity.SIZES, toxicity.BITS, toxicity.VISIBLE)[0].tolist()) for _, t in rows]
    brute = np.zeros((2, 1 << toxicity.BITS), int)
    for i, s in enumerate(sets):
        brute[labels[i][1], list(s)] += 1
    assert counts.pop(-1) == (800, 800) and counts == {int(b): tuple(brute[:, b]) for b in np.flatnonzero(brute.sum(0) >= toxicity.LEAST_TEXTS)}


def test_toxicity_ratios_and_regression_against_brute_force(spark, monkeypatch):
    import math

    import numpy as np

    monkeypatch.setattr(toxicity, "RIDGE", 0.01)
    monkeypatch.setattr(toxicity, "TOLERANCE", 1e-12)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS["aa"] + ["vilexq", "3!"] * (i % 3 == 0)) for _ in range(rng.randrange(2, 6)))) for i in range(150)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic", 1000)
    train = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    sets = [set(toxicity.ngrams([t], toxicity.SIZES, toxicity.BITS, toxicity.VISIBLE)[0].tolist()) for t, _ in train]
    y = np.array([y for _, y in train], float)
    n1, n0 = y.sum(), (1 - y).sum()
    ratio = {}
    for b in set().union(*sets):
        c1, c0 = sum(b in s for s, v in zip(sets, y, strict=True) if v), sum(b in s for s, v in zip(sets, y, strict=True) if not v)
        if c1 + c0 >= toxicity.LEAST_TEXTS:
            p, q = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
            if p != q:
                ratio[b] = math.log(p / q)
    buckets, weights, intercept = model
    assert sorted(ratio) == buckets.tolist()
    x = np.array([[ratio[b] * (b in s) for b in buckets.tolist()] for s in sets])
    w, b = weights / np.array([ratio[k] for k in buckets.tolist()]), intercept - math.log(y.mean() / (1 - y.mean()))
    # at the optimum of the balanced, penalised loss its gradient is zero
    error = (1 / (1 + np.exp(-(x @ w + b))) - y) * np.where(y == 1, 0.5 / n1, 0.5 / n0)
    assert np.abs(x.T @ error + 0.01 * w).max() < 1e-6 and abs(error.sum()) < 1e-6

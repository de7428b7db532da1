import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_bpe import LIBRARY
from tests.llm.test_ngram_join import brute as brute_join
from trajecta.llm import mixing

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def brute_cut(docs: list[tuple]) -> list[tuple]:
    seen: dict[bytes, tuple] = {}
    for i, t in docs:
        b = t.encode()
        for s in range(len(b) - 99):
            seen[b[s : s + 100]] = min(seen.get(b[s : s + 100], (2**63, 0)), (i, s))
    out = []
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\x01" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        if kept or not b:
            out.append((i, kept.decode("utf-8", "replace")))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(DOCUMENTS)
    extra = spark.createDataFrame([(9_000_001, None, "en", "src0", 0), (9_000_002, " 12 ?", None, None, 5)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted({(r.doc_id, r.text or "", r.source) for r in docs.collect()}, key=lambda r: r[0])
    # every text with letters is in a known language here
    rows = [r for r in rows if any(c.isalpha() for c in r[1])]
    classes = brute_join([(i, t) for i, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if classes[k][0] == r[0]]
    source = {i: s for i, _, s in rows}
    kept = brute_cut([(i, t) for i, t, _ in rows])
    tokens = defaultdict(int)
    for i, t in kept:
        tokens[source[i]] += len(t.split())
    plan = mixing.plan(dict(tokens))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {i: LIBRARY.encode_ordinary(t) for i, t in kept}
    draws = Counter(r.doc_id for r in got)
    assert set(draws) == set(want)
    drawn = defaultdict(int)
    text = dict(kept)
    for r in got:
        assert list(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        drawn[source[r.doc_id]] += len(text[r.doc_id].split())
    for s, n in tokens.items():
        longest = max(len(t.split()) for i, t in kept if source[i] == s)
        assert 0 <= drawn[s] - plan.weights[s] * plan.budget <= longest + 1e-6 * n
    assert all(1 <= n <= 2 for n in draws.values())


def test_stages_keep_the_columns_and_take_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(DOCUMENTS).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert out.count() == 0


def test_language_stage_keeps_short_clean_texts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = sorted({(" ".join(r.text.split()[:k]), r.lang) for r in docs.where("n_chars > 200 and doc_id < 100").collect() for k in range(1, 6)})
    words = [(t, lang) for t, lang in words if any(c.isalpha() for c in t)] + [("Avec.", "fr"), ("A.\nAll rights reserved.", "en")]
    strange = ["Привет, как дела сегодня у вас дома?", "今日は天気がいいですね。明日も晴れるでしょう", " 12 ?"]
    rows = [(9_000_000 + k, t, None, "src0", len(t)) for k, (t, _) in enumerate(words)] + [(9_500_000 + k, t, None, "src0", len(t)) for k, t in enumerate(strange)]
    out = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), str(tmp_path))
    kept = {r.doc_id for r in out.where("doc_id >= 9000000").collect()}
    assert kept == {9_000_000 + k for k in range(len(words))}


def test_near_duplicate_stage_keeps_rows_apart(spark, tmp_path):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(1, one, "en", "s", 0), (5, one, "en", "s", 0), (5, two, "en", "s", 0), (5, two, "en", "s", 0)], spark.read.parquet(DOCUMENTS).schema)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, one), (5, two)]

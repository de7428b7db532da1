import hashlib
import random
import time

import pytest
import xxhash

from trajecta.llm import suffix_dedup


def brute(docs: list[tuple[int | None, str | None]], length: int) -> list[tuple]:
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    data = [(i, t if isinstance(t, bytes) else (t or "").encode()) for i, t in docs]
    tags = [signed(xxhash.xxh64_intdigest(b, 42)) for _, b in data]
    place = lambda k, s: (-(2**63) if data[k][0] is None else data[k][0], tags[k], s)
    seen: dict[bytes, tuple] = {}
    for k, (_, b) in enumerate(data):
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            seen[w] = min(seen.get(w, (2**63,)), place(k, s))
    out = []
    for k, (i, b) in enumerate(data):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] < place(k, s):
                gone[s : s + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = ["é" + str(k) if k % 7 == 0 else "w" + str(k * k) for k in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(30) for _ in range(4)]
    docs: list[tuple[int | None, str | None]] = [(None, shared[0]), (-3, None), (0, ""), (1, "a" * 700), (2, "a" * 350 + "b"), (3, "ab" * 200), (4, "x")]
    for i in range(5, 60):
        t = text(rng.randrange(5, 60))
        for s in rng.sample(shared, rng.randrange(3)):
            cut = rng.randrange(len(s))
            t += (s if rng.random() < 0.5 else s[cut:] + s) + text(rng.randrange(3))
        docs.append((i, t))
    docs += [(100, docs[20][1]), (101, (docs[20][1] or "")[3:]), (30, docs[30][1]), (7, "another text with the id of row seven " * 4)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,limit", [(1, 4096), (2, 1)])
def test_equals_brute_force(spark, seed, limit):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, bucket string").repartition(3)
    for length, q in ((100, 32), (40, 13)):
        got = suffix_dedup.digests(suffix_dedup.dedup(df, length=length, q=q, bucket_limit=limit, block=400)).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, length)


def test_rows_without_an_id_of_their_own(spark, monkeypatch):
    """3000 rows without an id and rows that share one, long enough for places in one text to be taken for another's."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [" ".join(word() for _ in range(25)) for _ in range(40)]
    docs = [(rng.choice([None, None, 7, 8]), " ".join(word() for _ in range(rng.randrange(8))) + rng.choice([*shared, ""])) for _ in range(4000)]
    docs += docs[:50]
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(6)
    got = suffix_dedup.digests(suffix_dedup.dedup(df)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 100)
    monkeypatch.setattr(suffix_dedup, "RECENT", 16)
    got = suffix_dedup.digests(suffix_dedup.dedup(df, bucket_limit=1)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 100)


def test_bytes_that_are_not_text_and_ids_that_are_not_numbers(spark):
    docs = [(1, b"\xff\xfe" * 90), (2, b"\xfe\xff" * 90), (3, b"\xff" * 99)]
    df = spark.createDataFrame(docs, "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = suffix_dedup.digests(suffix_dedup.dedup(df)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 100)
    with pytest.raises(TypeError):
        suffix_dedup.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_keeps_columns_and_text(spark):
    df = spark.createDataFrame([(1, "k" * 3 + "0123456789" * 30, "s"), (2, "tail" + "0123456789" * 20, None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in suffix_dedup.dedup(df, keep=("source",), keep_text=True).collect()}
    assert (got[1].source, got[2].source, bytes(got[2].kept)) == ("s", None, b"tail")
    assert bytes(got[1].kept) == b"kkk" + b"0123456789"


def test_empty_table(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_jobs_shuffles_are_deleted(spark):
    """Else they lie on disk beside those of the second."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    ids = lambda: {int(n.split("_")[1]) for n in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())) if n.startswith("shuffle_")}
    spark.range(9).repartition(3).count()
    before = max(ids(), default=-1)
    df = spark.createDataFrame([(i, f"{i} " + "the same passage, again and again. " * 9) for i in range(40)], "doc_id long, text string")
    found = suffix_dedup.dedup(df)
    for _ in range(40):
        if not (left := {i for i in ids() if i > before}):
            break
        time.sleep(0.25)
    assert not left
    assert found.count() == 40

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from trajecta.llm import bpe

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def samples() -> list[str | None]:
    rng = random.Random(5)
    alphabet = "ab 'sré\n\t ½²漢字　\x1c\x85…٣😀$%_-<|endoftext|>"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200)]
    return [None, "", " ", "\n\n  x", "it's we'll", "a" * 5000, "<|endoftext|>", *odd, "Déjà vu 123 ", "Déjà vu 123 "]


def test_matches_library_and_round_trips(spark):
    given = samples()
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(given)], "doc_id long, text string, chunk string, ids array<int>")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df.repartition(3), chunk_tokens=500)).collect()}
    assert len(got) == len(given)
    for i, text in enumerate(given):
        assert list(got[i].ids) == LIBRARY.encode_ordinary(text or ""), text
        assert bytes(got[i].decoded) == (text or "").encode()


def test_digests_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "x")], "doc_id long, text string")
    rows = bpe.digests(bpe.decode(bpe.encode(df))).collect()
    assert len(rows) == 3
    ids = LIBRARY.encode_ordinary("two words")
    want = (1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"two words").hexdigest())
    assert [tuple(r) for r in rows].count(want) == 2


def test_empty_table(spark):
    assert bpe.digests(bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def merged(word: bytes) -> list[int]:
    """Byte pair encoding by the book: the pair of the lowest rank is merged until no pair has one."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        ranked = [(RANKS[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in RANKS]
        if not ranked:
            return [RANKS[p] for p in parts]
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_ids_are_merges_by_rank(spark):
    import regex

    given = [t for t in samples() if t and len(t) < 1000]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    for i, text in enumerate(given):
        assert got[i] == [k for word in regex.findall(P.PATTERN, text) for k in merged(word.encode())]


def test_bytes_that_are_not_text_and_ids_that_are_not_numbers(spark):
    import pytest

    df = spark.createDataFrame([(1, b"a\xffb")], "doc_id int, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    assert [list(r.ids) for r in bpe.encode(df).collect()] == [LIBRARY.encode_ordinary("a\ufffdb")]
    with pytest.raises(TypeError):
        bpe.encode(spark.createDataFrame([("a", "b")], "doc_id string, text string"))

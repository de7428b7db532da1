import hashlib
import random

from trajecta.llm import chunk_dedup


def brute_cuts(text: bytes, reach: int) -> list[int]:
    import numpy as np

    table = [int(x) for x in np.random.default_rng(7).integers(0, 2**32, 256, np.uint32)]
    h, value = [], 0
    for b in text:
        value = ((value << 1) + table[b]) % 2**32
        h.append(value)
    around = {i: (min(h[i - reach : i]), min(h[i + 1 : i + reach + 1])) for i in range(reach, len(text) - reach)}
    tied = [i for i, (a, z) in around.items() if h[i] <= a and h[i] <= z]
    edges = [0, *(i for i in tied if h[i] < around[i][0]), len(text)]
    more = []
    for a, z in zip(edges, edges[1:], strict=False):
        if z - a > chunk_dedup.LARGEST:
            for i in tied:
                if a + chunk_dedup.LARGEST <= i < z:
                    more.append(i)
                    a = i
    return sorted({*edges, *more})


def brute(docs, reach):
    cut = {}
    for i, t in docs:
        b = (t or "").encode()
        edges = brute_cuts(b, reach)
        cut[i, b] = list(zip(edges, edges[1:], strict=False))
    first = {}
    for (i, b), spans in cut.items():
        for a, z in spans:
            first[b[a:z]] = min(first.get(b[a:z], (2**63, 0)), (i, a))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        runs = []
        for a, z in cut[i, b]:
            if first[b[a:z]] < (i, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
        kept, at = b"", 0
        for a, z in runs:
            kept, at = kept + b[at:a], z
        kept += b[at:]
        out.append((i, len(b), len(b) - len(kept), [x for r in runs for x in r], hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k * k}é" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(3)]
    docs = [(1, None), (2, ""), (3, "x"), (4, "x"), (5, "a" * 9000), (6, "b" + "a" * 9000), (7, "abcdefg" * 2500), (8, "efg" + "abcdefg" * 700 + "!" + "cdefg" + "abcdefg" * 1900)]
    docs += [(i, text(rng.randrange(40)) + (rng.choice(shared) if i % 2 else "") + text(rng.randrange(40))) for i in range(10, 70)]
    docs += [(100, docs[30][1]), docs[31]]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, bucket int").repartition(3)
    got = sorted(tuple(r) for r in chunk_dedup.dedup(df, block=3000).collect())
    assert got == brute(docs, chunk_dedup.REACH)
    caught = {r[0]: r[2] for r in got}
    holders = [i for i, t in docs if 10 <= i < 70 and i % 2]
    assert sum(caught[i] > 100 for i in holders) >= len(holders) - 6
    assert caught[8] > 8000  # an insertion and another phase leave a run of a short period alike
    assert all(caught[i] == 0 for i, _ in docs if 10 <= i < 70 and not i % 2)


def test_insertions_move_no_far_cuts(spark):
    rng = random.Random(7)
    t = " ".join(str(rng.randrange(10**6)) for _ in range(400))
    df = spark.createDataFrame([(1, t), (2, t[:1500] + "INSERTED" + t[1500:]), (3, "lead " + t)], "doc_id long, text string")
    got = {r.doc_id: r for r in chunk_dedup.dedup(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > len(t) - 300 and got[3].n_removed > len(t) - 300


def test_empty_table(spark):
    assert chunk_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0

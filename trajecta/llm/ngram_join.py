"""N-gram Jaccard join by chosen paths: all pairs of texts whose word shingle sets are similar.

Words are lower-cased and separated by white space; a text's set holds its runs of ``n`` words (a shorter
text that has words is one run). Texts with equal sets form a *group* (exact copies and texts that differ
in case or white space); groups are joined, and copies are never expanded into pairs. A word stands for its
128-bit digest, a shingle for two 64-bit mixes of its words' digests: the first is what sets hold and are compared
by, and a group's key is a 128-bit digest of both.

Recursion: each of several independent runs splits all groups on ``BRANCHES`` sampled shared tokens. A token
is sampled by a random order of all tokens (the smallest in the set), so two sets choose the same one
with the probability of their similarity. A bucket of one set ends; a small bucket is a leaf; a large one is
split again in orders that this run hasn't used, unless a child keeps half of it: then its sets are alike, and it is a leaf.
Runs are repeated until a pair at the threshold is found with the target recall, however deep its buckets are split.

Leaves are compared by brute force with exact set overlaps. A leaf of any size is whole: it is cut into
blocks, and every pair of blocks is compared by matrix products, so no bucket is capped and no pair is
emitted. Links are counted once, in the first leaf that both sets are in. Leaves send, for each set, its number of links
and one edge to the smallest set of its local component; components of these edges give the classes.

A document is known by its id and two 64-bit hashes of its text, so rows that share an id or have none are kept apart.

Defined results: texts without words (null, empty, blank) have equal, empty sets and are copies of one
another; repeated rows count as documents of their own; a null id is smaller than all others (the smallest long
stands for it and is no id of its own); bytes that aren't UTF-8 are read as U+FFFD. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.hashing import mixed
from trajecta.llm.shared import collected, delete, long_id, map_arrow, materialise, slices, texts, valid_text

N = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Tokens a run splits all sets on, and tokens a large bucket is split on.
BRANCHES, INNER_BRANCHES = 2, 3
DEPTH = 8
LEAF_SETS, BLOCK_SETS, BLOCK_SHINGLES = 2000, 2048, 2_000_000
NULL_ID = -(2**63)
PIECE = 2_000_000
#: Words whose digests a task holds.
WORDS = 500_000
KEY = ["doc_id", "text_1", "text_2"]


def runs_needed(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met in a leaf with probability ``recall``, at full depth."""
    found = (1 - (1 - threshold) ** BRANCHES) * (1 - (1 - threshold) ** INNER_BRANCHES) ** (DEPTH - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found))) if found < 1 else 1


class Words(dict):
    """word -> its row in ``digests``."""

    def __init__(self):
        self.fresh: list[str] = []
        self.digests = np.empty((0, 2), np.uint64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def __call__(self, words: list[str]) -> np.ndarray:
        """A row of two 64-bit numbers for each word."""
        if len(self) > WORDS:
            self.clear()
            self.digests = self.digests[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            made = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in self.fresh)
            self.digests = np.concatenate([self.digests, np.frombuffer(made, np.uint64).reshape(-1, 2)])
            self.fresh.clear()
        return self.digests[at]


class Shingler:
    """Shingle sets of many texts at once."""

    def __init__(self, n: int):
        self.n, self.words = n, Words()
        self.factor = np.random.default_rng(8).integers(0, 2**64, 2, np.uint64) | np.uint64(1)

    def __call__(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, second hashes, edges): text i has the sorted distinct hashes[edges[i]:edges[i + 1]]."""
        split = [t.lower().split() for t in found]
        count = np.array([len(w) for w in split], np.int64)
        if not count.sum():
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros(len(found) + 1, np.int64)
        words = self.words([w for some in split for w in some])
        start, text = np.cumsum(count) - count, np.repeat(np.arange(len(found)), count)
        place = np.arange(len(words)) - start[text]
        whole = np.flatnonzero(place + self.n <= count[text])
        made, owners = [], [text[whole]]
        state = np.ones_like(words)
        for k in range(self.n):
            state = mixed((state[: max(0, len(words) - k)] ^ words[k:]) * self.factor)
            if k + 1 < self.n and (short := np.flatnonzero(count == k + 1)).size:
                made.append(state[start[short]])
                owners.append(short)
        hashes, owner = np.concatenate([state[whole], *made]), np.concatenate(owners)
        order = np.lexsort((hashes[:, 0], owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:, 0] != hashes[:-1, 0]) | (owner[1:] != owner[:-1])
        return np.ascontiguousarray(hashes[new, 0]), np.ascontiguousarray(hashes[new, 1]), np.searchsorted(owner[new], np.arange(len(found) + 1))


def digest(hashes: np.ndarray, second: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes() + second.tobytes(), digest_size=16).digest()


def pack_set(hashes: np.ndarray) -> bytes:
    """Steps between sorted numbers as compressed byte planes."""
    steps = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return len(hashes).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps.T).tobytes(), codec="zstd", asbytes=True)


def unpack_set(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], n * 8, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, n: int, runs: int) -> DataFrame:
    """The document's key, its set's digest and size, and the set's smallest token in each order: of the ``sampled`` ones
    64 bits, of the ``inner`` ones 32."""
    first, inner = runs * BRANCHES, runs * (DEPTH - 1) * INNER_BRANCHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        # the hashes are random, so their odd multiples order them at random
        factor = np.random.default_rng(9).integers(0, 2**64, first + inner, np.uint64) | np.uint64(1)
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                hashes, second, edges = shingles(batch.column("text").to_pylist())
                size = np.diff(edges)
                some = size > 0
                sampled, within = np.zeros((len(size), first), np.int64), np.zeros((len(size), inner), np.int32)
                for k in range(first + inner) if some.any() else ():
                    least = np.minimum.reduceat(hashes * factor[k], edges[:-1][some])
                    if k < first:
                        sampled[some, k] = least.view(np.int64)
                    else:
                        within[some, k - first] = (least >> np.uint64(24)).astype(np.uint32).view(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], np.int32)), pa.array(x.ravel()))
                gids = pa.array([digest(hashes[i:j], second[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), gids, pa.array(size), lists(sampled), lists(within)], names=[*KEY, "gid", "n_shingles", "sampled", "inner"])

    return map_arrow(docs, run, "doc_id long, text_1 long, text_2 long, gid binary, n_shingles long, sampled array<bigint>, inner array<int>")


def sizes_of(members: DataFrame) -> DataFrame:
    """Buckets of two sets or more, with a digest of their members."""
    return members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.bit_xor(F.xxhash64("gid")).alias("x")).where("n > 1")


def leaves(groups: DataFrame, runs: int) -> DataFrame:
    """(gid, leaf, n, total, x) of every set in every leaf."""
    members = groups.select("gid", "n_shingles", F.posexplode("sampled").alias("k", "token")).select(
        "gid", "n_shingles", (F.col("k") / BRANCHES).cast("int").alias("run"), F.lit(0).cast("long").alias("parent"), F.xxhash64("k", "token").alias("bucket")
    )
    done = None
    for depth in range(1, DEPTH + 1):
        is_large = (F.col("n") > LEAF_SETS) | (F.col("total") > BLOCK_SHINGLES) if depth < DEPTH else F.lit(False)
        # Sets are joined with the sizes of their buckets; a hot bucket is one row on the right, and its sets can be split on the left.
        sized = materialise(members.join(sizes_of(members), "bucket").withColumn("large", is_large), "join-buckets")
        if depth > 1:
            above = large.select(F.col("bucket").alias("parent"), "gid", F.col("n").alias("parent_n"), F.col("total").alias("parent_total"), F.col("x").alias("parent_x"))
            most = sized.groupBy("parent").agg(F.max("n").alias("most"))
            stops = above.join(most, "parent", "left").where("coalesce(most, 0) * 2 >= parent_n")
            done = done.unionByName(stops.select("gid", F.col("parent").alias("leaf"), F.col("parent_n").alias("n"), F.col("parent_total").alias("total"), F.col("parent_x").alias("x")))
            sized = sized.join(stops.select("parent").distinct(), "parent", "left_anti")
        small = sized.where("not large").select("gid", F.col("bucket").alias("leaf"), "n", "total", "x")
        done = small if done is None else done.unionByName(small)
        large = sized.where("large")
        if depth == DEPTH or large.isEmpty():
            return done
        order = (F.col("run") * (DEPTH - 1) + depth - 1) * INNER_BRANCHES + F.col("j")
        members = (
            large.select("gid", "n_shingles", "run", F.col("bucket").alias("parent"), F.explode(F.array(*(F.lit(j) for j in range(INNER_BRANCHES)))).alias("j"))
            .join(groups.select("gid", "inner"), "gid")
            .select("gid", "n_shingles", "run", "parent", F.xxhash64("parent", "j", F.get("inner", order)).alias("bucket"))
        )
    return done


def overlap(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of integer sets; ``right`` None: of ``left`` with itself."""
    both = left + (right or [])
    tokens, row = np.concatenate(both) if both else np.empty(0, np.int64), np.repeat(np.arange(len(both)), [len(s) for s in both])
    m = len(left)
    out = np.zeros((m, len(both) - m if right is not None else m), np.float32)
    order = np.lexsort((row, tokens))
    tokens, row = tokens[order], row[order]
    edge = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, np.int64)
    size = np.diff(np.append(edge, len(tokens)))
    each = np.repeat(size, size)
    often = each > max(16, len(both) // 50)
    number = np.cumsum(np.repeat(size > max(16, len(both) // 50), size) & (np.arange(len(tokens)) == np.repeat(edge, size))) - 1
    slab = max(1, 8_000_000 // max(1, len(both)))
    n_often = int(number[-1]) + 1 if len(number) else 0
    o_row, o_number = row[often], number[often]
    for start in range(0, n_often, slab):
        lo, hi = np.searchsorted(o_number, [start, start + slab])
        dense = np.zeros((len(both), min(slab, n_often - start)), np.float32)
        dense[o_row[lo:hi], o_number[lo:hi] - start] = 1
        out += dense[:m] @ (dense[m:] if right is not None else dense).T
    rare = ~often & (each > 1)
    tokens, row = tokens[rare], row[rare]
    for k in range(1, int(each[rare].max()) if rare.any() else 0):
        same = np.flatnonzero(tokens[k:] == tokens[:-k])
        a, b = row[same], row[same + k]
        if right is None:
            np.add.at(out, (np.append(a, b), np.append(b, a)), 1)
        else:
            cross = (a < m) & (b >= m)
            np.add.at(out, (a[cross], b[cross] - m), 1)
    if right is None:
        np.fill_diagonal(out, [len(s) for s in left])
    return out


def compare(left: list[tuple], right: list[tuple] | None, threshold: float) -> Iterator[tuple]:
    """Rows (gid, links or None, smallest gid of the local component). Items: (gid, weight, earlier leaves, set)."""
    both = left + (right or [])
    gids = [x[0] for x in both]
    m = len(left)
    sizes, weight = np.array([len(x[3]) for x in both], np.float32), np.array([x[1] for x in both], np.float64)
    common = overlap([x[3] for x in left], [x[3] for x in right] if right is not None else None)
    other = slice(m, None) if right is not None else slice(None)
    linked = common >= np.float32(threshold) * (sizes[:m, None] + sizes[None, other] - common) - 1e-4
    if right is None:
        np.fill_diagonal(linked, False)
    # links of pairs that meet in an earlier leaf are counted there
    seen = overlap([x[2] for x in left], [x[2] for x in right] if right is not None else None) > 0
    count = np.zeros(len(both))
    fresh = linked & ~seen
    count[:m] += fresh @ weight[other]
    if right is not None:
        count[m:] += weight[:m] @ fresh
    label = np.full(len(both), -1)
    order = sorted(range(len(both)), key=gids.__getitem__)
    for root in order:
        if label[root] >= 0:
            continue
        label[root], edge = root, np.array([root])
        while len(edge):
            hit = np.zeros(len(both), bool)
            a = edge[edge < m]
            if right is None:
                hit |= linked[a].any(0)
            else:
                hit[m:] |= linked[a].any(0)
                hit[:m] |= linked[:, edge[edge >= m] - m].any(1)
            edge = np.flatnonzero(hit & (label < 0))
            label[edge] = root
    for i in range(len(both)):
        if count[i] or label[i] != i:
            yield gids[i], int(round(count[i])), gids[label[i]]


def brute_force(docs: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(gid, links, root) from all leaves. ``members``: key of a document, gid, weight, leaves: array of (leaf, parts)."""
    names = ["leaf", "one", "other", "part", "gid", "weight", "earlier", "shingles"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Makes the sets of the documents that stand for groups and deals them to their leaves' block pairs."""
        shingles = Shingler(n)
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                hashes, _, edges = shingles(batch.column("text").to_pylist())
                out: list[list] = [[] for _ in names]
                held = 0
                for i in range(batch.num_rows):
                    gid, weight, found = (batch.column(c)[i].as_py() for c in ("gid", "weight", "leaves"))
                    packed = pack_set(hashes[edges[i] : edges[i + 1]])
                    keys = sorted(x["leaf"] for x in found)
                    for x in found:
                        part = int.from_bytes(gid[:8], "little") % x["parts"]
                        for t in range(x["parts"]):
                            row = (x["leaf"], min(part, t), max(part, t), part, gid, weight, [k for k in keys if k < x["leaf"]], packed)
                            for column, value in zip(out, row, strict=True):
                                column.append(value)
                            held += len(packed)
                            if held > 8_000_000:
                                yield made(out)
                                out, held = [[] for _ in names], 0
                if out[0]:
                    yield made(out)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def result():
            left, right = held
            rows = list(compare(left, right if key[1] != key[2] else None, threshold)) if key else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["gid", "links", "root"])

        for batch in batches:
            for i in range(batch.num_rows):
                leaf, one, other, part, gid, weight, earlier, packed = (batch.column(c)[i].as_py() for c in names)
                if (leaf, one, other) != key:
                    yield from result()
                    key, held = (leaf, one, other), ([], [])
                held[part != one].append((gid, weight, np.array(earlier, np.int64), unpack_set(packed)))
        yield from result()

    # Repeated rows are dropped before the shuffle; the join needs no other, and documents that stand for no group end here.
    standing = docs.dropDuplicates(KEY).join(members, KEY).select("text", "gid", "weight", "leaves")
    dealt = map_arrow(standing, spread, "leaf long, one int, other int, part int, gid binary, weight long, earlier array<bigint>, shingles binary")
    return map_arrow(dealt.repartition("leaf", "one", "other").sortWithinPartitions("leaf", "one", "other"), join, "gid binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected edges (a, b), root being its component's smallest node.
    Large-star and small-star steps alternate until nothing changes."""
    pairs = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    with collected() as before:
        edges, seen = materialise(pairs(edges), "join-edges"), None
    while True:
        mirrored = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = mirrored.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs(mirrored.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        with collected() as made:
            edges = materialise(pairs(small), "join-edges")
        delete(edges.sparkSession, before)
        before = made
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents' keys and texts."""
    docs = texts(df, id_col, text_col).withColumn("doc_id", F.coalesce(long_id(df, id_col), F.lit(NULL_ID)))
    return docs.select("doc_id", F.xxhash64("text").alias("text_1"), F.xxhash64(F.lit(1), "text").alias("text_2"), "text")


def classes(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(keys and gids of all documents; gid, class's key, n_links and n_copies of all groups) of keyed documents."""
    spark, runs = docs.sparkSession, runs_needed(threshold, recall)
    sketched = materialise(sketches(docs, n, runs), "join-sketches")
    groups = sketched.groupBy("gid").agg(F.min(F.struct(*KEY)).alias("first"), F.count("*").alias("n_copies"), *(F.first(c).alias(c) for c in ("n_shingles", "sampled", "inner")))
    groups = materialise(groups, "join-groups")
    with collected() as made:
        # The same sets often meet in several leaves; of leaves with equal members one is compared.
        found = leaves(groups.where("n_shingles > 0"), runs)
        kept = found.select("leaf", "n", "total", "x").distinct().groupBy("n", "total", "x").agg(F.min("leaf").alias("leaf"))
        parts = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("parts")
        members = found.select("gid", "leaf").join(kept.select("leaf", parts), "leaf").groupBy("gid").agg(F.collect_set(F.struct("leaf", "parts")).alias("leaves"))
        members = groups.select("gid", "first.*", F.col("n_copies").alias("weight")).join(members, "gid")
        results = materialise(brute_force(docs, members, n, threshold), "join-links")
    delete(spark, made[:-1])
    rooted = components(results.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    links = results.groupBy("gid").agg(F.sum("links").alias("links"))
    rooted = groups.select("gid", "first", "n_copies").join(rooted.withColumnRenamed("node", "gid"), "gid", "left").join(links, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    least = rooted.groupBy("root").agg(F.min("first").alias("class"))
    known = rooted.join(least, "root").select("gid", "class", "n_copies", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    return sketched.select(*KEY, "gid"), known


def join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id`` (smallest id of the texts connected by links),
    ``n_links`` (other documents at or above the threshold) and ``n_copies`` (documents with an equal set, itself included)."""
    rows, known = classes(keyed(df, id_col, text_col), n, threshold, recall)
    null_id = lambda c, name: F.when(F.col(c) != F.lit(NULL_ID), F.col(c)).alias(name)
    return rows.join(known, "gid").select(null_id("doc_id", "doc_id"), null_id("class.doc_id", "class_id"), "n_links", "n_copies")


def representatives(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One document of each class, that of the smallest id (then text hashes): ``doc_id, text`` and the columns in ``keep``."""
    _, known = classes(keyed(df, id_col, text_col), n, threshold, recall)
    chosen = known.select("class.*").distinct()
    rest = F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in keep if c not in ("doc_id", "text")))
    rows = df.select(rest.alias("rest"), F.coalesce(long_id(df, id_col), F.lit(NULL_ID)).alias("doc_id"), valid_text(text_col).alias("text"))
    rows = rows.select("rest", "doc_id", F.xxhash64("text").alias("text_1"), F.xxhash64(F.lit(1), "text").alias("text_2"))
    return rows.join(chosen, KEY, "left_semi").dropDuplicates(KEY).select("rest.*")

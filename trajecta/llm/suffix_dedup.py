"""Suffix-array substring dedup by bucket-pointer refinement over sampled suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document with a
smaller id, or earlier in the same document. Strings are judged on the input, and never cross documents.

Sorting all suffixes would shuffle each byte several times. Instead, the initial q-gram buckets are
sampled by content: every window of ``length`` bytes is represented by the smallest-hashed q-gram in it
(leftmost on ties), its *anchor*. Equal windows have equal anchors at equal offsets, so only suffixes in
the same anchor bucket need refinement. Successive windows with one anchor form a *context*, a run of
``length`` to ``2 * length - q`` bytes, about one per 35 bytes of text.

1. Contexts are shuffled by anchor bucket. A bucket with one member is settled, as are repeats of a whole
   context: all its windows start earlier elsewhere. First occurrences of different contexts in one
   bucket stay open. Repeats of what a task has sent lately are settled before the shuffle, so a hot passage
   costs about a row per task and not one per copy.
2. Settled runs and open contexts go back to their documents, by id. Documents without open contexts end here.
3. Open contexts are shuffled by bucket with their bytes and refined there: initial buckets of 8-grams,
   then sorting on (own bucket, bucket of the suffix 8, 16, 32, ... bytes later), each round reusing the
   buckets of the one before, until buckets stand for ``length`` bytes. Suffixes that are alone are dropped early.
   A bucket of more than ``bucket_limit`` contexts is not refined in one task: its windows are settled by
   digest as in 1, again with repeats removed before the shuffle.
4. The runs of step 3 join the documents that had open contexts.

Contexts and windows of oversized buckets are compared by 128 bits of hash, 64 of them BLAKE2b's; refinement compares bytes.

A document is known by its id; where an id is null or in several rows, the 64-bit hash of the text, the *tag*, tells
the rows apart (it is 0 elsewhere, so that rows stay small).

Defined results: a null text counts as empty; a text shorter than ``length`` loses nothing; texts are bytes as they
are stored, UTF-8 or not; a null id sorts before all others (the smallest long stands for it and is no id of its own);
repeated rows (same id and text) are one document and get the same result each; rows that share an id but
not the text are documents in the order of their texts' hashes. Other columns can be carried along with ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm.hashing import Hasher, digests as digests_of, sliding_minimum
from trajecta.llm.shared import long_id, map_arrow, materialise, release, slices

LENGTH = 100
Q = 32
BUCKET_LIMIT = 4096
#: Texts are handled in blocks of about so many bytes; a longer text is cut into overlapping segments.
BLOCK = 2_000_000
NULL_ID = -(2**63)
SETTLED, OPEN, OVERSIZED = 0, 1, 2
#: Rows that a task remembers having sent.
RECENT = 1 << 18
#: Bits of a position that hold a run's bytes beyond ``length``.
EXTRA = 24


def blocks(batch: pa.RecordBatch, length: int, block: int) -> Iterator[tuple]:
    """(bytes, segment ends, row of each segment, its offset in the text) of about ``block`` bytes each."""
    texts = batch.column("text")
    held, size = [], 0

    def out():
        return np.frombuffer(b"".join(h[2] for h in held), np.uint8), np.cumsum([len(h[2]) for h in held]), np.array([h[0] for h in held]), np.array([h[1] for h in held])

    for i in range(batch.num_rows):
        text = texts[i].as_py()
        for offset in range(0, max(1, len(text) - length + 1), block):
            piece = text[offset : offset + block + length - 1] if len(text) > block else text
            if len(piece) < length:
                continue
            if held and size + len(piece) > block:
                yield out()
                held, size = [], 0
            held.append((i, offset, piece))
            size += len(piece)
    if held:
        yield out()


def firsts(bucket, digest, doc, tag, pos):
    """Order by (bucket, digest, doc, tag, pos) and a mark of the first row of each (bucket, digest)."""
    order = np.lexsort((pos, tag, doc, digest, bucket))
    b, d = bucket[order], digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    return order, new


def packed_pos(start, extra):
    """One sortable number: start of the run and its bytes beyond ``length``."""
    return (start << EXTRA) | extra


def begin_of(pos):
    return pos >> EXTRA


def extra_of(pos):
    return pos & ((1 << EXTRA) - 1)


class Recent:
    """What a task has sent lately: a table with one place for each (bucket, digest), the newest taking it."""

    def __init__(self):
        self.rows = np.zeros((5, RECENT), np.int64)
        self.used = np.zeros(RECENT, bool)

    def repeats(self, *row):
        """Marks rows whose (bucket, digest) was sent from an earlier place; the others take their places in the table."""
        at = row[1] & (RECENT - 1)
        bucket, digest, *place = self.rows[:, at]
        found, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
        for theirs, own in zip(place, row[2:], strict=True):
            found |= equal & (theirs < own)
            equal &= theirs == own
        found &= self.used[at] & (bucket == row[0]) & (digest == row[1])
        fresh = ~found
        self.rows[:, at[fresh]] = np.stack([x[fresh] for x in row])
        self.used[at[fresh]] = True
        return found


NAMES = ["bucket", "digest", "doc_id", "tag", "pos"]
ROWS = ", ".join(f"{n} long" for n in NAMES)


def make_contexts(df: DataFrame, length: int, q: int, block: int) -> DataFrame:
    """NAMES of each context that isn't known to be a repeat; rows without a bucket are settled runs, their digest being the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, mask, recent = Hasher(q), np.uint64(0xFFFFFF), Recent()
        for whole in batches:
            for batch in slices(whole, "text", 8 * block):
                ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
                for buf, ends, row, offset in blocks(batch, length, block):
                    grams = hasher.grams(buf)
                    low = sliding_minimum((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), length - q + 1)
                    segment = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                    anchor = (low & mask).astype(np.int64)
                    anchor[segment[: len(low)] != segment[length - 1 :]] = -1
                    start = np.flatnonzero(np.diff(anchor, prepend=-2))
                    stop = np.append(start[1:], len(anchor))
                    keep = anchor[start] >= 0
                    start, stop = start[keep], stop[keep] + length - 1
                    if not len(start):
                        continue
                    at = segment[start]
                    begin = start - np.append(0, ends[:-1])[at] + offset[at]
                    doc, tag, n = ids[row[at]], tags[row[at]], stop - start
                    bucket, digest = grams[anchor[start]].view(np.int64), digests_of(buf, start, stop)[0]
                    yield from sent(recent, bucket, digest, doc, tag, packed_pos(begin, n - length), begin + n)

    return map_arrow(df, run, ROWS)


def sent(recent, bucket, digest, doc, tag, pos, end) -> Iterator[pa.RecordBatch]:
    """Rows that aren't known to be repeats, and settled runs of those that are. The input is in order of text and start."""
    order, new = firsts(bucket, digest, doc, tag, pos)
    first = np.sort(order[new])  # in the order of texts, whose ids then compress well in the shuffle
    columns = (bucket, digest, doc, tag, pos)
    known = recent.repeats(*(x[first] for x in columns))
    yield pa.RecordBatch.from_arrays([pa.array(x[first[~known]]) for x in columns], names=NAMES)
    later = np.sort(np.append(order[~same_place(new, doc[order], tag[order], pos[order])], first[known]))
    yield from settled(doc[later], tag[later], begin_of(pos[later]), end[later])


def same_place(new, doc, tag, pos):
    """Marks first rows and rows at the place of the first one, which only a repeated row can have."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc == doc[first]) & (tag == tag[first]) & (pos == pos[first]) if len(new) else new


def settled(doc, tag, begin, end) -> Iterator[pa.RecordBatch]:
    """Removed runs, merged where they meet, as rows without a bucket. The input is in order of text and start."""
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (begin[1:] > end[:-1]) | (begin[1:] < begin[:-1])
        first = np.flatnonzero(new)
        end = np.maximum.reduceat(end, first)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.int64()), pa.array(end), *map(pa.array, (doc[first], tag[first], packed_pos(begin[first], 0)))], names=NAMES)


def settle(rows: DataFrame, length: int, bucket_limit: int, leave_open: bool) -> DataFrame:
    """Where all contexts of a bucket meet: later ones of equal digest are settled; if ``leave_open``, the
    first ones of a bucket with several digests are returned as open, with the bucket, or as oversized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "bucket", "doc_id", "tag", "pos", "end"]
        # First contexts of the bucket being read, at most bucket_limit of them and a batch; once there are more, they aren't held.
        held, held_bucket, count = [], None, 0
        carried = None  # the first row of the digest being read

        def rows_of(kind, bucket, doc, tag, pos, end=None):
            end = np.zeros(len(doc), np.int64) if end is None else end
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *map(pa.array, (bucket, doc, tag, pos, end))], names=names)

        def flush(kind):
            nonlocal held
            if held and leave_open and (kind == OVERSIZED or count > 1):
                place = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield rows_of(kind, np.full(len(place[0]), held_bucket), *place)
            held = []

        def add(bucket, place):
            nonlocal held_bucket, count
            if bucket != held_bucket:
                yield from flush(OPEN)
                held_bucket, count = bucket, 0
            held.append(place)
            count += len(place[0])
            if count > bucket_limit:
                yield from flush(OVERSIZED)

        for batch in batches:
            done = batch.filter(batch.column("bucket").is_null())
            if done.num_rows:
                yield rows_of(SETTLED, np.zeros(done.num_rows, np.int64), *(done.column(x).to_numpy() for x in ("doc_id", "tag", "pos", "digest")))
            batch = batch.filter(batch.column("bucket").is_valid())
            if not batch.num_rows:
                continue
            table = [batch.column(x).to_numpy() for x in NAMES]
            if carried:
                table = [np.append(c, t) for c, t in zip(carried, table, strict=True)]
            bucket, digest, *place = table
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (digest[1:] != digest[:-1])
            later = ~same_place(new, *place)
            if later.any():
                pos = place[2][later]
                yield rows_of(SETTLED, bucket[later], *(x[later] for x in place), begin_of(pos) + extra_of(pos) + length)
            first = np.flatnonzero(new)
            last = int(first[-1])
            if carried:
                first = first[1:]
            carried = tuple(x[last] for x in table)
            if not leave_open or not len(first):
                continue
            b, place = bucket[first], [x[first] for x in place]
            edge = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
            yield from add(b[0], [x[: edge[1]] for x in place])
            if len(edge) > 2:
                size = np.repeat(np.diff(edge), np.diff(edge))
                inner = np.zeros(len(b), bool)
                inner[edge[1] : edge[-2]] = True
                for kind, some in ((OPEN, inner & (size > 1) & (size <= bucket_limit)), (OVERSIZED, inner & (size > bucket_limit))):
                    if some.any():
                        yield rows_of(kind, b[some], *(x[some] for x in place))
                yield from add(b[-1], [x[edge[-2] :] for x in place])
        yield from flush(OPEN)

    # Settled runs only pass through. Open contexts need their whole bucket in one task; else equal digests are enough.
    key = F.coalesce("bucket", F.xxhash64("doc_id", "tag", "pos"))
    dealt = rows.repartition(key) if leave_open else rows.repartition(key, F.when(F.col("bucket").isNotNull(), F.col("digest")))
    return map_arrow(dealt.sortWithinPartitions(*NAMES), run, "kind int, bucket long, doc_id long, tag long, pos long, end long")


def merged(begin, end):
    """Union of runs, in order."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(end))[: len(first)] - 1]


def to_documents(docs: DataFrame, status: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """Brings runs and open contexts to their documents. A document without open contexts is finished; else
    it is returned as it is, with its settled runs, its open contexts' bytes, and its windows in oversized buckets."""
    has_rest = "rest" in docs.columns
    rest_type = docs.schema["rest"].dataType if has_rest else T.StructType([T.StructField("none", T.IntegerType())])
    null = lambda kind: F.lit(None).cast(kind)
    left = docs.select("doc_id", "tag", F.lit(9).alias("kind"), null("long").alias("bucket"), F.lit(0).cast("long").alias("pos"), null("long").alias("end"), "text", "spans", *(["rest"] if has_rest else [null(rest_type).alias("rest")]))
    right = status.select(
        "doc_id", "tag", "kind", "bucket", "pos", "end", null("binary").alias("text"), null("array<long>").alias("spans"), null(rest_type).alias("rest")
    )
    schema = T.StructType(
        [T.StructField(n, t) for n, t in (("kind", T.IntegerType()), ("doc_id", T.LongType()), ("tag", T.LongType()), ("bucket", T.LongType()), ("digest", T.LongType()), ("pos", T.LongType()), ("text", T.BinaryType()), ("spans", T.ArrayType(T.LongType())), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()))]
        + [T.StructField("rest", rest_type)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        key, known = None, None
        out: list[dict] = []

        def batch_of(rows, **columns):
            n = len(next(iter(columns.values()))) if columns else len(rows)
            made = {k: pa.array([r.get(k) for r in rows], t) for k, t in plain.items()} if rows else {k: pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in plain.items()}
            rest = pa.concat_arrays([r["rest"] for r in rows]) if rows else pa.nulls(n, rest_arrow)
            return pa.RecordBatch.from_arrays([*made.values(), rest], names=[*plain, "rest"])

        plain = {"kind": pa.int32(), "doc_id": pa.int64(), "tag": pa.int64(), "bucket": pa.int64(), "digest": pa.int64(), "pos": pa.int64(), "text": pa.binary(), "spans": pa.list_(pa.int64()), "n_bytes": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        windows: list[list] = [[], [], [], [], []]

        def settled_windows():
            bucket, digest, doc, tag, pos = (np.concatenate(w) for w in windows)
            for w in windows:
                w.clear()
            order, new = firsts(bucket, digest, doc, tag, pos)
            first, later = order[new], np.sort(order[~same_place(new, doc[order], tag[order], pos[order])])
            yield batch_of([], kind=np.full(len(first), 3, np.int32), bucket=bucket[first], digest=digest[first], doc_id=doc[first], tag=tag[first], pos=pos[first])
            for done in settled(doc[later], tag[later], begin_of(pos[later]), begin_of(pos[later]) + length):
                yield batch_of([], kind=np.full(done.num_rows, 3, np.int32), **{c: done.column(c) for c in NAMES[1:]})

        for batch in batches:
            rest_arrow = batch.schema.field("rest").type
            kinds = batch.column("kind").to_numpy()
            start = 0
            for at in np.flatnonzero(kinds == 9):
                if at > start:
                    pending.append(batch.slice(start, at - start))
                start = at + 1
                doc, tag, text, spans = (batch.column(c)[at].as_py() for c in ("doc_id", "tag", "text", "spans"))
                if (doc, tag) != key:
                    key = (doc, tag)
                    known = [np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in pending]) for c in ("kind", "bucket", "pos", "end")] if pending else None
                    pending = []
                begin, end = np.array(spans[::2], np.int64), np.array(spans[1::2], np.int64)
                unsettled = None
                if known is not None:
                    kind, bucket, pos, ends = known
                    done = kind == SETTLED
                    begin, end = np.append(begin, begin_of(pos[done])), np.append(end, ends[done].astype(np.int64))
                    unsettled = ~done
                begin, end = merged(begin, end)
                own = {"doc_id": doc, "tag": tag, "spans": np.stack([begin, end], 1).ravel().tolist(), "rest": batch.column("rest").slice(at, 1)}
                if unsettled is None or not unsettled.any():
                    edges = [0, *own["spans"], len(text)]
                    kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                    out.append(own | {"kind": 0, "n_bytes": len(text), "n_removed": len(text) - len(kept), "kept_sha256": hashlib.sha256(kept).hexdigest(), "text": kept if keep_text else None})
                else:
                    out.append(own | {"kind": 1, "text": text})
                    b, p, k = bucket[unsettled].astype(np.int64), pos[unsettled], kind[unsettled]
                    small = k == OPEN
                    if small.any():
                        cut = [text[i : i + length + n] for i, n in zip(begin_of(p[small]).tolist(), extra_of(p[small]).tolist(), strict=True)]
                        yield batch_of([], kind=np.full(len(cut), 2, np.int32), bucket=b[small], doc_id=np.full(len(cut), doc), tag=np.full(len(cut), tag), pos=p[small], text=cut)
                    for b_, p_ in zip(b[~small].tolist(), p[~small].tolist(), strict=True):
                        i, n = begin_of(p_), extra_of(p_) + 1
                        context = np.frombuffer(text, np.uint8, length + n - 1, i)
                        s = np.arange(n)
                        for w, x in zip(windows, (np.full(n, b_), digests_of(context, s, s + length)[0], np.full(n, doc), np.full(n, tag), packed_pos(i + s, 0)), strict=True):
                            w.append(x)
                    if len(windows[0]) > 5000:
                        yield from settled_windows()
                if len(out) >= 500:
                    yield batch_of(out)
                    out = []
            if start < batch.num_rows:
                pending.append(batch.slice(start))
        if out:
            yield batch_of(out)
        if windows[0]:
            yield from settled_windows()

    both = left.unionByName(right).repartition("doc_id", "tag").sortWithinPartitions("doc_id", "tag", "kind", "pos")
    return map_arrow(both, run, schema)


def refine(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """Bucket-pointer refinement of the open contexts' suffixes; returns the windows that start earlier, as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def refined(group: pa.RecordBatch):
            texts = group.column("text").to_pylist()
            n_of = np.array([len(t) for t in texts])
            buf, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(n_of)
            row = np.repeat(np.arange(len(texts)), n_of)
            left = np.repeat(ends, n_of) - np.arange(len(buf))  # bytes from here to the context's end

            def numbered(where, keys):
                """Bucket numbers of positions, -1 for those alone in a bucket."""
                _, inverse, sizes = np.unique(keys, return_inverse=True, return_counts=True)
                rank = np.full(len(buf), -1, np.int64)
                rank[where] = np.where(sizes[inverse] > 1, inverse, -1)
                return rank

            width = min(8, length)
            where = np.flatnonzero(left >= width)
            keys = np.zeros(len(where), np.uint64)
            for k in range(width):
                keys = (keys << np.uint64(8)) | buf[where + k]
            rank = numbered(where, keys)
            while width < length:
                step = min(width, length - width)
                where = np.flatnonzero(rank >= 0)
                where = where[left[where] >= width + step]
                where = where[rank[where + step] >= 0]
                rank = numbered(where, rank[where] * len(buf) + rank[where + step])
                width += step
            where = np.flatnonzero(rank >= 0)
            if not len(where):
                return
            r = row[where]
            doc, tag, pos = (group.column(c).to_numpy()[r] for c in ("doc_id", "tag", "pos"))
            pos = packed_pos(begin_of(pos) + where - (ends - n_of)[r], 0)
            order, new = firsts(rank[where], rank[where], doc, tag, pos)
            later = np.sort(order[~same_place(new, doc[order], tag[order], pos[order])])
            for done in settled(doc[later], tag[later], begin_of(pos[later]), begin_of(pos[later]) + length):
                n = done.num_rows
                columns = [pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), *(done.column(c) for c in ("doc_id", "tag", "pos", "digest"))]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "doc_id", "tag", "pos", "end"])

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), batch.num_rows]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(start, stop - start)
                if held and size > block and held[-1].column("bucket")[0] != part.column("bucket")[0]:
                    yield from refined(pa.concat_batches(held))
                    held, size = [], 0
                held.append(part)
                size += sum(len(t) for t in part.column("text").to_pylist())
        if held:
            yield from refined(pa.concat_batches(held))

    return map_arrow(contexts.repartition("bucket").sortWithinPartitions("bucket"), run, "kind int, bucket long, doc_id long, tag long, pos long, end long")


def prepared(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Documents as the functions here take them: id, tag, bytes, no settled runs, columns to carry."""
    text, own = F.coalesce(F.col(text_col), F.lit("")).cast("binary"), long_id(df, id_col)
    shared = df.select(own.alias("shared")).where("shared is not null").groupBy("shared").count().where("count > 1").select("shared")
    shared = materialise(shared, "suffix-shared-ids")  # so that it is known to be small where it is
    rows = df.select(own.alias("doc_id"), text.alias("text"), *([F.struct(*(F.col(c) for c in keep)).alias("rest")] if keep else []))
    rows = rows.join(shared, F.col("doc_id") == F.col("shared"), "left")
    apart = F.col("doc_id").isNull() | F.col("shared").isNotNull()
    return rows.select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"),
        F.when(apart, F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("tag"),
        "text",
        F.array().cast("array<long>").alias("spans"),
        *(["rest"] if keep else []),
    )


def finished(rows: DataFrame, keep: tuple[str, ...], keep_text: bool) -> DataFrame:
    return rows.select(
        F.when(F.col("doc_id") != F.lit(NULL_ID), F.col("doc_id")).alias("doc_id"),
        "n_bytes", "n_removed", "spans", "kept_sha256", *([F.col("text").alias("kept")] if keep_text else []), *(F.col(f"rest.`{c}`").alias(c) for c in keep),
    )


def dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    q: int = Q,
    bucket_limit: int = BUCKET_LIMIT,
    block: int = BLOCK,
    keep: tuple[str, ...] = (),
    keep_text: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, spans`` (begins and ends in turn), ``kept_sha256``;
    with ``keep_text`` also ``kept`` (bytes), with ``keep`` those columns of the input."""
    if not 1 <= q <= length:
        raise ValueError("q must be from 1 to length")
    docs = prepared(df, id_col, text_col, keep)
    status = settle(make_contexts(docs.select("doc_id", "tag", "text"), length, q, block), length, bucket_limit, leave_open=True)
    found = materialise(to_documents(docs, status, length, keep_text), "suffix-documents")
    del status
    release(df.sparkSession)
    runs = refine(found.where("kind = 2").select("bucket", "doc_id", "tag", "pos", "text"), length, block).unionByName(
        settle(found.where("kind = 3").select(*NAMES), length, bucket_limit, leave_open=False)
    )
    rest = ["rest"] if keep else []
    ended = to_documents(found.where("kind = 1").select("doc_id", "tag", "text", "spans", *rest), runs, length, keep_text)
    return finished(found.where("kind = 0").unionByName(ended), keep, keep_text)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")

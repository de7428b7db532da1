"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Encoding explodes every text into pre-tokens with positions. Inside a task the pre-tokens of a *chunk*
(a bounded run of texts) are replaced by indices into the chunk's own word list, so what is shuffled
grows with distinct words and not with tokens:

1. one pass over the texts writes, to the shared folder, each text as a list of word indices (its
   positions) and each chunk's word list;
2. all word lists are shuffled by word (in buckets of words, packed and compressed); each distinct word is
   encoded once, where all its uses meet, and its ids go back to the chunks that use it;
3. texts and encoded words meet by chunk, and the ids are reassembled by position.

A frequent word is sent at most once per chunk, so no key is hot; the number of buckets follows the input's
size, so a bucket's words fit in a task. Decoding joins the token-byte
table, whose size is the vocabulary's and does not depend on the data: it is broadcast, as an array that ids index.

Defined results: a null or empty text has no ids and decodes to no bytes; bytes that aren't UTF-8 are read as U+FFFD; repeated
rows are encoded each for itself; a null id column value is carried through; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.shared import dealt, long_id, map_arrow, materialise, partitions_for, slices, texts

#: A chunk is closed when it reaches either bound; both keep a task's memory fixed.
CHUNK_TOKENS = 8_000_000
CHUNK_WORDS = 400_000
#: Bytes of text in a block, the unit that is packed.
BLOCK_BYTES = 16_000_000
#: Characters below this have a compiled class of their own in the fast splitter.
FAST_BELOW = 0x250


class Splitter:
    """Splits a text into pre-tokens by ``pattern``.

    The general pattern needs Unicode properties. Where ``fast`` is set (the pattern of GPT-2 style rank
    files) and a text has only characters below U+0250, the same alternatives are tried with the classes written out.
    """

    def __init__(self, pattern: str, fast: bool):
        import regex

        self.general = regex.compile(pattern).findall
        self.quick = None
        if fast:
            def chars(first: str) -> str:
                return "".join(re.escape(chr(c)) for c in range(FAST_BELOW) if unicodedata.category(chr(c))[0] == first)

            letter, number = chars("L"), chars("N")
            space = "".join(re.escape(chr(c)) for c in range(FAST_BELOW) if regex.match(r"\s", chr(c)))
            self.quick = re.compile(
                f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
            ).findall
            self.beyond = re.compile(f"[^\x00-{chr(FAST_BELOW - 1)}]").search

    def __call__(self, text: str) -> list[str]:
        if self.quick and not self.beyond(text):
            return self.quick(text)
        return self.general(text)


class WordList(dict):
    """word -> index in order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the multilingual public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def squeezed(data: bytes) -> bytes:
    """zstd with a window as large as a block, so that repeated texts and passages of a block cost little."""
    import zstandard

    parameters = zstandard.ZstdCompressionParameters.from_level(6, window_log=24, enable_ldm=True)
    return zstandard.ZstdCompressor(compression_params=parameters).compress(data)


def pack(values) -> bytes:
    """Whole numbers below 2**32 as four compressed byte planes; small and frequent numbers take about a byte."""
    import numpy as np

    planes = np.ascontiguousarray(np.asarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T)
    return len(planes[0]).to_bytes(4, "little") + squeezed(planes.tobytes())


def unpack(data: bytes):
    import numpy as np

    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def pack_ranks(ranks) -> bytes:
    """Numbers of which most are small: a compressed byte each, and those from 255 on in a list of their own."""
    import numpy as np

    small = squeezed(np.minimum(ranks, 255).astype(np.uint8).tobytes())
    return len(ranks).to_bytes(4, "little") + len(small).to_bytes(4, "little") + small + pack(ranks[ranks >= 255] - 255)


def unpack_ranks(data: bytes):
    import numpy as np

    n, end = int.from_bytes(data[:4], "little"), 8 + int.from_bytes(data[4:8], "little")
    ranks = np.frombuffer(pa.decompress(data[8:end], n, codec="zstd", asbytes=True) if n else b"", np.uint8).astype(np.int64)
    ranks[ranks == 255] += unpack(data[end:])
    return ranks


def split_chunks(df: DataFrame, pattern: str, fast: bool, buckets: int, chunk_tokens: int, chunk_words: int) -> DataFrame:
    """Rows of two kinds. Blocks of texts: (chunk, doc_ids, sizes, packed word indices). Parts of the chunk's
    word list: (chunk, bucket of the word's crc32, packed steps between indices, packed lengths, compressed words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        from pyspark import TaskContext

        split, part, number = Splitter(pattern, fast), TaskContext.get().partitionId(), 0
        words, tokens = WordList(), 0
        held: list[tuple] = []  # the chunk's blocks, until its words are counted

        def row(**given) -> pa.RecordBatch:
            given |= {"chunk": (part << 32) | number}
            return pa.RecordBatch.from_arrays([pa.array([given.get(f.name)], f.type) for f in SPLIT], schema=SPLIT)

        def closed() -> Iterator[pa.RecordBatch]:
            """The chunk's rows, words numbered by falling frequency."""
            count = np.bincount(np.concatenate([h[2] for h in held]), minlength=len(words))
            by_rank = np.argsort(-count, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[by_rank] = np.arange(len(words))
            for ids, sizes, at in held:
                yield row(doc_ids=ids, sizes=pack(sizes), packed=pack_ranks(rank[at]))
            whole = [w.encode() for w in words]
            bucket = np.fromiter(map(zlib.crc32, whole), np.int64, len(whole)) % buckets
            order = by_rank[np.argsort(bucket[by_rank], kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[start:stop]
                some = [whole[i] for i in at]
                yield row(bucket=int(bucket[at[0]]), at=pack(np.diff(rank[at], prepend=0)), sizes=pack([len(w) for w in some]), packed=squeezed(b"".join(some)))

        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                place, found = words.__getitem__, []
                for text in batch.column("text").to_pylist():
                    cut = split(text)
                    found.append(np.fromiter(map(place, cut), np.int32, len(cut)))
                sizes = [len(x) for x in found]
                tokens += sum(sizes)
                held.append((batch.column("doc_id").to_pylist(), sizes, np.concatenate(found)))
                if tokens >= chunk_tokens or len(words) >= chunk_words:
                    yield from closed()
                    words, tokens, number, held = WordList(), 0, number + 1, []
        if held:
            yield from closed()

    return map_arrow(df, run, "chunk long, bucket int, doc_ids array<bigint>, at binary, sizes binary, packed binary")


SPLIT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("at", pa.binary()), ("sizes", pa.binary()), ("packed", pa.binary())])


def encode_words(words: DataFrame, ranks_file, pattern: str, partitions: int) -> DataFrame:
    """Word lists -> (chunk, at, sizes and packed ids). All uses of a word meet in its bucket, which encodes it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import tiktoken

        piece = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_file.value), special_tokens={})._encode_single_piece

        class Encoded(dict):
            def __missing__(self, word: bytes) -> list[int]:
                self[word] = ids = piece(word)
                return ids

        bucket, known = None, Encoded()
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    bucket, known = r["bucket"], Encoded()
                ends = np.cumsum(unpack(r["sizes"])).tolist()
                data = pa.decompress(r["packed"], ends[-1], codec="zstd", asbytes=True)
                ids = [known[data[i:j]] for i, j in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["chunk"]]), pa.array([r["at"]]), pa.array([pack([len(x) for x in ids])]), pa.array([pack([i for x in ids for i in x])])],
                    names=["chunk", "at", "sizes", "packed"],
                )

    return map_arrow(dealt(words, partitions, "bucket").sortWithinPartitions("bucket"), run, "chunk long, at binary, sizes binary, packed binary")


def reassemble(docs: DataFrame, words: DataFrame, partitions: int) -> DataFrame:
    """Puts the words' ids back at their positions; both inputs meet by chunk, the word list first."""
    both = docs.select("chunk", F.lit(1).alias("kind"), "doc_ids", F.lit(None).cast("binary").alias("at"), "sizes", "packed").unionByName(
        words.select("chunk", F.lit(0).alias("kind"), F.lit(None).cast("array<bigint>").alias("doc_ids"), "at", "sizes", "packed")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        chunk, parts, begins, sizes, flat = None, [], None, None, None

        def ids_of(at):
            n = sizes[at]
            out = np.concatenate([[0], np.cumsum(n)])
            return flat[np.repeat(begins[at] - out[:-1], n) + np.arange(out[-1])], out

        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if r["chunk"] != chunk:
                    chunk, parts, begins = r["chunk"], [], None
                if not r["kind"]:
                    parts.append((np.cumsum(unpack(r["at"])), unpack(r["sizes"]), unpack(r["packed"]).astype(np.int32)))
                    continue
                if begins is None:
                    at, n = (np.concatenate([p[k] for p in parts] or [np.empty(0, np.int64)]) for k in (0, 1))
                    flat = np.concatenate([p[2] for p in parts] or [np.empty(0, np.int32)])
                    begins, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    begins[at], sizes[at], parts = np.cumsum(n) - n, n, []
                at, edge = unpack_ranks(r["packed"]), np.concatenate([[0], np.cumsum(unpack(r["sizes"]))])
                first = 0
                while first < len(r["doc_ids"]):
                    last = max(first + 1, int(np.searchsorted(edge, edge[first] + 500_000, side="right")) - 1)
                    ids, out = ids_of(at[edge[first] : edge[last]])
                    ends = out[edge[first : last + 1] - edge[first]]
                    yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"][first:last], pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])
                    first = last

    return map_arrow(dealt(both, partitions, "chunk").sortWithinPartitions("chunk", "kind"), run, "doc_id long, ids array<int>")


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    pattern: str | None = None,
    chunk_tokens: int = CHUNK_TOKENS,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """``doc_id, ids array<int>``, one row per input row. ``vocabulary`` is a rank file on the driver;
    ids are those that the tiktoken library gives without special tokens."""
    own_path, own_pattern = default_vocabulary()
    with open(vocabulary or own_path, "rb") as file:
        ranks_file = df.sparkSession.sparkContext.broadcast(file.read())
    pattern, fast = pattern or own_pattern, pattern in (None, own_pattern)
    rows = texts(df, id_col, text_col).withColumn("doc_id", long_id(df, id_col))
    partitions = partitions_for(rows)
    split = materialise(split_chunks(rows, pattern, fast, 4 * partitions, chunk_tokens, chunk_words), "bpe-chunks")
    words = encode_words(split.where(F.col("bucket").isNotNull()).drop("doc_ids"), ranks_file, pattern, partitions)
    return reassemble(split.where(F.col("bucket").isNull()), words, partitions)


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Adds ``decoded binary``: the bytes of the ids, joined from the token-byte table. Ids outside the table raise."""
    with open(vocabulary or default_vocabulary()[0], "rb") as file:
        ranks_file = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        ranks = read_ranks(ranks_file.value)
        table = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        table = pa.array(table, pa.binary())
        for whole in batches:
            for batch in slices(whole, ids_col, 1_000_000):
                lists = pc.fill_null(batch.column(ids_col), pa.scalar([], pa.list_(pa.int32())))
                edges = pa.array([0, *pc.cumulative_sum(lists.value_lengths()).to_pylist()], pa.int32())
                tokens = pa.ListArray.from_arrays(edges, table.take(lists.flatten()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pc.binary_join(tokens, b"")], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, run, f"{fields}, decoded binary")


def digests(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what encode and decode returned, with ``keep_ids`` also ``ids``."""
    return decoded.select(
        "doc_id",
        *(["ids"] if keep_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

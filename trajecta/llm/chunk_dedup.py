"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash rolls over each text's bytes; a chunk ends where the hash is the least within ``reach``
positions on either side, but not within ``reach`` of the text's ends, so that no chunk is shorter unless the text is.
The cut depends on nearby bytes only, so an insertion moves no cut further away. Where no
cut falls for ``LARGEST`` bytes, bytes repeat with a short period; there a chunk ends at the first tied minimum after that
many bytes, so chunks of such a run are alike wherever it starts.
Chunks are deduplicated by a 128-bit digest: every chunk but its first occurrence (smallest id, then
offset) is removed. Repeats of what a task has sent lately are settled before the shuffle, so a hot chunk costs about a
row per task.

Defined results: a null text counts as empty and loses nothing; ids and rows without an id of their own are as in
``suffix_dedup``; repeated rows (same id and text) are one document and get the same result each. Other columns can be carried along with ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import suffix_dedup
from trajecta.llm.hashing import digests, sliding_minimum
from trajecta.llm.shared import map_arrow, slices

#: Chunks hold more bytes than this, twice as many on average; a larger one leaves more chance repeats alone and catches less of each passage.
REACH = 48
LARGEST = 4096
BLOCK = 1_000_000
GEAR = 32


def cuts(buf: np.ndarray, inside: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that a chunk ends before, and those of tied minima. ``inside`` is False in the gaps between texts, which are at least reach + GEAR long."""
    table = np.random.default_rng(7).integers(0, 2**32, 256, np.uint32)
    h = np.where(inside, table[buf], np.uint32(0))
    width = 1
    while width < GEAR:  # h[i] sums the last GEAR bytes' gears, each shifted by its age
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    h = np.where(inside, h, np.uint32(0))  # no cut falls within reach of a text's ends
    least = sliding_minimum(h, reach)
    before, after, own = least[: len(h) - 2 * reach], least[reach + 1 :], h[reach : len(h) - reach]
    tied = (own <= before) & (own <= after) & inside[reach : len(h) - reach]
    return np.flatnonzero(tied & (own < before)) + reach, np.flatnonzero(tied) + reach


def chunks(found: list[bytes], reach: int) -> tuple[np.ndarray, ...]:
    """(text number, start, size, two digests) of all chunks."""
    gap = b"\0" * (reach + GEAR)
    sizes = np.array([len(t) for t in found], np.int64)
    buf = np.frombuffer(gap + gap.join(found) + gap, np.uint8)
    begin = len(gap) + np.cumsum(sizes + len(gap)) - sizes - len(gap)
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + sizes, -1)
    cut, tied = cuts(buf, np.cumsum(inside[:-1]) > 0, reach)
    text = np.searchsorted(begin, cut, side="right") - 1
    some = np.flatnonzero(sizes)
    start = np.unique(np.concatenate([begin[some], cut[cut > begin[text]]]))
    # zero-sized texts share no position with others, as gaps are longer than 0
    end_of = lambda start: np.minimum(np.append(start[1:], len(buf)), (begin + sizes)[np.searchsorted(begin, start, side="right") - 1])
    more = []
    for a, z in zip(*(x[end_of(start) - start > LARGEST] for x in (start, end_of(start))), strict=True):
        near = tied[np.searchsorted(tied, a) : np.searchsorted(tied, z)]
        while (k := np.searchsorted(near, a + LARGEST)) < len(near):
            more.append(a := int(near[k]))
    start = np.unique(np.concatenate([start, np.array(more, np.int64)]))
    stop, text = end_of(start), np.searchsorted(begin, start, side="right") - 1
    return text, start - begin[text], stop - start, *digests(buf, start, stop, 2)


def make_chunks(df: DataFrame, reach: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = suffix_dedup.Recent()
        for whole in batches:
            for batch in slices(whole, "text", block):
                text, start, size, one, two = chunks(batch.column("text").to_pylist(), reach)
                doc, tag = batch.column("doc_id").to_numpy()[text], batch.column("tag").to_numpy()[text]
                yield from suffix_dedup.sent(recent, one, two, doc, tag, suffix_dedup.packed_pos(start, size), start + size)

    return map_arrow(df, run, suffix_dedup.ROWS)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, block: int = BLOCK, keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, spans`` (begins and ends in turn), ``kept_sha256``;
    with ``keep_text`` also ``kept`` (bytes), with ``keep`` those columns of the input."""
    docs = suffix_dedup.prepared(df, id_col, text_col, keep)
    runs = suffix_dedup.settle(make_chunks(docs.select("doc_id", "tag", "text"), reach, block), 0, 0, leave_open=False)
    return suffix_dedup.finished(suffix_dedup.to_documents(docs, runs, 0, keep_text), keep, keep_text)

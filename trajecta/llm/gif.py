"""GIF as a media column: encoding, decoding, composition of timed frames and colour histograms.

The decoder reads any GIF87a or GIF89a stream: global and local palettes, LZW code streams with early
clears and full tables, interlaced images, graphic control extensions with delay, transparency and
disposal (keep, restore to background, restore to previous). Frames are composed on the logical screen.

``encode_samples`` stores bytes losslessly as 8-bit samples: palette entry i is grey level i, a row of the
image has WIDTH samples, and long payloads become several frames of at most ``FRAME_ROWS`` rows.

Defined results: a null text is an empty one; a media value that is null gives null columns; a damaged
one raises ValueError; a stream cut short inside an image fills the missing samples with index 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.shared import map_arrow, slices

WIDTH = 64
FRAME_ROWS = 1024
#: Hundredths of a second that a frame of stored samples is shown.
DELAY = 4
#: Bins of a channel's histogram.
BINS = 8
GREY = bytes(level for level in range(256) for _ in range(3))
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3


@dataclass
class Frame:
    """An image of the stream, and the logical screen when it is shown."""

    delay_ms: int
    disposal: int
    left: int
    top: int
    indices: np.ndarray  # height x width palette indices, as stored
    screen: np.ndarray  # height x width x RGBA


def code_widths(n: int, minimum: int) -> np.ndarray:
    """Bits of the codes after a clear code: they grow when the table's next entry needs them, up to 12."""
    return np.minimum(12, np.floor(np.log2(np.maximum(np.arange(n) + (1 << minimum) + 1, 1))).astype(np.int64) + 1)


#: Widths of all codes of a full 8-bit table, and where each one's bits begin.
MOST_CODES = 4096
WIDTHS = {m: code_widths(MOST_CODES, m) for m in range(2, 9)}
STARTS = {m: np.concatenate([[0], np.cumsum(w)]) for m, w in WIDTHS.items()}


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Bit string, least significant bit first."""
    start = np.cumsum(widths) - widths
    size = int(start[-1] + widths[-1] + 7) // 8 if len(codes) else 0
    out = np.zeros(size + 3, np.uint8)
    value = codes.astype(np.uint32) << (start & 7).astype(np.uint32)
    for k in range(3):
        # codes whose bits begin in one byte differ in place, so their sum is their union
        out[: size + 3] |= np.bincount((start >> 3) + k, (value >> np.uint32(8 * k)) & 255, size + 3).astype(np.int64).astype(np.uint8)
    return out[:size].tobytes()


def lzw_encode(data: bytes) -> bytes:
    """LZW code stream of 8-bit samples; the table is cleared when it is full."""
    clear, end, most = 256, 257, 4095
    codes, lengths = [clear], []
    put, table, following = codes.append, {}, 258
    samples = iter(data)
    prefix = next(samples, None)
    for sample in samples:
        key = prefix << 8 | sample
        if key in table:
            prefix = table[key]
        else:
            put(prefix)
            prefix, table[key] = sample, following
            following += 1
            if following == most:
                put(clear)
                lengths.append(following - 258)
                table, following = {}, 258
    if prefix is not None:
        put(prefix)
        following += 1
    lengths.append(following - 258)
    put(end)
    # a clear or end code has the width that the segment's next code would have
    return pack_codes(np.array(codes), np.concatenate([[9], *(WIDTHS[8][: n + 1] for n in lengths)]))


def lzw_decode(data: bytes, minimum: int, size: int) -> np.ndarray:
    """``size`` samples of a code stream; what a short stream lacks is 0."""
    if not 2 <= minimum <= 8:
        raise ValueError(f"LZW code size {minimum}")
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    bits, at, clear, end = len(data) * 8, 0, 1 << minimum, (1 << minimum) + 1
    literals = [bytes([k]) for k in range(clear)]
    starts, widths = STARTS[minimum], WIDTHS[minimum]
    out: list[bytes] = []
    held, done = 0, False
    while not done and at < bits and held < size:
        # Codes up to the next clear code. Widths depend on the number of codes since the last one only.
        n, table, first, tail = 0, [*literals, b"", b""], True, False
        while not tail:
            lo, hi = n, min(n + 1024, MOST_CODES)
            if n < MOST_CODES:
                begin, wide = at + starts[lo:hi], widths[lo:hi]
            else:
                begin, wide = at + starts[MOST_CODES] + 12 * (n - MOST_CODES + np.arange(1024)), np.full(1024, 12)
            inside = begin + wide <= bits
            begin, wide = begin[inside], wide[inside]
            byte = begin >> 3
            value = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
            codes = (value >> (begin & 7).astype(np.uint32)) & ((1 << wide.astype(np.uint32)) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            taken = int(stop[0]) if len(stop) else len(codes)
            some = codes[:taken].tolist()
            if first and some:
                if some[0] >= clear:
                    raise ValueError("LZW stream begins with a code that isn't in the table")
                before = literals[some[0]]
                out.append(before)
                held += 1
                first, some = False, some[1:]
            # entries past 4096 can't be named by a code, so that the table is full needs no test
            before_chunk, known, add, grow = len(out), len(table), out.append, table.append
            for code in some:
                if code < known:
                    entry = table[code]
                    grow(before + entry[:1])
                elif code == known:
                    entry = before + before[:1]
                    grow(entry)
                else:
                    raise ValueError("LZW code beyond the table")
                known += 1
                add(entry)
                before = entry
            held += sum(map(len, out[before_chunk:]))
            if len(stop):
                done = codes[taken] == end
                at, tail = int(begin[taken] + wide[taken]), True
            elif taken < len(inside) or held >= size:
                done = tail = True
            n += taken
    found = b"".join(out)[:size]
    return np.frombuffer(found + b"\0" * (size - len(found)), np.uint8)


def blocks_of(data: bytes) -> bytes:
    """Data in sub-blocks of up to 255 bytes, with the terminator."""
    parts = []
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        parts += [bytes([len(part)]), part]
    return b"".join(parts) + b"\0"


def encode_samples(payload: bytes, delay: int = DELAY) -> bytes:
    """An animation whose frames hold the payload, a positive multiple of WIDTH bytes."""
    rows = len(payload) // WIDTH
    if not rows or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of the row width")
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", KEEP << 2, delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", blocks_of(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """(width, height, frames) of a GIF stream."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(n: int) -> np.ndarray:
        """256 colours, each an RGBA quadruple read as one number."""
        nonlocal at
        colours = np.full((256, 4), 255, np.uint8)
        colours[:, :3] = 0
        colours[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return colours.view(np.uint32).ravel()

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    try:
        general = palette(2 << (flags & 7)) if flags & 0x80 else None
        screen, frames = np.zeros((height, width), np.uint32), []
        delay, disposal, transparent = 0, 0, None
        while (kind := data[at]) != 0x3B:
            at += 1
            if kind == 0x21:
                label, at = data[at], at + 1
                content = sub_blocks()
                if label == 0xF9:
                    disposal, delay = content[0] >> 2 & 7, int.from_bytes(content[1:3], "little")
                    transparent = content[3] if content[0] & 1 else None
                continue
            if kind != 0x2C:
                raise ValueError(f"unknown block {kind:#x}")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette(2 << (flags & 7)) if flags & 0x80 else general
            if colours is None:
                raise ValueError("an image without a palette")
            minimum, at = data[at], at + 1
            indices = lzw_decode(sub_blocks(), minimum, w * h).reshape(h, w)
            if flags & 0x40:
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
                straight = np.empty_like(indices)
                straight[order] = indices
                indices = straight
            before = screen.copy() if disposal == PREVIOUS else None
            seen_h, seen_w = max(0, min(h, height - top)), max(0, min(w, width - left))
            shown = indices[:seen_h, :seen_w]
            place = screen[top : top + seen_h, left : left + seen_w]
            if transparent is None:
                place[...] = colours[shown]
            else:
                place[...] = np.where(shown != transparent, colours[shown], place)
            frames.append(Frame(10 * delay, disposal, left, top, indices, screen.copy().view(np.uint8).reshape(height, width, 4)))
            if disposal == BACKGROUND:
                place[...] = 0
            elif before is not None:
                screen = before
            delay, disposal, transparent = 0, 0, None
    except (IndexError, struct.error, ValueError) as e:
        raise ValueError(f"damaged GIF: {e}") from e
    return width, height, frames


def histogram(frame: Frame) -> list[int]:
    """Counts of the visible screen's samples, BINS for each of red, green and blue."""
    flat = frame.screen.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    return [c for channel in range(3) for c in np.bincount(flat[:, channel], minlength=256).reshape(BINS, -1).sum(1).tolist()]


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's bytes, padded with 0 to a positive multiple of WIDTH, as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                found = batch.column("text").to_pylist()
                media = [encode_samples(t + b"\0" * (-len(t) % WIDTH or WIDTH * (not t))) for t in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in found], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


FRAME_TYPE = "array<struct<number: int, delay_ms: int, disposal: int, width: int, height: int, histogram: array<bigint>>>"


def read(df: DataFrame, media_col: str = "media", samples: bool = False) -> DataFrame:
    """Replaces the media column by ``media_bytes, media_sha256, frames``, and the digests of the stored samples
    (all images' indices in order): ``payload_bytes, payload_sha256, tail_crc32``. With ``samples`` also ``samples``, the bytes."""
    others = [c for c in df.columns if c != media_col]
    frame_type = pa.list_(pa.struct([("number", pa.int32()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
    made = {"media_bytes": pa.int64(), "media_sha256": pa.string(), "frames": frame_type, "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64()} | ({"samples": pa.binary()} if samples else {})

    def row(media: bytes | None) -> dict:
        if media is None:
            return {}
        _, _, frames = decode(media)
        payload = b"".join(f.indices.tobytes() for f in frames)
        return {
            "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-64:]), "samples": payload,
            "frames": [{"number": i, "delay_ms": f.delay_ms, "disposal": f.disposal, "width": f.indices.shape[1], "height": f.indices.shape[0], "histogram": histogram(f)} for i, f in enumerate(frames)],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, media_col, 2_000_000):
                rows = [row(m) for m in batch.column(media_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array([r.get(k) for r in rows], t) for k, t in made.items())], names=[*others, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != media_col]
    kinds = {"media_bytes": "long", "media_sha256": "string", "frames": FRAME_TYPE, "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "samples": "binary"}
    return map_arrow(df, run, ", ".join([*fields, *(f"{k} {kinds[k]}" for k in made)]))


def digests(stored: DataFrame) -> DataFrame:
    """Query columns of what ``store`` and ``read`` returned; ``feature`` sums up frames, time and the red channel's histogram."""
    red = [F.expr(f"aggregate(frames, 0L, (s, f) -> s + f.histogram[{k}])") for k in range(BINS)]
    feature = F.concat_ws(
        ";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("ms="), F.expr("aggregate(frames, 0, (s, f) -> s + f.delay_ms)")), F.concat(F.lit("hist="), F.concat_ws(",", *(c.cast("string") for c in red)))
    )
    return read(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))

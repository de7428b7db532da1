import hashlib
import struct
import zlib

import numpy as np
import pytest

from trajecta.llm import gif


def by_hand(data: bytes, minimum: int, clear_every: int) -> bytes:
    """A code stream written bit by bit, with the plain rules of the format and early clears."""
    clear, end = 1 << minimum, (1 << minimum) + 1
    bits, width, table = [], minimum + 1, {}

    def put(code):
        bits.extend(code >> k & 1 for k in range(width))

    def fresh():
        return {bytes([k]): k for k in range(clear)}

    put(clear)
    table, following, prefix, since = fresh(), end + 1, b"", 0
    for byte in data:
        if prefix + bytes([byte]) in table:
            prefix += bytes([byte])
            continue
        put(table[prefix])
        since += 1
        if following < 4096:
            table[prefix + bytes([byte])] = following
            following += 1
            # the decoder is an entry behind: it widens when the entry before this one fills the width
            if following - 1 == 1 << width and width < 12:
                width += 1
        prefix = bytes([byte])
        if since == clear_every:
            put(clear)
            table, following, width, since = fresh(), end + 1, minimum + 1, 0
    put(table[prefix])
    following += 1
    if following - 1 == 1 << width and width < 12:
        width += 1
    put(end)
    bits += [0] * (-len(bits) % 8)
    return bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("minimum,clear_every", [(8, 10**9), (8, 300), (2, 10**9), (5, 40)])
def test_decodes_streams_written_by_the_rules(minimum, clear_every):
    rng = np.random.default_rng(minimum)
    for n in (1, 2, 300, 3000, 40_000):
        data = (rng.integers(0, 1 << minimum, n) * rng.integers(0, 2, n)).astype(np.uint8).tobytes()
        assert gif.lzw_decode(by_hand(data, minimum, clear_every), minimum, n).tobytes() == data


def test_encoder_writes_the_same_stream():
    rng = np.random.default_rng(0)
    for n in (1, 255, 256, 257, 258, 3000):
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert gif.lzw_encode(data) == by_hand(data, 8, 10**9)
    long = rng.integers(0, 40, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(long), 8, len(long)).tobytes() == long


def animation(images, palette, size=(3, 2), background=0):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x80 | 1, background, 0), bytes(palette)]
    for delay, disposal, transparent, (left, top, w, h), flags, local, pixels in images:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + bytes(local) + b"\x02" + gif.blocks_of(by_hand(bytes(pixels), 2, 10**9)))
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_palettes_and_interlace():
    red, green, blue, grey = (255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9)
    palette = [x for c in (red, green, blue, grey) for x in c]
    swapped = [x for c in (green, red, grey, blue) for x in c]
    data = animation(
        [
            (5, gif.KEEP, None, (0, 0, 3, 2), 0, [], [0] * 6),
            (7, gif.PREVIOUS, 1, (1, 0, 2, 1), 0, [], [2, 1]),
            (0, gif.BACKGROUND, None, (0, 1, 1, 1), 0x81, swapped, [0]),
            (1, gif.KEEP, None, (2, 1, 4, 4), 0x40, [], list(range(4)) * 4),
        ],
        palette,
    )
    width, height, frames = gif.decode(data)
    seen = lambda f: [[tuple(int(x) for x in p[:3]) if p[3] else None for p in row] for row in f.screen]
    assert (width, height, [f.delay_ms for f in frames]) == (3, 2, [50, 70, 0, 10])
    assert seen(frames[0]) == [[red] * 3] * 2
    assert seen(frames[1]) == [[red, blue, red], [red] * 3]
    assert seen(frames[2]) == [[red] * 3, [green, red, red]]
    assert seen(frames[3]) == [[red] * 3, [None, red, red]]
    tall = animation([(0, 0, None, (0, 0, 1, 8), 0x40, [], [0, 1, 2, 2, 3, 3, 3, 3])], palette, (1, 8))
    assert gif.decode(tall)[2][0].indices.ravel().tolist() == [0, 3, 2, 3, 1, 3, 2, 3]
    assert sum(gif.histogram(frames[0])[:8]) == 6


def test_damaged_streams_raise():
    good = gif.encode_samples(b"x" * 640)
    for bad in (b"", b"PNG", good[:20], good[:-1], good[:13] + good[13 + 768 :]):
        with pytest.raises(ValueError):
            gif.decode(bad)


def test_query_columns(spark, monkeypatch):
    given = [None, "", "é" * 40, "a" * 64, "word " * 30_000, "a" * 64]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(given)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in gif.digests(gif.store(df.repartition(2))).collect()}
    for i, t in enumerate(given):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = gif.encode_samples(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[0][1:] == got[1][1:] and got[3][1:] == got[5][1:]
    assert got[4].feature.startswith("frames=3;ms=120;hist=") and sum(map(int, got[4].feature.split("=")[-1].split(","))) >= len(given[4])
    assert gif.digests(gif.store(df.limit(0))).count() == 0
    stored = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert gif.read(stored).first().frames is None

from __future__ import annotations

import hashlib
import zlib

import numpy as np

from shelfmark.llm import media
from shelfmark.llm.media import UNIT, describe, encode, frames_of, store_texts, thumbnails

TEXTS = ["", None, "a", "b" * 576, "c" * 577, "é" * 5000, "\0ÿ" * 300, "xyz " * 60_000, "b" * 576]


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def test_round_trip(frame):
    rows = {r.doc_id: r for r in store_texts(frame(list(enumerate(TEXTS))), keep_media=True).collect()}
    for k, text in enumerate(TEXTS):
        want, r = padded(text), rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert b"".join(g.tobytes() for g, _, _ in thumbnails([bytes(r.media)])[0]) == want
    assert rows[3].feature == rows[8].feature and rows[3].media_sha256 == rows[8].media_sha256
    assert len({rows[k].feature for k in (0, 4, 6, 7)}) > 1


def test_empty_table(frame):
    assert store_texts(frame([])).collect() == []


def test_random_bytes_and_large_payloads():
    rng = np.random.default_rng(0)
    sizes = [UNIT, 5 * UNIT, 333 * UNIT, 340 * UNIT]
    data = rng.integers(0, 256, sum(sizes)).astype(np.uint8)
    files, at = encode(data, sizes), 0
    for images, n in zip(thumbnails(files), sizes, strict=True):
        assert b"".join(g.tobytes() for g, _, _ in images) == data[at : at + n].tobytes()
        at += n
    assert frames_of(media.ACROSS * media.ROWS + UNIT) == [media.ACROSS * media.ROWS, UNIT]


def coded(symbols):
    """Bits as bytes, padded by ones, stuffed."""
    bits = "".join(symbols)
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def test_colour_image_with_ac_coefficients():
    """Three components, the first of 2 x 2 blocks; AC codes run along, and only luminance DC counts."""
    dc, ac = media.codes(media.DC_COUNTS, media.DC_SYMBOLS), {0x00: "0", 0x11: "10", 0xF0: "110"}
    ac_counts, ac_symbols = [1, 1, 1] + [0] * 13, [0x00, 0x11, 0xF0]

    def value(v):
        size = abs(v).bit_length()
        code, length = dc[size]
        return f"{code:0{length}b}" + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    rng, luma, last, bits = np.random.default_rng(3), [], [0, 0, 0], []
    for _ in range(6):
        for c in (0, 0, 0, 0, 1, 2):
            v = int(rng.integers(-100, 100))
            bits += [value(v - last[c]), *(["10", "1", "110"] if rng.random() < 0.5 else []), "0"]
            last[c] = v
            if c == 0:
                luma.append(v)
    quant = bytes([0, 8] + [1] * 63)
    frame = bytes([8]) + (32).to_bytes(2, "big") + (48).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = bytes([0x00, *media.DC_COUNTS, *media.DC_SYMBOLS, 0x10, *ac_counts, *ac_symbols])
    s = media.segment
    file = b"\xff\xd8" + s(0xDB, quant) + s(0xC0, frame) + s(0xC4, tables) + s(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + coded(bits) + b"\xff\xd9"
    (grid, width, height), = thumbnails([file])[0]
    want = np.zeros((4, 6), int)
    for m in range(6):
        for k in range(4):
            want[2 * (m // 3) + k // 2, 2 * (m % 3) + k % 2] = luma[4 * m + k]
    assert (width, height) == (48, 32)
    assert (grid == np.clip(want + 128, 0, 255)).all()


def test_broken_files_give_nulls(spark):
    good = encode(np.arange(UNIT).astype(np.uint8), [UNIT])[0]
    rows = [(1, good), (2, good[:200]), (3, b"GIF89a"), (4, b""), (5, None), (6, good.replace(b"\xff\xc0", b"\xff\xc2"))]
    got = {r.id: (r.width, r.height, r.thumbnail_hash) for r in describe(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert got[1][:2] == (192, 192) and got[1][2]
    assert all(got[k] == (None, None, None) for k in (2, 3, 4, 5, 6))

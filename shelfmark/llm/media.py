"""Baseline JPEG media: encoding bytes as images, and DC-only luminance thumbnails of any baseline image.

A payload is stored losslessly as the quantised DC coefficients of a grey image: each byte is one flat block of 8 x 8
pixels, so the DC-only thumbnail is the payload itself. Blocks come in restart intervals, which makes them independent:
the decoder walks all intervals of a batch of images in lockstep, one Huffman symbol a step, in numpy. It parses the
markers of any baseline file (several components, subsampling, AC coefficients, with or without restarts) and keeps the
luminance DC coefficients, from which come the thumbnail and its hash.

Files that are cut off, not baseline, or otherwise broken give a null thumbnail, not an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import blocks

#: Payloads are padded to a multiple of this, the area of the smallest image in blocks.
UNIT = 576
#: Blocks in a restart interval.
INTERVAL = 96
#: Blocks across an image, and the most rows of blocks that one has here; a longer payload takes several images.
ACROSS, ROWS = 24, 8000

# The standard luminance DC code of baseline JPEG (how many codes of each length, then the symbols), and
# an AC code whose only symbol is end of block.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
AC_COUNTS = [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
AC_SYMBOLS = [0]


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits ahead: 256 * length of the code they start with + its symbol; 0 where there is none."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in codes(counts, symbols).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = 256 * length + symbol
    return out


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(across: int, down: int) -> bytes:
    quant = bytes([0, 8]) + bytes([1] * 63)
    frame = bytes([8]) + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    tables = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]) + bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])
    jfif = b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])
    return b"\xff\xd8" + segment(0xE0, jfif) + segment(0xDB, quant) + segment(0xC0, frame) + segment(0xC4, tables) + segment(0xDD, INTERVAL.to_bytes(2, "big")) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


_DC = codes(DC_COUNTS, DC_SYMBOLS)
_DC_CODE = np.array([_DC[k][0] for k in range(9)], np.int64)
_DC_LENGTH = np.array([_DC[k][1] for k in range(9)], np.int64)
_BITS = np.array([k.bit_length() for k in range(256)], np.int64)


def entropy_coded(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of samples (a multiple of INTERVAL) and where each interval ends; a restart marker's place (two
    bytes, 0xFF first) follows each interval."""
    diff = samples.reshape(-1, INTERVAL).astype(np.int64)
    diff[:, 0] -= 128
    diff[:, 1:] -= samples.reshape(-1, INTERVAL)[:, :-1]
    rows = len(diff)
    size = _BITS[np.abs(diff)]
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = _DC_LENGTH[size] + size + 1  # the end-of-block code is one zero bit
    value = ((_DC_CODE[size] << size) | value) << 1
    end = np.cumsum(length, axis=1)
    bytes_of = (end[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(bytes_of)])
    bit = end - length + 8 * base[:-1, None]
    word = (value << (24 - length - (bit & 7))).ravel()
    at = (bit >> 3).ravel()
    n = int(base[-1])
    out = np.bincount(at, word >> 16, n + 2) + np.bincount(at + 1, (word >> 8) & 255, n + 2) + np.bincount(at + 2, word & 255, n + 2)
    out = out[:n].astype(np.int64)
    spare = 8 * bytes_of - end[:, -1]
    out[base[1:] - 1] += (1 << spare) - 1
    stuffed = out == 255
    shift = np.cumsum(stuffed) - stuffed
    interval = np.repeat(np.arange(rows), bytes_of)
    place = np.arange(n) + shift + 2 * interval
    coded = np.zeros(n + int(stuffed.sum()) + 2 * rows, np.uint8)
    coded[place] = out
    last = base[1:] - 1
    ends = place[last] + 1 + stuffed[last]
    coded[ends] = 255
    return coded, ends


def frames_of(n: int) -> list[int]:
    """Sizes of the images that hold n bytes."""
    most = ACROSS * ROWS
    return [most] * ((n - 1) // most) + [(n - 1) % most + 1]


def encode(payload: np.ndarray, sizes: list[int]) -> list[bytes]:
    """The media of payloads that lie one behind the other; each size a positive multiple of UNIT."""
    coded, ends = entropy_coded(payload)
    out, k, begin = [], 0, 0
    for size in sizes:
        files = []
        for part in frames_of(size):
            n = part // INTERVAL
            coded[ends[k : k + n] + 1] = 0xD0 + np.arange(n) % 8
            coded[ends[k + n - 1] + 1] = 0xD9
            finish = int(ends[k + n - 1]) + 2
            files.append(header(ACROSS, part // ACROSS) + coded[begin:finish].tobytes())
            k, begin = k + n, finish
        out.append(b"".join(files))
    return out


class Broken(ValueError):
    """Not a whole baseline file."""


def parse(data: bytes, at: int = 0) -> dict:
    """Markers of the image that starts at `at`, up to its scan."""
    if data[at : at + 2] != b"\xff\xd8":
        raise Broken("no start of image")
    out: dict = {"dc": {}, "ac": {}, "quant": {}, "restart": 0}
    at += 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise Broken("no marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise Broken("cut off")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # only the DC step counts
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                out["ac" if body[0] >> 4 else "dc"][body[0] & 15] = (tuple(counts), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xC0:
            out["height"], out["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Broken("not baseline")
        elif marker == 0xDA:
            if "parts" not in out or len(out["parts"]) != body[0]:
                raise Broken("scan without all components")
            out["scan"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            out["from"] = at
            return out


def layout(image: dict) -> list[tuple[int, int, int]]:
    """(component, DC table, AC table) of each block of an MCU."""
    parts = image["parts"]
    return [(k, *image["scan"][name]) for k, (name, h, v, _) in enumerate(parts) for _ in range(1 if len(parts) == 1 else h * v)]


def walk(data: np.ndarray, begin: np.ndarray, blocks_in: np.ndarray, mcu: list[tuple[int, int, int]], dc: dict, ac: dict) -> list[np.ndarray]:
    """The first component's DC coefficients of each interval, decoded in lockstep.

    data: unstuffed bytes, with some bytes to spare; begin: each interval's first byte; blocks_in: its number of blocks.
    """
    tables = np.stack([lookup(*dc[d]) for _, d, _ in mcu] + [lookup(*ac[a]) for _, _, a in mcu])
    parts = 1 + max(c for c, _, _ in mcu)
    component = np.array([c for c, _, _ in mcu])
    lanes = len(begin)
    most = int(blocks_in.max())
    out = np.zeros((most, lanes), np.int32)
    kept = np.zeros(lanes, np.int64)
    predicted = np.zeros((parts, lanes), np.int64)
    live = np.arange(lanes)
    bit, block, k = begin.astype(np.int64) * 8, np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    wide = data.astype(np.int64)
    wide = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    single = len(mcu) == 1
    while len(live):
        at = np.minimum(bit >> 3, len(wide) - 1)
        ahead = (wide[at] << (bit & 7)) & 0xFFFFFFFF
        slot = 0 if single else block % len(mcu)
        entry = tables[slot + np.where(k == 0, 0, len(mcu)), ahead >> 16]
        length, symbol = entry >> 8, (entry & 255).astype(np.int64)
        if not length.all():
            raise Broken("no such code")
        first = k == 0
        size = np.where(first, symbol, symbol & 15)
        bit = bit + length
        if first.any():
            f = np.flatnonzero(first)
            at = np.minimum(bit[f] >> 3, len(wide) - 1)
            ahead = (wide[at] << (bit[f] & 7)) & 0xFFFFFFFF
            extra = ahead >> (32 - size[f])
            diff = np.where((size[f] > 0) & (extra < (1 << np.maximum(size[f] - 1, 0))), extra - (1 << size[f]) + 1, extra)
            c = np.zeros(len(f), np.int64) if single else component[block[f] % len(mcu)]
            predicted[c, live[f]] += diff
            luma = c == 0
            who = live[f][luma]
            out[kept[who], who] = predicted[0, who]
            kept[who] += 1
        bit = bit + size
        run = symbol >> 4
        k = np.where(first, 1, np.where(symbol == 0, 64, k + run + 1))
        done = k >= 64
        block = block + done
        k = np.where(done, 0, k)
        if done.any() and (over := block >= blocks_in[live]).any():
            stay = ~over
            live, bit, block, k = live[stay], bit[stay], block[stay], k[stay]
    return [out[: kept[i], i] for i in range(lanes)]


def thumbnails(files: list[bytes]) -> list[list[tuple[np.ndarray, int, int]] | None]:
    """For each file the DC-only luminance thumbnail, width and height of each image in it; None for a broken file.

    Images with equal tables and layout are decoded together.
    """
    found: list[tuple[int, dict, np.ndarray, np.ndarray]] = []
    bad: set[int] = set()
    for number, data in enumerate(files):
        at, raw = 0, np.frombuffer(data, np.uint8)
        if not data:
            bad.add(number)
        try:
            while at < len(data):
                image = parse(data, at)
                own = raw[image["from"] :]
                marks = np.flatnonzero((own[:-1] == 255) & (own[1:] != 0) & (own[1:] != 255))
                stop = np.flatnonzero((own[marks + 1] & 0xF8) != 0xD0)
                if not len(stop) or own[marks[stop[0]] + 1] != 0xD9:
                    raise Broken("no end of image")
                marks = marks[: stop[0] + 1]
                own = own[: marks[-1]]
                keep = np.ones(len(own), bool)
                keep[1:] &= ~((own[1:] == 0) & (own[:-1] == 255))
                for m in (marks[:-1], marks[:-1] + 1):
                    keep[m] = False
                gone = np.cumsum(~keep)
                begin = np.concatenate([[0], marks[:-1] + 2])
                begin = begin - np.where(begin > 0, gone[begin - 1], 0)
                found.append((number, image, own[keep], begin))
                at = image["from"] + int(marks[-1]) + 2
        except (Broken, IndexError, KeyError):
            bad.add(number)
    alike: dict[tuple, list[int]] = {}
    for k, (number, image, _, _) in enumerate(found):
        if number not in bad:
            alike.setdefault((tuple(layout(image)), tuple(sorted(image["dc"].items())), tuple(sorted(image["ac"].items()))), []).append(k)
    done: dict[int, np.ndarray] = {}

    def decode(which: list[int], mcu: list[tuple[int, int, int]]) -> None:
        begins, amounts, starts, shift = [], [], [], 0
        for k in which:
            _, image, data, begin = found[k]
            h, v = (max(p[x] for p in image["parts"]) for x in (1, 2)) if len(image["parts"]) > 1 else (1, 1)
            mcus = -(-image["width"] // (8 * h)) * -(-image["height"] // (8 * v))
            each = image["restart"] or mcus
            if len(begin) != -(-mcus // each):
                raise Broken("wrong number of intervals")
            left = np.full(len(begin), each)
            left[-1] = mcus - each * (len(begin) - 1)
            starts.append(len(begin))
            begins.append(begin + shift)
            amounts.append(left * len(mcu))
            shift += len(data)
        data = np.concatenate([*(found[k][2] for k in which), np.full(8, 255, np.uint8)])
        own = walk(data, np.concatenate(begins), np.concatenate(amounts), mcu, found[which[0]][1]["dc"], found[which[0]][1]["ac"])
        at = 0
        for k, n in zip(which, starts, strict=True):
            done[k] = np.concatenate(own[at : at + n])
            at += n

    for (mcu, _, _), which in alike.items():
        try:
            decode(which, list(mcu))
        except Broken:
            for k in which:  # one broken file must not take the others along
                try:
                    decode([k], list(mcu))
                except Broken:
                    bad.add(found[k][0])
    out: list[list | None] = [None if n in bad else [] for n in range(len(files))]
    for k, (number, image, _, _) in enumerate(found):
        if number in bad:
            continue
        _, h, v, quant = image["parts"][0]
        if len(image["parts"]) == 1:
            h = v = hm = vm = 1
        else:
            hm, vm = (max(p[x] for p in image["parts"]) for x in (1, 2))
        across, down = -(-image["width"] // (8 * hm)), -(-image["height"] // (8 * vm))
        grid = done[k].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        wide, high = -(-image["width"] * h // (8 * hm)), -(-image["height"] * v // (8 * vm))
        grid = np.clip(np.round(grid[:high, :wide] * image["quant"][quant] / 8 + 128), 0, 255).astype(np.uint8)
        out[number].append((grid, image["width"], image["height"]))
    return out


def thumbnail_hash(grid: np.ndarray) -> str:
    """64 bits, in hex: which cells of an 8 x 8 grid over the thumbnail are lighter than their mean."""
    cells = grid.astype(np.float64)
    for axis in (0, 1):
        n = cells.shape[axis]
        edge = np.arange(9) * n // 8
        total = np.concatenate([np.zeros_like(np.take(cells, [0], axis)), np.cumsum(cells, axis)], axis)
        lo, hi = np.minimum(edge[:-1], n - 1), np.maximum(edge[1:], np.minimum(edge[:-1], n - 1) + 1)
        cells = (np.take(total, hi, axis) - np.take(total, lo, axis)) / (hi - lo).reshape(-1, 1) if axis == 0 else (np.take(total, hi, axis) - np.take(total, lo, axis)) / (hi - lo)
    return f"{int(''.join('1' if x else '0' for x in (cells > cells.mean()).ravel()), 2):016x}"


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The documents' bytes, each padded by 255 to a positive multiple of UNIT."""
    sizes = [max(UNIT, -(-int(n) // UNIT) * UNIT) for n in np.diff(offsets)]
    out, at = np.full(sum(sizes), 255, np.uint8), 0
    for d, size in enumerate(sizes):
        own = data[offsets[d] : offsets[d + 1]]
        out[at : at + len(own)] = own
        at += size
    return out, sizes


def _stored(keep_media: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields + [("media", pa.large_binary())] * keep_media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1), 1 << 19):
                media = encode(*payloads(data, offsets))
                rows = []
                for d, (file, images) in enumerate(zip(media, thumbnails(media), strict=True)):
                    payload = b"".join(grid.tobytes() for grid, _, _ in images)
                    feature = ",".join(f"{w}x{h}:{thumbnail_hash(grid)}" for grid, w, h in images)
                    rows.append((int(offsets[d + 1] - offsets[d]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature, *[file] * keep_media))
                columns = [batch.column(0).slice(i, j - i).cast(pa.int64())] + [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.record_batch([c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in columns], names=schema.names)

    return run


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Every text as media, with what is read back from the stored bytes; media itself if asked for.

    A null text is empty. Rows are taken one by one; a null doc_id stays null. Further columns are not read, whatever their
    names. A text is handled in one task, with some 60 bytes of arrays for each of its bytes.
    """
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_stored(keep_media), out + ", media binary" * keep_media)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = [x or b"" for x in batch.column(1).to_pylist()]
        images = thumbnails(files)
        first = [x[0] if x else None for x in images]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([x and x[1] for x in first], pa.int32()), pa.array([x and x[2] for x in first], pa.int32()), pa.array([x and thumbnail_hash(x[0]) for x in first], pa.string())], names=["id", "width", "height", "thumbnail_hash"])


def describe(media: DataFrame, id_column: str = "id", media_column: str = "media") -> DataFrame:
    """id, width, height, thumbnail_hash of each row's (first) image; nulls where the bytes are no baseline image."""
    return media.select(id_column, media_column).mapInArrow(_described, "id long, width int, height int, thumbnail_hash string")

"""Exact substring deduplication by suffix arrays.

Every `length`-byte string that also starts earlier (in a smaller doc_id, or earlier in the same document) covers its
bytes; covered bytes are removed.

Equal strings must meet in one shard. A string's key is the smallest hash among the GRAM-byte grams in it, so equal
strings have equal keys, and runs of strings with one key form segments, about one for every 39 bytes. A segment whose
key stands in no other is done with, unless it may repeat itself. Of equal segments of a key all but the first are
covered as a whole. The bytes of the others are fetched and dealt to shards by key.

A key whose segments have more than HEAVY bytes (a line or passage that very many documents hold) is cut into finer keys
first: its strings are split by where in them the gram stands, a quarter of the places each time, and the new key is the
hash of the bytes that all strings of such a quarter must have in common: 81 bytes after the first cut, all of them after
the last. Equal strings still have equal keys, equal quarters are settled by comparing their bytes, and what fits a shard
leaves the round. So a group's rows at most quadruple in a round, there are four rounds at most, and no shard holds more
than SHARD and HEAVY bytes together, however common a passage is.

A shard's suffix array is built by induced sorting: suffixes are classified by the next byte (smaller or larger type),
the leftmost of the smaller type are sorted by their substrings, and the order of all others is induced from them in two
linear passes over the buckets, each bucket at a time in numpy. Substrings that are equal are told apart by pairs of ranks,
twice the reach each time, until all differ or `length` bytes are covered (a constant number of rounds); README has the
figures of the recursion by induced sorting that this stands for. Common prefixes are computed in text order (permuted):
only where the byte before differs are they compared, else they follow from the one before. Neighbours with `length`
common bytes are equal strings, and of each such class all but the first are covered.

Rows without a doc_id are left out. A null text is empty. Rows that repeat a doc_id with equal texts count as one document;
with different texts they are documents of their own, in an order of their own behind the smaller ids. Matches never cross documents. Columns of any other name are carried along
untouched, those named like columns used here too. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import binary, blocks, drop_staged, fresh_name, mix, staged

LENGTH = 100
GRAM = 24
#: A segment's most strings; a longer run (periodic text) is cut into several.
MOST = 1 << 19
#: Bytes of text in a shard, unless one key alone has more.
SHARD = 1 << 20
#: Bytes of one key's different segments that go to a shard together; a key with more is cut into finer ones.
HEAVY = 1 << 18
#: A packed place in a document: position, number of strings, where the gram stands in the first of them, and whether it
#: recurs in the segment.
_NUMBER_BITS, _AT_BITS = 20, 10

_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_TABLES: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: A second hash modulo a prime, which texts made to collide modulo 2^64 don't fool.
_PRIME = np.uint64((1 << 31) - 1)
_PRIME_CODE = mix(np.arange(300, 556, dtype=np.uint64)) % _PRIME
_PRIME_TABLES: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            own = np.full(max(n, 1 << 21), base, np.uint64)
            own[0] = 1
            _TABLES[k] = np.multiply.accumulate(own)
    return _TABLES[0], _TABLES[1]


def _prime_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_PRIME_TABLES[0]) < n:
        for k, base in enumerate((48271, pow(48271, -1, int(_PRIME)))):
            own = np.ones(1, np.uint64)
            while len(own) < n:
                own = np.concatenate([own, own * np.uint64(pow(base, len(own), int(_PRIME))) % _PRIME])
            _PRIME_TABLES[k] = own
    return _PRIME_TABLES[0], _PRIME_TABLES[1]


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any part follows."""
    up, _ = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up[: len(data)], out=total[1:])
    return total


def _hashes(total: np.ndarray, size: int) -> np.ndarray:
    """The hash of each part of `size` bytes."""
    n = len(total) - size
    return mix((total[size:] - total[:n]) * _tables(len(total))[1][:n])


def least_grams(data: np.ndarray, total: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and for the string that starts at each place where the first of its smallest grams stands."""
    grams = _hashes(total, gram)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    have, reach = 1, length - gram + 1
    while have < reach:
        step = min(have, reach - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return grams, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, keys_only: bool = False) -> tuple[np.ndarray, ...]:
    """(document, key, content hash, packed place) of every segment, or (key, whether its gram recurs)."""
    n = len(data)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    starts = offsets[:-1][np.diff(offsets) >= length]
    ends = offsets[1:][np.diff(offsets) >= length] - length + 1
    if not len(starts):
        return none[:2] if keys_only else none
    _, back = _tables(n + 1)
    total = _sums(data)
    grams, gram_at = least_grams(data, total, length, gram)
    change = np.ones(len(gram_at), bool)
    change[1:] = gram_at[1:] != gram_at[:-1]
    change[starts] = True
    valid = np.zeros(len(gram_at) + 1, np.int8)
    np.add.at(valid, starts, 1)
    np.add.at(valid, ends, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    begin = np.flatnonzero(change & valid)
    key = grams[gram_at[begin]]
    doc = np.searchsorted(offsets, begin, "right") - 1
    # Neighbouring runs whose grams differ in place only are one segment.
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    group = np.cumsum(fresh) - 1
    recurs = np.bincount(group) > 1
    begin, key, doc = begin[fresh], key[fresh], doc[fresh]
    if keys_only:
        return key, recurs
    stop = np.minimum(np.append(begin[1:], n), offsets[doc + 1] - length + 1)
    count = stop - begin
    if (count > MOST).any():
        pieces = -(-count // MOST)
        which = np.repeat(np.arange(len(begin)), pieces)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, key, doc, recurs = begin[which] + part * MOST, key[which], doc[which], recurs[which]
        count = np.minimum(MOST, count[which] - part * MOST)
    tail = begin + count + length - 1
    up, down = _prime_tables(n + 1)
    second = np.zeros(n + 1, np.uint64)
    wide = _PRIME_CODE[data] * up[:n]
    np.cumsum((wide & _PRIME) + (wide >> np.uint64(31)), out=second[1:])  # congruent, and small enough to be summed
    second = (second[tail] - second[begin]) % _PRIME * down[begin] % _PRIME
    content = mix(mix((total[tail] - total[begin]) * back[begin] + count.astype(np.uint64)) + second)
    at = np.where(recurs, 0, gram_at[begin] - begin)
    place = ((((begin - offsets[doc]) << _NUMBER_BITS | count) << _AT_BITS | at) << 1) | recurs
    return doc, key, content, place


def unpack(place):
    """(position, number of strings, where the gram stands in the first, whether the gram recurs)."""
    return place >> (_NUMBER_BITS + _AT_BITS + 1), (place >> (_AT_BITS + 1)) & ((1 << _NUMBER_BITS) - 1), (place >> 1) & ((1 << _AT_BITS) - 1), place & 1


def _segments(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("content", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offsets in blocks(batch.column(1)):
                doc, key, content, place = segments(data, offsets, length)
                if len(doc):
                    yield pa.record_batch([pa.array(ids[i + doc]), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(place)], schema=schema)

    return run


def _keys(length: int):
    schema = pa.schema([("key", pa.int64()), ("recurs", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(1)):
                key, recurs = segments(data, offsets, length, keys_only=True)
                if len(key):
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(recurs.astype(bool))], schema=schema)

    return run


# The suffix array of a shard.


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is."""
    n = len(text)
    differ = np.flatnonzero(text[:-1] != text[1:])
    if not len(differ):
        out = np.zeros(n, bool)
        out[-1] = True
        return out
    following = np.searchsorted(differ, np.arange(n - 1), "left")
    out = np.zeros(n, bool)
    known = following < len(differ)
    at = differ[following[known]]
    out[:-1][known] = text[at] < text[at + 1]
    out[-1] = True
    return out


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that sorted seeds (leftmost suffixes of the smaller type) induce."""
    letters = np.unique(text)
    slot = np.zeros(int(letters[-1]) + 1, np.uint8 if len(letters) <= 256 else np.int32)
    slot[letters] = np.arange(len(letters))
    letter = slot[text]
    sigma = len(letters)

    def dealt(places: np.ndarray, waiting: list[list[np.ndarray]]) -> None:
        """Append places to the buckets of their letters, in order."""
        if not len(places):
            return
        own = letter[places]
        order = np.argsort(own, kind="stable")
        own, places = own[order], places[order]
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        for begin, end in zip(np.concatenate([[0], cut]), np.append(cut, len(own)), strict=True):
            waiting[own[begin]].append(places[begin:end])

    def swept(order: range, first: list[list[np.ndarray]], other, kind: bool) -> list[np.ndarray]:
        """Each bucket's suffixes of one type. first: those induced so far; other(c): the bucket's other type's, which are
        scanned after them; kind: which type is induced."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * sigma
        for c in order:
            waves = [np.concatenate(first[c])] if first[c] else []
            while waves and len(waves[-1]):
                before = waves[-1] - 1
                before = before[before >= 0]
                waves.append(before[(letter[before] == c) & (smaller[before] == kind)])
            out[c] = np.concatenate(waves) if waves else np.zeros(0, np.int64)
            before = np.concatenate([out[c], other(c)]) - 1
            before = before[before >= 0]
            dealt(before[(letter[before] != c) & (smaller[before] == kind)], first)
        return out

    at_seed: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    dealt(seeds, at_seed)
    seed_of = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in at_seed]
    waiting: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    larger = swept(range(sigma), waiting, lambda c: seed_of[c], False)
    # Backwards: within a bucket the smaller type lies behind the larger, each scanned from its end.
    waiting = [[] for _ in range(sigma)]
    last = len(text) - 1
    waiting[letter[last]].append(np.array([last]))
    small = swept(range(sigma - 1, -1, -1), waiting, lambda c: larger[c][::-1], True)
    return np.concatenate([x for c in range(sigma) for x in (larger[c], small[c][::-1])])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` letters at least. The last letter must be smaller than all others."""
    text = text.astype(np.int64)
    smaller = _types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(leftmost):
        return _induce(text, smaller, np.array([len(text) - 1]))
    # Their substrings, each up to the next leftmost one, in induced order.
    is_leftmost = np.zeros(len(text), bool)
    is_leftmost[leftmost] = True
    order = _induce(text, smaller, leftmost)
    order = order[is_leftmost[order]]
    number = np.zeros(len(text), np.int64)
    number[leftmost] = np.arange(len(leftmost))
    up, back = _tables(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_CODE[text & 255] * up[: len(text)] + mix(text.astype(np.uint64)) * up[: len(text)], out=total[1:])
    stop = np.append(leftmost[1:] + 1, len(text))
    content = (total[stop] - total[leftmost]) * back[leftmost]
    size = stop - leftmost
    which = number[order]
    differs = (content[which][1:] != content[which][:-1]) | (size[which][1:] != size[which][:-1])
    rank = np.zeros(len(leftmost), np.int64)
    rank[which] = np.concatenate([[0], np.cumsum(differs)])
    # Pairs of ranks, twice the substrings each time, until all differ or `depth` letters are covered.
    span = 1
    reach = np.append(leftmost, len(text))
    while rank.max(initial=0) + 1 < len(rank):
        covered = reach[np.minimum(np.arange(len(rank)) + span, len(rank))] - leftmost
        behind = np.zeros(len(rank), np.int64)
        behind[:-span or None] = rank[span:] + 1 if span < len(rank) else 0
        if span >= len(rank):
            break
        tied = np.bincount(rank)[rank] > 1
        if covered[tied].min() >= depth:
            break
        pair = rank * (len(rank) + 1) + behind
        order_of = np.argsort(pair, kind="stable")
        steps = np.concatenate([[0], np.cumsum(pair[order_of][1:] != pair[order_of][:-1])])
        rank[order_of] = steps
        span *= 2
    return _induce(text, smaller, leftmost[np.argsort(rank, kind="stable")])


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in text order, the one before it in the array and their common prefix, within stop of both."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    have = before >= 0
    follows = np.zeros(n, bool)
    follows[1:] = have[1:] & have[:-1] & (before[1:] == before[:-1] + 1) & (text[np.maximum(before[1:] - 1, 0)] == text[:-1]) & (stop[1:] == stop[:-1]) & (stop[np.maximum(before[1:], 0)] == stop[np.maximum(before[:-1], 0)])
    common = np.zeros(n, np.int64)
    at = np.flatnonzero(have & ~follows)
    most = np.minimum(stop[at] - at, stop[before[at]] - before[at])
    done = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    wide = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    while len(live):
        a, b = at[live] + done[live], before[at[live]] + done[live]
        same = (words[np.minimum(a, n)] == words[np.minimum(b, n)]).astype(np.uint8)
        run = np.where(same.all(1), 8, same.argmin(1))
        done[live] = np.minimum(done[live] + run, most[live])
        live = live[(run == 8) & (done[live] < most[live])]
    common[at] = done
    # A suffix that follows the one before it has one common byte less.
    origin = np.where(follows, 0, np.arange(n))
    np.maximum.accumulate(origin, out=origin)
    return before, np.maximum(common[origin] - (np.arange(n) - origin), 0)


def repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its strings (len - length + 1 of them) also start earlier, in it or in a part before it."""
    size = np.array([len(p) for p in parts], np.int64)
    end = np.cumsum(size + 1)
    text = np.zeros(int(end[-1]) + 1, np.int64)
    raw = np.frombuffer(b"\0".join(parts), np.uint8)
    text[: len(raw)] = raw
    text[:-1] += 2
    text[end - 1] = 1  # ends a part
    order = suffix_array(text, length)
    stop = np.append(np.repeat(end - 1, size + 1), len(text) - 1)
    shown = np.minimum(text, 257)
    small = np.where(shown >= 2, shown - 2, 0).astype(np.uint8)
    _, common = permuted_common_prefixes(small, order, stop)
    equal = common[order] >= length
    group = np.cumsum(~equal)
    least = np.full(group[-1] + 1, len(text), np.int64)
    np.minimum.at(least, group, order)
    later = np.zeros(len(text), bool)
    later[order] = order > least[group]
    return [later[e - 1 - n : e - 1][: max(n - length + 1, 0)] for e, n in zip(end, size, strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_PARTS = "key long, doc_id long, start long, bytes binary, gram_at int, recurs boolean, heavy boolean"
_PART_SCHEMA = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary()), ("gram_at", pa.int32()), ("recurs", pa.bool_()), ("heavy", pa.bool_())])


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _fetched(length: int):
    """(doc_id, text, wanted) to the bytes of each wanted segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2)
            rows: list[tuple] = []
            size = 0
            for doc, text, own in zip(ids, binary(batch.column(1)), wanted, strict=True):
                raw = memoryview(text.as_buffer())
                for want in own.as_py():
                    start, count, at, recurs = unpack(want["place"])
                    part = bytes(raw[start : start + count + length - 1])
                    if len(part) == count + length - 1:  # a row that repeats a doc_id may be shorter
                        rows.append((want["key"], doc, start, part, at, bool(recurs), want["heavy"]))
                        size += len(part)
                    if size > 8 << 20:
                        yield _columns(rows, _PART_SCHEMA)
                        rows, size = [], 0
            if rows:
                yield _columns(rows, _PART_SCHEMA)

    return run


def _singled(length: int):
    """Segments in which the gram recurs to runs of strings that share one place of it. Strings that stand in the segment
    before go at once: their bytes are null and gram_at is how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, doc, start, part in zip(*(batch.column(k).to_pylist() for k in ("key", "doc_id", "start", "bytes")), strict=True):
                later = repeats([part], length)[0]
                for first, last in zip(*runs(later), strict=True):
                    rows.append((key, doc, start + first, None, last - first + 1, False, True))
                data = np.frombuffer(part, np.uint8)
                _, gram_at = least_grams(data, _sums(data), length, GRAM)
                for first, last in zip(*runs(~later), strict=True):
                    cut = np.flatnonzero(gram_at[first + 1 : last + 1] != gram_at[first:last]) + first + 1
                    for a, b in zip([first, *cut], [*cut, last + 1], strict=True):
                        rows.append((key, doc, start + a, part[a : b + length - 1], int(gram_at[a] - a), False, True))
            if rows:
                yield _columns(rows, _PART_SCHEMA)

    return run


_SPANS = "doc_id long, begin long, end long"


def _sharded(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def covered(rows: list[tuple]) -> pa.RecordBatch:
        docs, begins, ends = [], [], []
        for (_, doc, start, _), flags in zip(rows, repeats([r[-1] for r in rows], length), strict=True):
            first, last = runs(flags)
            docs += [doc] * len(first)
            begins += (start + first).tolist()
            ends += (start + last + length).tolist()
        return pa.record_batch([pa.array(x, pa.int64()) for x in (docs, begins, ends)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("key", "doc_id", "start", "bytes")), strict=True):
                if held and row[0] != held[-1][0] and size >= SHARD:
                    yield covered(held)
                    held, size = [], 0
                if held and row == held[-1]:
                    continue
                held.append(row)
                size += len(row[-1])
        if held:
            yield covered(held)

    return run


def _halved(open_: DataFrame, length: int) -> DataFrame:
    """Rows (key, doc_id, start, bytes, gram_at, low, high), cut by where the gram stands in a string: low to high."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    strings = F.octet_length("bytes") - (length - 1)
    halves = [open_.where("low = high").select("key", "doc_id", "start", "bytes", "gram_at", "low", "high")]
    for low, high in ((F.col("low"), middle), (middle + 1, F.col("high"))):
        half = open_.where("low < high").select("key", "doc_id", "start", "bytes", "gram_at", low.alias("low"), high.alias("high"), F.least("gram_at", high).alias("most"), F.greatest(F.col("gram_at") - strings + 1, low).alias("fewest"))
        skipped = F.col("gram_at") - F.col("most")
        part = F.substring("bytes", skipped + 1, F.col("most") - F.col("fewest") + length)
        half = half.where("most >= fewest").select("key", "doc_id", (F.col("start") + skipped).alias("start"), part.alias("bytes"), F.col("most").alias("gram_at"), "low", "high")
        shared = F.substring("bytes", F.col("gram_at") - F.col("low") + 1, length - (F.col("high") - F.col("low")))
        halves.append(half.withColumn("key", F.xxhash64("key", "high", shared)))
    return halves[0].unionByName(halves[1]).unionByName(halves[2])


def _cut_down(parts: DataFrame, length: int, heavy: int) -> tuple[DataFrame, list[DataFrame]]:
    """What of heavy keys' parts goes to shards (key, doc_id, start, bytes), and the spans that are covered already."""
    singled = staged(parts.where("heavy AND recurs").mapInArrow(_singled(length), _PARTS), "singled")
    spans = [singled.where("bytes IS NULL").select("doc_id", F.col("start").alias("begin"), (F.col("start") + F.col("gram_at") + (length - 1)).alias("end"))]
    own = parts.where("heavy AND NOT recurs").unionByName(singled.where("bytes IS NOT NULL"))
    open_ = own.select("key", "doc_id", "start", "bytes", "gram_at", F.lit(0).alias("low"), F.lit(length - GRAM).alias("high"))
    ready = []
    for _ in range(((length - GRAM).bit_length() + 1) // 2):
        quarters = staged(_halved(_halved(open_, length), length), "quarters")
        firsts = quarters.groupBy("key", "gram_at", "low", "high", "bytes").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        firsts = staged(firsts, "first-quarters")
        copies = quarters.join(firsts, ["key", "gram_at", "low", "high", "bytes"]).where(F.struct("doc_id", "start") != F.col("first"))
        spans.append(staged(copies.select("doc_id", F.col("start").alias("begin"), (F.col("start") + F.octet_length("bytes")).alias("end")), "copies"))
        sizes = staged(firsts.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("size")).where("n > 1"), "key-sizes")
        rest = firsts.join(sizes, "key").select("key", "first.doc_id", "first.start", "bytes", "gram_at", "low", "high", (F.col("size") > heavy).alias("heavy"))
        rest = staged(rest, "finer")
        ready.append(rest.where("NOT heavy").select("key", "doc_id", "start", "bytes"))
        open_ = rest.where("heavy").drop("heavy")
        drop_staged(quarters, firsts, sizes)
        if not open_.limit(1).count():
            break
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out, spans


def covered_spans(docs: DataFrame, length: int = LENGTH, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, begin, end) of covered bytes of documents (doc_id, text); spans may overlap."""
    rows = docs.mapInArrow(_segments(length), "doc_id long, key long, content long, place long")
    recurs = F.col("place").bitwiseAND(1)
    # Nearly all keys stand alone, so the rows meet only those that don't. What a join by key meets is written first: then
    # Spark can split a key that very many rows have.
    shared = docs.mapInArrow(_keys(length), "key long, recurs boolean").groupBy("key").agg(F.count("*").alias("n"), F.bool_or("recurs").alias("recurs"))
    shared = staged(shared.where("n > 1 OR recurs").select("key"), "shared-keys")
    met = staged(rows.join(shared, "key").select("key", "content", "doc_id", "place"), "segments")
    count = F.shiftright("place", _AT_BITS + 1).bitwiseAND((1 << _NUMBER_BITS) - 1)
    firsts = met.groupBy("key", "content").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    firsts = staged(firsts.select("key", "content", "first.doc_id", "first.place"), "firsts")
    start = F.shiftright("m.place", _NUMBER_BITS + _AT_BITS + 1)
    again = met.alias("m").join(firsts.alias("f"), ["key", "content"]).where("m.doc_id <> f.doc_id OR m.place <> f.place")
    length_of = F.shiftright("m.place", _AT_BITS + 1).bitwiseAND((1 << _NUMBER_BITS) - 1) + (length - 1)
    copies = staged(again.select("m.doc_id", start.alias("begin"), (start + length_of).alias("end")), "copies")
    keys = firsts.groupBy("key").agg(F.count("*").alias("n"), F.sum(count + (length - 1)).alias("size"), F.max(recurs).alias("recurs")).where("n > 1 OR recurs = 1")
    keys = staged(keys.select("key", (F.col("size") > heavy).alias("heavy")), "keys")
    sought = firsts.join(keys, "key")
    wanted = sought.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place", "heavy")).alias("wanted"))
    parts = staged(docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_fetched(length), _PARTS), "parts")
    drop_staged(shared, met, firsts, keys)
    ready, spans = parts.where("NOT heavy").select("key", "doc_id", "start", "bytes"), [copies]
    if parts.where("heavy").limit(1).count():
        more, found = _cut_down(parts, length, heavy)
        ready, spans = ready.unionByName(more), spans + found
    sorted_parts = ready.repartition("key").sortWithinPartitions("key", "doc_id", "start", "bytes")
    out = staged(sorted_parts.mapInArrow(_sharded(length), _SPANS), "covered")
    drop_staged(parts)
    for own in spans:
        out = out.unionByName(own)
    return out


def _removed(at: int | None):
    """Rows (doc_id, text, spans, ...) to digests, or, with the text's column number, to rows with the text that is kept."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]

    def cut(raw: bytes, spans: list | None) -> tuple[bytes, int]:
        if not spans:
            return raw, 0
        flags = np.zeros(len(raw) + 1, np.int32)
        for s in spans:
            flags[min(s["begin"], len(raw))] += 1
            flags[min(s["end"], len(raw))] -= 1
        gone = np.cumsum(flags[:-1]) > 0
        return np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(runs(gone)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = binary(batch.column("text")), batch.column(batch.num_columns - 1)
            if at is None:
                rows = []
                for doc, text, own in zip(batch.column("doc_id").to_pylist(), texts, spans, strict=True):
                    raw = text.as_py()
                    kept, n = cut(raw, own.as_py())
                    rows.append((doc, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
                yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], t) for _, t in fields], names=[n for n, _ in fields])
            else:
                kept = [cut(text.as_py(), own.as_py())[0].decode("utf-8", "ignore") if own.is_valid else whole.as_py() for text, own, whole in zip(texts, spans, batch.column("text"), strict=True)]
                yield batch.set_column(at, "text", pa.array(kept, pa.string())).select(batch.schema.names[:-1])

    return run


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs (with doc_id and text) with a column that tells documents apart, in the order of doc_id: doc_id itself, if no two texts share one.

    Else the distinct pairs of doc_id and text, the latter as hashes of 96 bits and a length, are sorted by ranges and numbered.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"), F.length(text).alias("l"))
    if told.groupBy("d").agg((F.min(F.struct("h", "g", "l")) < F.max(F.struct("h", "g", "l"))).alias("twins")).where("twins").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    keys = ["d", "h", "g", "l"]
    numbers = told.distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("n", F.monotonically_increasing_id())
    numbers = staged(numbers, "numbers").select(*(F.col(c).alias(f"{name}_{c}") for c in keys), F.col("n").alias(name))
    same = [F.col(f"{name}_{c}") == x for c, x in zip(keys, (F.col("doc_id").cast("long"), F.xxhash64(text), F.hash(text), F.length(text)), strict=True)]
    return docs.join(numbers, same, "left").select(*docs.columns, name)


def _spans_of(docs: DataFrame, number: str, length: int, heavy: int) -> DataFrame:
    own = docs.select(F.col(number).alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return covered_spans(own, length, heavy).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def deduplicated(docs: DataFrame, length: int = LENGTH, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    docs = _numbered(docs, "number")
    rows = docs.join(_spans_of(docs, "number", length, heavy).withColumnRenamed("doc_id", "number"), "number", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_removed(None), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, heavy: int = HEAVY) -> DataFrame:
    """The rows of docs with the text that is kept, n_chars (if there) being its length.

    A character of which a byte is removed goes as a whole. Rows without a doc_id stay as they are.
    """
    columns, own = docs.columns, fresh_name("spans", docs.columns)
    number = fresh_name("number", docs.columns)
    numbered = _numbered(docs, number)
    spans = _spans_of(numbered, number, length, heavy).select(F.col("doc_id").alias(f"{own}_of"), F.col("spans").alias(own))
    rows = numbered.join(spans, F.col(number) == F.col(f"{own}_of"), "left").drop(f"{own}_of", number)
    out = rows.mapInArrow(_removed(columns.index("text")), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out

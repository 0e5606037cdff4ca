"""Benchmark decontamination by q-gram lemma filtering.

Items and documents are normalised alike (A-Z and accented Latin-1 capitals lower-cased, white space collapsed to one
space), on bytes. An item is
looked for as a whole if it is short, else by overlapping passages of PASSAGE bytes: one that is found within its edit
budget (RATE of its length) marks the document.

Of a longer item, a copied stretch is sure to be found from PASSAGE + STRIDE - 1 = 103 bytes on; one of 96 to 102 bytes only if
it happens to hold a whole passage, a shorter one or one edited beyond the budget in every passage not at all.

By the q-gram lemma, text within e edits of a passage of n bytes shares n - q + 1 - q * e of its q-grams, all on
diagonals that differ by at most e. Each batch of documents goes through three sieves: all its q-gram hashes against a
bitmap of the benchmark's; places with too few hits within a passage's reach are dropped; the rest are expanded to
(item, diagonal, place in the item) and dealt into overlapping diagonal bands, where a window that slides over the item
counts for all its passages. Passages that reach the count are verified by alignment
within the band, for all candidates of a batch at once. The index holds each q-gram of an item once, however densely its passages lie.

The benchmark is a stated query set. Its texts go to the workers in blocks of at most BLOCK_BYTES, one pass over the
documents each, so its size has no limit; a worker makes a block's index itself, which takes some 150 MB for a full block.

Items of fewer than Q bytes have no q-gram: they match documents that are equal to them when both are normalised. Null,
empty and blank texts and items match nothing. Null ids are left out. Repeated items and documents are reported once for
each pair of ids. Further columns of either table are not read, or carried along by without_contaminated, whatever their
names. An empty table on either side gives no rows. A document is handled in one task, with some 30 bytes of arrays for
each of its bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import blocks, fresh_name, mix

Q = 8
PASSAGE, STRIDE = 96, 8
#: Edits allowed for each byte of a passage.
RATE = 0.08
#: Benchmark text that one pass over the documents looks for.
BLOCK_BYTES = 4 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, their offsets by document, and the place in data of each byte kept."""
    folded = _FOLD[data]
    # Capital letters with marks, U+00C0 to U+00DE but for the multiplication sign.
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    folded[capital] += 32
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    heads = offsets[:-1]
    heads = heads[heads < len(folded)]
    keep[heads] = True
    place = np.flatnonzero(keep)
    return folded[place], np.searchsorted(place, offsets), place


def qgrams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q bytes (at most 8) from each place on."""
    n = max(len(data) - q + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(q if n else 0):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def budget_of(n: int, q: int = Q) -> int:
    """Edits allowed in n bytes: RATE of them, but no more than leave a quarter of the q-grams to count on."""
    return max(0, min(int(RATE * n), (3 * (n - q + 1) // 4) // q))


class Passages:
    """What is looked for: passages of the items, and one index of the items' q-grams for all passages that overlap."""

    def __init__(self, items: list[tuple[int, bytes]]):
        ids: list[int] = []
        texts: list[np.ndarray] = []
        self.short: dict[bytes, set[int]] = {}
        for item, raw in items:
            data = np.frombuffer(raw, np.uint8)
            own, _, _ = normalised(data, np.array([0, len(data)]))
            own = np.frombuffer(own.tobytes().strip(b" "), np.uint8)
            if len(own) < Q:
                if len(own):
                    self.short.setdefault(own.tobytes(), set()).add(item)
                continue
            ids.append(item)
            texts.append(own)
        none = np.zeros(0, np.int64)
        #: Of each item: length, bytes of its passages, edits and shared q-grams they need, number of the first, how many.
        self.length = np.array([len(t) for t in texts], np.int64)
        self.window = np.minimum(self.length, PASSAGE)
        self.allowed = np.array([budget_of(int(n)) for n in self.window], np.int64)
        self.needed = np.maximum(1, self.window - Q + 1 - Q * self.allowed)
        self.passages = 1 + -(-(self.length - self.window) // STRIDE)
        self.first = np.cumsum(self.passages) - self.passages
        self.pad = int(self.length.max()) if texts else 0
        # Of each passage: item, start in it, length, edits, place in `data`.
        own = np.repeat(np.arange(len(texts)), self.passages)
        self.item = np.array(ids, np.int64)[own] if texts else none
        self.start = np.minimum((np.arange(len(own)) - self.first[own]) * STRIDE, (self.length - self.window)[own]) if texts else none
        self.size, self.edits = (self.window[own], self.allowed[own]) if texts else (none, none)
        self.data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        self.begin = (np.cumsum(self.length) - self.length)[own] + self.start if texts else none
        grams = [qgrams(t) for t in texts]
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.at = code[order], owner[order], at[order]
        distinct = self.code[np.concatenate([[True], self.code[1:] != self.code[:-1]])] if len(code) else self.code
        self.bits = max(16, int(np.ceil(np.log2(max(len(distinct), 1) * 64))))
        self.bitmap = np.zeros(1 << (self.bits - 3), np.uint8)
        slot = self._slot(distinct)
        np.bitwise_or.at(self.bitmap, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
        #: The least count and the longest reach of any passage, for the sieve that knows no passage.
        self.least = int(self.needed.min()) if texts else 1
        self.reach = int((self.window + self.allowed).max()) if texts else 1

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(_MULTIPLIER)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, passage, low): bands span two times w diagonals, w being the passage's edits + 1, and each overlaps
        the next by w; low is the diagonal from which the band, widened by the edits, is aligned."""
        none = (np.zeros(0, np.int64),) * 3
        code = qgrams(data)
        if not len(code) or not len(self.code):
            return none
        slot = self._slot(code)
        hit = (self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
        doc_end = offsets[1:]
        place = np.flatnonzero(hit)
        doc = np.searchsorted(doc_end, place, "right")
        inside = place + Q <= doc_end[doc]
        place, doc = place[inside], doc[inside]
        # Hits within a passage's reach of a place from which that reach holds enough of them.
        if not len(place):
            return none
        last = np.searchsorted(place, place + self.reach, "right")
        start = np.where(last - np.arange(len(place)) >= self.least, place, -self.reach - 1)
        dense = place - np.maximum.accumulate(start) <= self.reach
        place, doc = place[dense], doc[dense]
        if not len(place):
            return none
        left, right = (np.searchsorted(self.code, code[place], side) for side in ("left", "right"))
        count = right - left
        which = np.repeat(np.arange(len(place)), count)
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
        item, at = self.owner[entry].astype(np.int64), self.at[entry]
        band = (place[which] - at + self.pad) // (self.allowed[item] + 1) + 1
        # One integer for (document, item, band); it also stands for band - 1, its overlapping neighbour.
        bands = len(data) + self.pad + 3
        key = (doc[which] * len(self.length) + item) * bands + band
        key, at = np.concatenate([key, key - 1]), np.concatenate([at, at])
        # Counting by a hash first leaves few keys to sort.
        slot = (key.astype(np.uint64) * np.uint64(_MULTIPLIER) >> np.uint64(44)).astype(np.int64)
        many = np.bincount(slot, minlength=1 << 20)[slot] >= self.least
        key, at = key[many], at[many].astype(np.int64)
        order = np.lexsort((at, key))
        return self._windows(key[order], at[order], bands)

    def _windows(self, key: np.ndarray, at: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The passages in which a band holds enough q-grams; the places `at` in the item rise within each key.

        A passage is found at the first of its q-grams, from which the one that makes the count must lie in it too.
        """
        item = key // bands % len(self.length)
        row = np.arange(len(key))
        nth = row + self.needed[item] - 1
        fits = nth < len(key)
        row, item, nth = row[fits], item[fits], nth[fits]
        spread = self.window[item] - Q
        full = (key[nth] == key[row]) & (at[nth] - at[row] <= spread)
        row, item, nth, spread = row[full], item[full], nth[full], spread[full]
        before = np.where((row > 0) & (key[row - 1] == key[row]), at[row - 1], -1)
        low, high = np.maximum(before + 1, at[nth] - spread), at[row]
        # Starts at multiples of STRIDE, and the item's last passage, which starts where it ends with the item.
        last = self.length[item] - self.window[item]
        least, most = -(-low // STRIDE), np.minimum(high // STRIDE, self.passages[item] - 2)
        count = np.maximum(most - least + 1, 0)
        of = np.repeat(np.arange(len(row)), count)
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(least, count)
        ends = np.flatnonzero((low <= last) & (last <= high))
        of, steps = np.concatenate([of, ends]), np.concatenate([steps, self.passages[item[ends]] - 1])
        item, key = item[of], key[row[of]]
        passage, edits = self.first[item] + steps, self.allowed[item]
        return key // bands // len(self.length), passage, (key % bands - 1) * (edits + 1) - edits - self.pad + self.start[passage]

    def verified(self, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, passage: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits within the band of each candidate, and where the match ends; more than allowed if none."""
        out, ends = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        for n, e in set(zip(self.size[passage].tolist(), self.edits[passage].tolist(), strict=True)):
            own = np.flatnonzero((self.size[passage] == n) & (self.edits[passage] == e))
            for some in np.array_split(own, -(-len(own) // 4096)):
                pattern = self.data[self.begin[passage[some]][:, None] + np.arange(n)]
                out[some], ends[some] = _align(data, offsets[doc[some]], offsets[doc[some] + 1], low[some], 2 * (e + 1) + 2 * e, pattern)
        return out, ends


def _align(data: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, width: int, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against data, on diagonals low to low + width, and the end of the best match.

    cost[:, d] after i bytes of the pattern is that of ending before data[low + d + i]; a match may start anywhere in the
    band and must stay between begin and end.
    """
    lanes, n = pattern.shape
    far = np.int64(n + width + 1)
    diagonal = low[:, None] + np.arange(width + 1)
    inside = (diagonal >= begin[:, None]) & (diagonal <= end[:, None])
    cost = np.where(inside, 0, far)
    steps = np.arange(width + 1)
    for i in range(n):
        at = diagonal + i
        ok = (at >= begin[:, None]) & (at < end[:, None])
        same = data[np.clip(at, 0, len(data) - 1)] == pattern[:, i : i + 1]
        moved = np.where(ok, cost + ~same, far)  # both go on
        moved[:, :-1] = np.minimum(moved[:, :-1], cost[:, 1:] + 1)  # the pattern's byte is missing in data
        legal = (at + 1 >= begin[:, None]) & (at + 1 <= end[:, None])
        moved = np.where(legal, moved, far)
        # Bytes of data that are not in the pattern: a running minimum with one edit a step.
        moved = np.minimum.accumulate(moved - steps, axis=1) + steps
        cost = np.where(legal, moved, far)
    best = cost.argmin(1)
    return cost[np.arange(lanes), best], low + best + n


#: The index of the block that this worker process made last.
_MADE: dict[int, Passages] = {}


def _index_of(items) -> Passages:
    """The index of a broadcast block of items, made once in a worker process."""
    if items.value[0] not in _MADE:
        _MADE.clear()
        _MADE[items.value[0]] = Passages(items.value[1])
    return _MADE[items.value[0]]


def _hits(items):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(items)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, raw, raw_offsets in blocks(batch.column(1)):
                data, offsets, place = normalised(raw, raw_offsets)
                if index.short:
                    few = [(int(d), own.strip(b" ")) for d in np.flatnonzero(np.diff(offsets) < Q + 2) if (own := data[offsets[d] : offsets[d + 1]].tobytes())]
                    same = [(int(ids[i + d]), item, 0, 0, int(raw_offsets[d + 1] - raw_offsets[d])) for d, own in few for item in sorted(index.short.get(own, ()))]
                    if same:
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*same, strict=True)], schema=schema)
                doc, passage, low = index.candidates(data, offsets)
                if not len(doc):
                    continue
                edits, end = index.verified(data, offsets, doc, passage, low)
                good = edits <= index.edits[passage]
                doc, passage, edits, end = doc[good], passage[good], edits[good], end[good]
                # Overlapping bands find a match twice: one row for each passage and end, with the fewest edits.
                order = np.lexsort((edits, end, passage, doc))
                doc, passage, edits, end = doc[order], passage[order], edits[order], end[order]
                new = np.ones(len(doc), bool)
                new[1:] = (np.diff(doc) != 0) | (np.diff(passage) != 0) | (np.diff(end) != 0)
                doc, passage, edits, end = doc[new], passage[new], edits[new], end[new]
                begin = np.maximum(end - index.size[passage], offsets[doc])
                at = np.append(place, len(raw))
                base = raw_offsets[doc]
                yield pa.record_batch([pa.array(ids[i + doc]), pa.array(index.item[passage]), pa.array(edits), pa.array(at[begin] - base), pa.array(at[end] - base)], schema=schema)

    return run


def in_blocks(items: Iterator[tuple[int, str]], limit: int) -> Iterator[list[tuple[int, bytes]]]:
    own, size = [], 0
    for item, text in items:
        raw = (text or "").encode()
        if own and size + len(raw) > limit:
            yield own
            own, size = [], 0
        own.append((item, raw))
        size += len(raw)
    if own:
        yield own


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, passages, edits, begin, end of each document and item of which it holds a passage.

    passages: how many matches of passages with different ends; edits: the fewest in one; begin and end: the span in the text's UTF-8 bytes that
    the matches cover, from the first to the last.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text")
    found = []
    for own in in_blocks(((r.item_id, r.text) for r in items.toLocalIterator()), block_bytes):
        block = spark.sparkContext.broadcast((uuid.uuid4().int, own))
        found.append(docs.mapInArrow(_hits(block), "doc_id long, item_id long, edits long, begin long, end long"))
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "doc_id long, item_id long, edits long, begin long, end long")
    return rows.groupBy("doc_id", "item_id").agg(F.count("*").alias("passages"), F.min("edits").alias("edits"), F.min("begin").alias("begin"), F.max("end").alias("end"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, as they are, that hold no passage of the benchmark."""
    own = fresh_name("hit", docs.columns)
    hit = contaminated(docs, benchmark).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(hit, F.col("doc_id") == F.col(own), "left_anti")

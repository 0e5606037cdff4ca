"""URL filtering against a sorted array of 64-bit digests.

The rules (host and path prefix, allow or block) are kept as one file: their xxhash64 digests in ascending order, then
the places of their full strings. A worker memory-maps it once. A URL asks for each suffix of its host with each prefix
of its path that is as long as some rule's path; a batch of URLs is probed by one vectorised binary search, and a hit
counts only if the stored string equals the asked one. Of the rules that fit, the longest wins.

Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased. Path: from there up to '?', '#' or the end.
A null url, or one without '://', has an empty host and path and fits no rule. A URL that no rule fits is allowed. Equal
rules count once, block over allow.

Only a file of up to `max_bytes` is sent to every worker, as a broadcast must be bounded. Of a larger rule set the digests
are not in one array: asked strings and rules meet in a sort-merge join on digest, confirmed on the string.

Rows may repeat and are judged one by one. Further columns of pages are not read, whatever their names. An empty table of
pages gives no rows, one of rules allows all.
"""

from __future__ import annotations

import os
import string
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest digest file that a worker maps at a time.
MAX_BYTES = 64 << 20
_MAPPED: dict[str, DigestIndex] = {}


def build(rules: list[tuple[str, str]]) -> bytes:
    """The digest file of (rule, verdict); a rule is host and path together."""
    verdicts: dict[bytes, bool] = {}
    for rule, verdict in rules:
        verdicts[rule.encode()] = verdicts.get(rule.encode(), False) or verdict == "block"
    order = sorted(verdicts, key=lambda r: (xxhash.xxh64_intdigest(r), r))
    digests = np.array([xxhash.xxh64_intdigest(r) for r in order], "<u8")
    ends = np.cumsum([0, *map(len, order)]).astype("<i8")
    blocked = np.array([verdicts[r] for r in order], "u1")
    head = np.array([len(order)], "<i8")
    return b"".join([head.tobytes(), digests.tobytes(), ends.tobytes(), blocked.tobytes(), *order])


class DigestIndex:
    """A digest file, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<i8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.ends = raw[8 + 8 * n : 16 + 16 * n].view("<i8")
        self.blocked = raw[16 + 16 * n : 16 + 17 * n]
        self.strings = raw[16 + 17 * n :]

    @classmethod
    def of(cls, data: bytes, keep: bool = True) -> DigestIndex:
        """The index of such bytes, mapped once in each worker process, or, with keep=False, for as long as the caller holds it."""
        name = xxhash.xxh3_128_hexdigest(data)
        if name not in _MAPPED:
            fd, path = tempfile.mkstemp(prefix="digests-")
            with os.fdopen(fd, "wb") as f:
                f.write(data)
            own = cls(path)
            os.unlink(path)  # the mapping stays
            if not keep:
                return own
            _MAPPED[name] = own
        return _MAPPED[name]

    def find(self, asked: list[bytes]) -> np.ndarray:
        """For each asked string the number of the equal stored one, or -1."""
        digests = np.array([xxhash.xxh64_intdigest(x) for x in asked], np.uint64)
        at = np.searchsorted(self.digests, digests, "left")
        out = np.full(len(asked), -1, np.int64)
        for k in np.flatnonzero(at < len(self.digests)):
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == digests[k]:
                if bytes(self.strings[self.ends[i] : self.ends[i + 1]]) == asked[k]:
                    out[k] = i
                    break
                i += 1
        return out


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        if (at := rest.find(mark)) >= 0:
            rest = rest[:at]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host) if not host.isascii() else host.lower(), path


def asked_of(host: str, path: str, lengths: list[int], labels: list[int]) -> list[str]:
    """The strings that a rule for this URL can have, the longest first.

    lengths: those of rules' paths; labels: how many parts between dots rules' hosts have, so that a host of very many asks
    for no more than rules can answer.
    """
    parts = host.split(".")
    hosts = [".".join(parts[len(parts) - n :]) for n in labels if n <= len(parts)]
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return sorted({h + p for h in hosts if h for p in prefixes}, key=lambda x: (-len(x), x))


def _probe(data, lengths: list[int], labels: list[int]):
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex.of(data.value)
        for batch in batches:
            parsed = [host_and_path(u) for u in batch.column(1).to_pylist()]
            asked, owner = [], []
            for r, (host, path) in enumerate(parsed):
                own = asked_of(host, path, lengths, labels)
                asked += own
                owner += [r] * len(own)
            found = index.find([x.encode() for x in asked])
            rule: list[str | None] = [None] * len(parsed)
            verdict = ["allow"] * len(parsed)
            for k in np.flatnonzero(found >= 0):
                r = owner[k]
                if rule[r] is None:
                    rule[r] = asked[k]
                    verdict[r] = "block" if index.blocked[found[k]] else "allow"
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([h for h, _ in parsed], pa.string()), pa.array([p for _, p in parsed], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=schema)

    return run


_ASKED = "shard long, part long, stored boolean, asked string, blocked boolean, page long, page_id long, host string, path string"
_FOUND = "page long, page_id long, host string, path string, rule string, verdict string"


def _ask(lengths: list[int], labels: list[int], shift: int, parts: int):
    """Rows (page, page_id, url) to what each asks, with the range of digests that it lies in, and a row that asks nothing for each page."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["shard", "part", "stored", "asked", "blocked", "page", "page_id", "host", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, page_id, url in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                host, path = host_and_path(url)
                part = page % parts
                rows.append((page % (1 << (64 - shift)), part, False, None, None, page, page_id, host, path))
                rows += [(xxhash.xxh64_intdigest(x.encode()) >> shift, part, False, x, None, page, page_id, host, path) for x in asked_of(host, path, lengths, labels)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def _probe_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range of digests, the stored ones first: the file of the range is mapped, then the asked ones stream past it."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    key, rules, index = None, [], None
    for batch in batches:
        asked: list[tuple] = []
        out: list[tuple] = []

        def probe() -> None:
            found = index.find([a[0].encode() for a in asked]) if asked else []
            out.extend((*a[1:], a[0], "block" if index.blocked[i] else "allow") for a, i in zip(asked, found, strict=True) if i >= 0)
            asked.clear()

        for shard, part, stored, x, blocked, *page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (shard, part) != key:
                probe()
                key, rules, index = (shard, part), [], None
            if stored:
                rules.append((x, "block" if blocked else "allow"))
                continue
            if index is None:
                index, rules = DigestIndex.of(build(rules), keep=False), []
            if x is None:
                out.append((*page, None, "allow"))
            else:
                asked.append((x, *page))
        probe()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page", "page_id", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: DataFrame, max_bytes: int = MAX_BYTES, asks_a_task: int = 4_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. rules: host, path, verdict ('allow' or 'block'; any other is an error).

    The sorted digests are cut into ranges whose files take some max_bytes each. One range goes to every worker with the task; of
    several, each task maps one, and what the pages ask is sent to the range that it lies in, in parts of some asks_a_task
    rows, so that a string that most pages ask is no task of its own. Rules without a host or path are left out, equal ones count once, block over
    allow. A URL that is null or has no '://' has empty host and path and no rule. Repeated pages are judged each, other columns are not looked at; without rules all is
    allowed.
    """
    spark = pages.sparkSession
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    known = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("no verdict of a rule: "), F.coalesce("verdict", F.lit("null")))))
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.concat(host, "path").alias("rule"), F.length("path").alias("n"), F.size(F.split(host, r"\.")).alias("parts"), known.alias("verdict")).distinct()
    labels = sorted(r.parts for r in rules.select("parts").distinct().collect())  # at most as many as a host has characters
    lengths = sorted(r.n for r in rules.select("n").distinct().collect())  # at most as many as a path has characters
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 17), F.lit(0)).alias("size"), F.count("verdict").alias("n")).first()["size"] + 16
    pages = pages.select("page_id", "url")
    if size <= max_bytes:
        data = spark.sparkContext.broadcast(build([(r.rule, r.verdict) for r in rules.select("rule", "verdict").collect()]))
        return pages.mapInArrow(_probe(data, lengths, labels), "page_id long, host string, path string, rule string, verdict string")
    ranges = max(1, (-(-size // max(max_bytes, 1 << 10)) - 1).bit_length())
    shift = 64 - ranges
    pages = pages.select(F.monotonically_increasing_id().alias("page"), F.col("page_id").cast("long").alias("page_id"), "url")
    parts = max(1, -(-pages.count() * len(lengths) * len(labels) // (asks_a_task << ranges)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = np.array([xxhash.xxh64_intdigest(x.encode()) for x in b.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((digests >> np.uint64(shift)).astype(np.int64))], ["asked", "blocked", "shard"])

    stored = rules.select("rule", F.col("verdict") == "block").mapInArrow(dealt, "asked string, blocked boolean, shard long")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("page", "long"), ("page_id", "long"), ("host", "string"), ("path", "string"))]
    stored = stored.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(True).alias("stored"), "asked", "blocked", *none)
    rows = stored.unionByName(pages.mapInArrow(_ask(lengths, labels, shift, parts), _ASKED))
    rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", F.desc("stored"))
    found = rows.mapInArrow(_probe_ranges, _FOUND)
    best = F.max_by(F.struct("rule", "verdict"), F.coalesce(F.length("rule"), F.lit(-1)))
    return found.groupBy("page", "page_id", "host", "path").agg(best.alias("best")).select("page_id", "host", "path", "best.rule", "best.verdict")

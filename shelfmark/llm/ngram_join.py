"""N-gram Jaccard join by parity sketches.

Every shingle flips one bit of a very wide, mostly zero bit sketch, so the Hamming distance of two sketches is at most
the size of the symmetric difference of their sets. Sizes fall into overlapping bands; in a band, two sets that reach
the threshold differ in at most `budget` shingles. The sketch is cut into more parts than that, so two linked documents
have equal parts (pigeonhole), and an equi-join on (band, part, flipped bits of the part) finds all of them. A part is
kept as the XOR of its bits' 64-bit codes. Candidates are verified on the shingle sets themselves.

Groups never expand into all pairs: in a group of equal parts each member is compared with the one that shares most with
others. Only groups that then still hold members of different components are looked at again, and there a second, dense
parity sketch sifts the pairs inside the join, so that those which cannot reach the threshold are never emitted.

That finds the components, for which some k - 1 links of k similar documents are enough. All links lie within components,
so class_links and n_links take each component's distinct sets in blocks and compare every pair of them on the sets
themselves. Equal sets are one class, whose documents are linked with each other and with all of a linked class.

Rows without a doc_id are no documents and are left out (one_of_each keeps them as they are). Rows that repeat a doc_id
are taken one by one. A null, empty or blank text has the empty set, which is linked with nothing. Sets are told apart by
128 bits: a 64-bit class, and where different sets have one class, a second digest takes its place. Further columns of
docs are carried along or not read, whatever their names. An empty table gives an empty one.

Steps by part sort a part's members (rows of two integers) in one task, which spills; all later steps are dealt by blocks
of a part, by pivot and salt, or have both sides of a join written first, so that Spark can split a key of very many rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from shelfmark.llm.common import blocks, drop_staged, fresh_name, mix, staged
from shelfmark.llm.shingles import shingle_sets

#: A band's largest size over its smallest.
BAND_RATIO = 1.6
#: Partners of a pivot that are verified in one group about.
PIVOT_PARTNERS = 64
#: Heads of a part that meet the others together.
HEAD_BLOCK = 256
#: Classes that several different sets may have by chance before the join stops: 2^64 classes make that all but impossible.
COLLISIONS = 10_000
#: Length of the dense parity sketch that sifts pairs before they are verified.
SKETCH_LONGS = 16
#: Members of a part that are compared with all others before the rest is.
LEADERS = 64
#: Distinct sets, and shingles in them, that a block of a component holds about when all its links are listed.
BLOCK_SETS, BLOCK_SHINGLES = 256, 500_000
#: Digests that a task remembers so as to emit a copy's parts only once.
REMEMBERED = 200_000


class Bands:
    """Size bands for 'num * union <= den * intersection', so that each linked pair's sizes meet in one of them."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low: list[int] = [1]
        self.high: list[int] = []
        self.budget: list[int] = []
        self.parts: list[int] = []
        self.slack: list[int] = []
        self.tags: list[np.ndarray] = []

    def upto(self, size: int) -> None:
        while not self.high or self.low[-1] <= size:
            low = self.low[-1]
            high = max(int(low * BAND_RATIO), low * self.den // self.num)
            budget = 2 * high * (self.den - self.num) // (self.den + self.num)
            slack = 0
            for _ in range(8):
                parts = budget + 1 + slack
                empty = parts * (1 - 1 / parts) ** low if parts > 1 else 0
                slack = math.ceil(empty + 1.5 * math.sqrt(empty)) if empty > 0.05 else 0
            self.high.append(high)
            self.budget.append(budget)
            self.slack.append(slack)
            self.parts.append(budget + 1 + slack)
            self.tags.append(mix(np.arange(budget + 1 + slack, dtype=np.uint64) + np.uint64(len(self.parts) << 40)))
            self.low.append(self._next(high, low))

    def _next(self, high: int, low: int) -> int:
        a = max(low + 1, high * self.num // self.den - 2)
        while a * self.den // self.num <= high:
            a += 1
        return a

    def of(self, size: int) -> list[int]:
        self.upto(size)
        return [b for b in range(len(self.high)) if self.low[b] <= size <= self.high[b]]


def digests(sets: list[np.ndarray], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Each set's class, of which `bits` bits are used, and a second digest, as signed integers; many sets in one pass."""
    n, own = np.array([len(s) for s in sets], np.uint64), np.concatenate(sets)
    total, twin, some = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), n > 0
    if len(own):
        begin = (np.cumsum(n) - n)[some].astype(np.int64)
        total[some] = np.add.reduceat(mix(own ^ np.uint64(0x5851F42D4C957F2D)), begin)
        twin[some] = np.add.reduceat(mix(own + np.uint64(0x14057B7EF767814F)) * np.uint64(0x2545F4914F6CDD1D), begin)
    return (mix(total ^ n) >> np.uint64(64 - bits)).view(np.int64), mix(twin + n).view(np.int64)


def classes_of(sets: list[np.ndarray], bits: int, shared: frozenset[int]) -> list[int]:
    return [check if cls in shared else cls for cls, check in zip(*(d.tolist() for d in digests(sets, bits)), strict=True)]


def class_of(own: np.ndarray, bits: int, shared: frozenset[int]) -> int:
    return classes_of([own], bits, shared)[0]


def parts_of(sets: list[np.ndarray], bands: Bands) -> list[np.ndarray]:
    """The join keys of each set: one for each part of its sketch that has a bit, in each of its bands; many sets in one pass."""
    codes, at, out, size = mix(np.concatenate(sets) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), 0, [], []
    for own in sets:
        top, code, keys = own >> np.uint64(32), codes[at : at + len(own)], 0
        at += len(own)
        for b in bands.of(len(own)):
            count = bands.parts[b]
            part = (top * np.uint64(count)) >> np.uint64(32)
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            out.append(np.bitwise_xor.reduceat(code, begin) + bands.tags[b][part[begin]])
            keys += len(begin)
            if count - len(begin) > bands.slack[b]:
                # Too many empty parts for the pigeonhole; two such sets share one of their first budget + 1 shingles.
                out.append(own[: bands.budget[b] + 1] + np.uint64((b + 1) << 41))
                keys += len(out[-1])
        size.append(keys)
    return np.split(mix(np.concatenate(out)).view(np.int64), np.cumsum(size)[:-1])


def _sizes(words: int, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("check", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                two = digests(sets, bits)
                yield pa.record_batch([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, two)], schema=schema)

    return run


def _parts(words: int, num: int, den: int, bits: int, shared: frozenset[int]):
    schema = pa.schema([("part", pa.int64()), ("cls", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(1)):
                sets, new, ids = shingle_sets(data, offsets, words), [], []
                for own, cls in zip(sets, classes_of(sets, bits, shared), strict=True):
                    if len(own) and cls not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(cls)
                        new.append(own)
                        ids.append(cls)
                if new:
                    keys = parts_of(new, bands)
                    yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(ids, np.int64), [len(k) for k in keys]))], schema=schema)

    return run


def dense(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SKETCH_LONGS integers for each set: the parities of its shingles by bit. Two rows differ in no more bits than the sets in shingles."""
    bits = [np.bincount((own >> np.uint64(7)).astype(np.int64) % (64 * SKETCH_LONGS), minlength=64 * SKETCH_LONGS) & 1 for own in sets]
    return np.packbits(np.array(bits, np.uint8).reshape(len(sets), 64 * SKETCH_LONGS), axis=1).view(np.int64)


def _sketches(words: int):
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64())] + [(f"s{k}", pa.int64()) for k in range(SKETCH_LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                words_of = dense(sets)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([len(own) for own in sets], pa.int64()), *(pa.array(words_of[:, k].copy()) for k in range(SKETCH_LONGS))], schema=schema)

    return run


def _verify(words: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, None
        for batch in batches:
            role, group, cls = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("role", "a", "cls"))
            links: list[tuple[int, int]] = []
            for i, _, data, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
                for r, own in enumerate(shingle_sets(data, offsets, words), i):
                    if role[r] == 0:
                        pivot, held = group[r], own
                    elif pivot == group[r]:
                        common = np.isin(own, held, assume_unique=True).sum() if len(own) <= len(held) else np.isin(held, own, assume_unique=True).sum()
                        if common and den * int(common) >= num * (len(own) + len(held) - int(common)):
                            links.append((int(pivot), int(cls[r])))
            yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=schema)

    return run


def near_sketches(num: int, den: int) -> Column:
    """Whether a pair of sketches x and y leaves open that their sets reach the threshold: the distance of two sketches can't
    exceed the symmetric difference, which can't exceed what the sizes allow."""
    distance = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SKETCH_LONGS)), F.lit(0))
    return (F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num) & (distance * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num))


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of the candidate pairs (a, b) those that reach the threshold; texts: cls, text.

    A pivot a is sent once to each of its salted groups, its partners follow in order, so a task holds one set at a time.
    """
    large = staged(pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_PARTNERS).alias("salts")).where("salts > 1"), "large-pivots")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")
    pairs = pairs.join(large, "a", "left").select("a", "b", salt.alias("salt"))
    asked = pairs.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("cls"))
    asked = asked.union(pairs.select("a", "salt", F.lit(1), F.col("b")))
    rows = staged(asked, "asked").join(texts, "cls").select("a", "salt", "role", "cls", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(_verify(words, num, den), "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(cls, root) of every node of the links (a, b), root being its component's least node, by alternating stars."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), name)
    while True:
        rows = edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), name, rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(others.unionByName(least.select("u", F.col("m").alias("v"))), name, rows)
        drop_staged(edges, large)
        edges = small
        # Done when every node hangs from one root and no root hangs from another node.
        ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")).distinct())
        open_ends = ends.groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y"), F.count_if(F.col("v").isNull()).alias("roots"))
        if not open_ends.where("x <> y OR (x IS NOT NULL AND roots > 0)").limit(1).coalesce(1).count():
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("cls"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).distinct().unionByName(roots)


def _sized(docs: DataFrame, words: int, bits: int) -> tuple[DataFrame, frozenset[int]]:
    """doc_id, n and cls of every document, staged, and the classes that different sets had by chance."""
    sizes = staged(docs.mapInArrow(_sizes(words, bits), "doc_id long, n long, cls long, check long"), "sizes")
    several = sizes.groupBy("cls").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y")
    shared = frozenset(r.cls for r in several.select("cls").limit(COLLISIONS).collect())
    if len(shared) == COLLISIONS:
        raise ValueError("too many different sets have one class")
    if shared:
        sizes = staged(sizes.withColumn("cls", F.when(F.col("cls").isin(list(shared)), F.col("check")).otherwise(F.col("cls"))), "sizes")
    return sizes.select("doc_id", "n", "cls"), shared


def _joined(docs: DataFrame, words: int, num: int, den: int, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame, frozenset[int]]:
    """Staged tables: doc_id, n and cls of every document; cls and root of every linked class; cls and text of those and
    others. At last the classes that several sets had."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    sizes, shared = _sized(docs, words, bits)
    parts = docs.mapInArrow(_parts(words, num, den, bits, shared), "part long, cls long")
    in_part = W.partitionBy("part").orderBy("cls")
    met = staged(parts.withColumn("first", F.first("cls").over(in_part)).where("cls <> first").select("part", "first", "cls"), "met")
    rows = met.count()
    members = staged(met.select("part", "cls").unionByName(met.select("part", F.col("first").alias("cls"))).distinct(), "unweighed", rows)
    drop_staged(met)
    # The more a set shares with others, the more likely it links them: it leads the groups of its parts.
    weight = members.groupBy("part").agg(F.count("*").alias("size")).join(members, "part").groupBy("cls").agg(F.sum("size").alias("weight"))
    unweighed, members = members, staged(members.join(weight, "cls").select("part", "cls", "weight"), "members", rows)
    drop_staged(unweighed)
    lead = members.groupBy("part").agg(F.max(F.struct("weight", "cls")).alias("lead")).select("part", F.col("lead.cls").alias("a"))
    pairs = staged(members.join(lead, "part").where("cls <> a").select("a", F.col("cls").alias("b")).distinct(), "pairs", rows)

    wanted = members.select("cls").distinct()
    chosen = sizes.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(wanted, "cls")
    texts = docs.join(chosen, "doc_id")
    repeated = sizes.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:  # rows may share a doc_id but not a text
        texts = texts.select("text", "cls").mapInArrow(_own_class(words, bits, shared), "cls long, text string").dropDuplicates(["cls"])
    texts = staged(texts.select("cls", "text"), "texts")

    # The dense sketches sift the pairs before any text is dealt to them.
    sketches = staged(texts.mapInArrow(_sketches(words), "cls long, n long, " + ", ".join(f"s{k} long" for k in range(SKETCH_LONGS))), "sketches", rows)
    near, met = near_sketches(num, den), pairs
    pairs = met.join(sketches.alias("x"), F.col("a") == F.col("x.cls")).join(sketches.alias("y"), F.col("b") == F.col("y.cls"))
    pairs = staged(pairs.where(near).select("a", "b"), "pairs", rows)
    drop_staged(met)
    count = pairs.count()
    links = staged(verified(pairs, texts, words, num, den), "links", count, 5_000)
    rooted = staged(components(links), "rooted", rows)
    drop_staged(links)
    # In parts whose members are not of one component yet, the sketches sift the pairs that were not compared.
    by_weight = W.partitionBy("part").orderBy(F.desc("weight"), F.desc("cls"))
    for low, high in ((1, LEADERS), (LEADERS, None)):
        placed = members.join(rooted, "cls", "left").select("part", "cls", "weight", F.coalesce("root", "cls").alias("root"))
        split = placed.groupBy("part").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        ranked = placed.join(split.select("part"), "part").withColumn("rank", F.row_number().over(by_weight) - 1).drop("weight")
        opened = staged(ranked.join(sketches, "cls"), "opened", rows)
        heads = opened.where(F.col("rank") >= low)
        heads = heads.where(F.col("rank") < high) if high else heads
        # Dealt by blocks of heads, each of which meets all that come after it.
        last = F.floor(F.col("rank") / HEAD_BLOCK).cast("int")
        met = F.least(last, F.lit((high - 1) // HEAD_BLOCK)) if high else last
        heads, others = heads.withColumn("block", last), opened.withColumn("block", F.explode(F.sequence(F.lit(0), met)))
        apart = (F.col("x.part") == F.col("y.part")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.rank") < F.col("y.rank")) & (F.col("x.root") != F.col("y.root"))
        more = heads.alias("x").join(others.alias("y"), apart & near).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
        more = staged(more.join(pairs, ["a", "b"], "left_anti"), "pairs", rows)
        if found := more.count():
            links = staged(verified(more, texts, words, num, den), "links", found, 5_000)
            if links.take(1):
                rooted = staged(components(links.unionByName(rooted.select(F.col("cls").alias("a"), F.col("root").alias("b")))), "rooted", rows)
            drop_staged(links)
        drop_staged(opened, more)
    drop_staged(members, pairs, sketches)
    return sizes, rooted, texts, shared


def _placed(sizes: DataFrame, rooted: DataFrame, *more: str) -> DataFrame:
    least = sizes.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    linked = staged(least.join(rooted, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "least"), "least")
    of_root = staged(linked.groupBy("root").agg(F.min("least").alias("component_id")), "of-root")
    named = staged(linked.join(of_root, "root").select("cls", "root", "component_id"), "named")
    drop_staged(linked, of_root)
    return sizes.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def ngram_jaccard_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the components of 'den * intersection >= num * union'.

    bits: of the sets' classes; fewer than 64 only make a test of sets that have one class by chance.
    """
    sizes, rooted, texts, _ = _joined(docs, words, num, den, bits)
    drop_staged(texts)
    return _placed(sizes, rooted)


def _all_pairs(words: int, num: int, den: int, listed: bool):
    """Of each pair of blocks (root, x, y) the links (a, b), or for each class the documents linked with it."""
    names = ("a", "b") if listed else ("cls", "linked")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def links_of(x: int, y: int, rows: list[tuple[int, int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        side, cls, copies = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        size = np.array([len(r[3]) for r in rows], np.int64)
        ids = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)[1]
        begin = np.concatenate([[0], np.cumsum(size)])
        held, first = np.zeros(int(ids.max()) + 1, np.uint8), int((side == 0).sum())
        out, linked, sketch = [], np.zeros(len(rows), np.int64), dense([r[3] for r in rows]).view(np.uint64)
        for i in range(first):
            after = i + 1 if x == y else first
            # The sketches bound the difference from below; only what they leave open is compared, however large the component.
            distance = np.bitwise_count(sketch[after:] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            near = after + np.flatnonzero(distance * (den + num) <= (size[i] + size[after:]) * (den - num))
            if not len(near):
                continue
            n = size[near]
            starts = np.cumsum(n) - n
            at = np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(begin[near], n)
            own = ids[begin[i] : begin[i + 1]]
            held[own] = 1
            common = np.add.reduceat(held[ids[at]], starts, dtype=np.int64)
            held[own] = 0
            met = near[den * common >= num * (size[i] + n - common)]
            if listed:
                out.append(np.sort(np.stack([np.full(len(met), cls[i]), cls[met]], 1), 1))
            linked[i] += copies[met].sum()
            linked[met] += copies[i]
        if listed:
            both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            return both[:, 0].copy(), both[:, 1].copy()
        return cls[linked > 0], linked[linked > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            root, x, y, side, cls, copies = (batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(6))
            done: list[tuple[np.ndarray, np.ndarray]] = []
            for i, _, data, offsets in blocks(batch.column(6)):
                for r, own in enumerate(shingle_sets(data, offsets, words), i):
                    if key != (now := (root[r], x[r], y[r])):
                        if rows:
                            done.append(links_of(key[1], key[2], rows))
                        key, rows = now, []
                    rows.append((side[r], cls[r], copies[r], own))
            if done:
                yield pa.record_batch([pa.array(np.concatenate([d[k] for d in done])) for k in (0, 1)], schema=schema)
        if rows:
            yield pa.record_batch([pa.array(c) for c in links_of(key[1], key[2], rows)], schema=schema)

    return run


def _compared(sizes: DataFrame, rooted: DataFrame, texts: DataFrame, words: int, num: int, den: int, listed: bool) -> DataFrame:
    """Every pair of a component's classes sifted by dense sketches, and what they leave open compared, in pairs of blocks;
    blocks whose sizes lie too far apart don't meet.

    A component of up to BLOCK_SETS classes is one block. A larger one is cut by size and then by hash, without a sort of
    the component in one task.
    """
    copies = sizes.where("n > 0").groupBy("cls").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    members = rooted.join(copies, "cls")
    blocks_for = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES))
    large = members.groupBy("root").agg(blocks_for.alias("k")).where("k > 1").select("root", F.lit(True).alias("large"))
    band = F.when(F.col("large"), F.floor(F.log(F.col("n")) / math.log(1.1))).otherwise(0).cast("long")
    members = members.join(large, "root", "left").withColumn("band", band)
    cuts = members.where("large").groupBy("root", "band").agg(blocks_for.alias("cuts"))
    cut = F.when(F.col("large"), F.pmod(F.xxhash64("cls"), F.col("cuts"))).otherwise(0)
    members = staged(members.join(cuts, ["root", "band"], "left").select("root", "cls", "n", "copies", (F.col("band") * (1 << 40) + cut).alias("block")), "in-blocks")
    found = members.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    fits = (F.col("x.root") == F.col("y.root")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.high") * den >= F.col("y.low") * num) & (F.col("y.high") * den >= F.col("x.low") * num)
    met = staged(found.alias("x").join(found.alias("y"), fits).select("x.root", F.col("x.block").alias("x"), F.col("y.block").alias("y")), "block-pairs")
    own = members.select("root", "cls", "copies", "block")
    asked = own.join(met, (own.root == met.root) & (own.block == met.x)).select(own.root, "x", "y", F.lit(0).alias("side"), "cls", "copies")
    asked = asked.unionByName(own.join(met.where("x < y"), (own.root == met.root) & (own.block == met.y)).select(own.root, "x", "y", F.lit(1).alias("side"), "cls", "copies"))
    rows = asked.join(texts, "cls").select("root", "x", "y", "side", "cls", "copies", "text")
    rows = rows.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "side")
    return rows.mapInArrow(_all_pairs(words, num, den, listed), "a long, b long" if listed else "cls long, linked long")


def class_links(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links, in two tables: doc_id, cls of every document, and each linked pair of different classes (a < b) once.

    Two documents are linked if their classes are, or if they are of one class that isn't the empty set's (cls null).
    """
    sizes, rooted, texts, _ = _joined(docs, words, num, den)
    return sizes.select("doc_id", F.when(F.col("n") > 0, F.col("cls")).alias("cls")), _compared(sizes, rooted, texts, words, num, den, True)


def ngram_jaccard_links(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """What ngram_jaccard_join gives, and n_links: with how many other documents each one is linked itself.

    The pairs are counted where they are compared, so the rows made don't grow as the square of a group.
    """
    sizes, rooted, texts, _ = _joined(docs, words, num, den)
    linked = _compared(sizes, rooted, texts, words, num, den, False).groupBy("cls").agg(F.sum("linked").alias("linked"))
    counted = sizes.where("n > 0").groupBy("cls").agg((F.count("*") - 1).alias("same")).join(linked, "cls", "left")
    counted = staged(counted.select("cls", (F.col("same") + F.coalesce("linked", F.lit(0))).alias("n_links")), "counted")
    placed = _placed(sizes.join(counted, "cls", "left"), rooted, "n_links")
    return placed.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _own_class(words: int, bits: int, shared: frozenset[int]):
    """(text, cls) to cls and the text, of those rows whose text has that class."""
    schema = pa.schema([("cls", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, want = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, data, offsets in blocks(text):
                keep = [i + k for k, own in enumerate(shingle_sets(data, offsets, words)) if class_of(own, bits, shared) == want[i + k]]
                yield pa.record_batch([pa.array(want[keep], pa.int64()), text.take(pa.array(keep, pa.int64())).cast(pa.string())], schema=schema)

    return run


def _marked(words: int, at: int, shared: frozenset[int]):
    """Rows with the class of the text in column `at` behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [class_of(own, 64, shared) for _, _, data, offsets in blocks(batch.column(at)) for own in shingle_sets(data, offsets, words)]
            yield pa.record_batch([*batch.columns, pa.array(cls, pa.int64())], names=[*batch.schema.names, "cls"])

    return run


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies: of each component one row with the least doc_id stays, as it is.

    Rows without a doc_id stay. Of rows that share a doc_id each stands for its own text: if the least doc_id of a
    component has several rows in it, the one of the least class stays.
    """
    sizes, rooted, texts, shared = _joined(docs, words, num, den)
    drop_staged(texts)
    joined, columns, own = _placed(sizes, rooted, "cls", "root"), docs.columns, fresh_name("own", docs.columns)
    whole, none = docs.where(F.col("doc_id").isNotNull()), docs.where(F.col("doc_id").isNull())
    if not sizes.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # Those that go are the fewer, and written first, so that texts are not dealt for a short table.
        gone = staged(joined.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(f"{own}_id")), "gone")
        return whole.join(gone, F.col("doc_id") == F.col(f"{own}_id"), "left_anti").unionByName(none)
    # Rows share a doc_id: of each component the least row by doc_id and class, and of equal rows one.
    alone = F.when(F.col("root").isNull(), F.col("doc_id"))
    first = joined.groupBy("root", alone.alias("alone")).agg(F.min(F.struct("doc_id", "cls")).alias("first")).select("first.doc_id", "first.cls")
    lead = first.select(F.col("doc_id").alias(f"{own}_id"), F.col("cls").alias(f"{own}_cls")).distinct()
    marked = whole.mapInArrow(_marked(words, columns.index("text"), shared), T.StructType([*whole.schema.fields, T.StructField(f"{own}_class", T.LongType())]))
    kept = marked.join(lead, (F.col("doc_id") == F.col(f"{own}_id")) & (F.col(f"{own}_class") == F.col(f"{own}_cls")), "left_semi")
    kept = kept.dropDuplicates(["doc_id", f"{own}_class"]).drop(f"{own}_class")
    return kept.select(*columns).unionByName(none)

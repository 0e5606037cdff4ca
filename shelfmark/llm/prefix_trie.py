"""The prefix trie of conversations, by chained digests.

A conversation's prefix of d turns is named by a SHA-256 digest that chains the digest of the prefix of d - 1 turns with
that of turn d, so equal prefixes have equal names in any task. Every prefix is one row; rows of one (depth, digest) are the
members of a node.

Subtree sums explode nodes to all their ancestors. They explode not each node but each run: the nodes below each other that
have the same members, hence the same least one, hence all lie on one path. A conversation of its own to the end is one
run, however many turns it has. The exploded rows are at most twice the turns of the table: each run can be given a
conversation of its own that passes it (one that ends in it, or, where it forks, one in a branch that no run above took),
and that conversation has at least as many turns as the run has ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import drop_staged, staged

_ROOT = hashlib.sha256(b"").digest()
#: A conversation's turns; ascending, null first.
_ORDER = ["turn", "role", "leaf"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Words of a turn's text.
_WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of joined ids that a row holds at most, besides one id.
_SEGMENT = 1 << 16


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, leaf (digest of role and text), words (of the text). Null role or text is empty; rows without a conversation are left out."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    leaf = F.unhex(F.sha2(F.concat(F.lpad(F.hex(F.octet_length(r)), 8, "0"), r, t), 256))
    return rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"), leaf.alias("leaf"), F.regexp_count(t, F.lit(_WORD)).cast("long").alias("words"))


def with_donors(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt: c takes the first h turns of c - c % every, then its own after its first h; h = crc32(c) % most.

    Adds part (0: from the donor, 1: own) and skip (h) to the columns of `turns`. A donor's first turns go to `every` conversations at
    most, so the join multiplies no group. Own turns that are skipped stay in, as they say that the conversation exists.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    convs = own.select("conv_id").distinct().select("conv_id", h.alias("skip"), (F.col("conv_id") - F.col("conv_id") % every).alias("donor"))
    first = Window.partitionBy("conv_id").orderBy(*_ORDER)
    given = own.where(F.col("conv_id") % every == 0).withColumn("k", F.row_number().over(first)).where(F.col("k") < most)
    given = given.withColumnRenamed("conv_id", "donor").join(convs, "donor").where(F.col("k") <= F.col("skip"))
    kept = own.select("*", F.lit(1).alias("part"), h.alias("skip"))
    return given.select("conv_id", "turn", "role", "leaf", "words", F.lit(0).alias("part"), "skip").unionByName(kept)


def prefixes(turned: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent (digest), words (of the last turn), ends: a row for each prefix, the empty one too.

    turned: the columns of `turns` with part and skip. Rows of a conversation stream through one task in order, one at a time.
    """

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "digest", "parent", "words", "ends"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        conv, held, seen, out = None, None, 0, []

        def batch() -> pa.RecordBatch:
            done, out[:] = out[:], []
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)

        for b in batches:
            for c, part, leaf, words, skip in zip(*(b[x].to_pylist() for x in ("conv_id", "part", "leaf", "words", "skip"))):
                if c != conv:
                    if held:
                        out.append((*held, True))
                    conv, seen, held = c, 0, (c, 0, _ROOT, None, 0)
                seen += part
                if part == 0 or seen > skip:
                    out.append((*held, False))
                    held = (c, held[1] + 1, hashlib.sha256(held[2] + leaf).digest(), held[2], words)
            if len(out) > 10_000:
                yield batch()
        if held:
            out.append((*held, True))
        if out:
            yield batch()

    dealt = turned.repartition("conv_id").sortWithinPartitions("conv_id", "part", *_ORDER)
    return dealt.select("conv_id", "part", "leaf", "words", "skip").mapInArrow(chained, "conv_id long, depth long, digest binary, parent binary, words long, ends boolean")


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, digest, ends_sha256 from (depth, digest, conv_id): SHA-256 of the decimal ids in ascending order, joined by commas.

    Ids are sorted by ranges, so that a node where very many end is spread over tasks; these join ids to segments of bounded
    size, and only segments meet in one task, which hashes them as they stream.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size, out = None, 0, [], 0, []

        def close() -> None:
            if ids:
                out.append((*node, first, ",".join(ids)))

        for b in batches:
            for d, g, c in zip(*(b[x].to_pylist() for x in ("depth", "digest", "conv_id"))):
                if node != (d, g) or size >= _SEGMENT:
                    close()
                    node, first, ids, size = (d, g), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(out) > 1000:
                yield _columns(out, [pa.int64(), pa.binary(), pa.int64(), pa.string()], ["depth", "digest", "first", "ids"])
                out = []
        close()
        if out:
            yield _columns(out, [pa.int64(), pa.binary(), pa.int64(), pa.string()], ["depth", "digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for b in batches:
            for d, g, ids in zip(*(b[x].to_pylist() for x in ("depth", "digest", "ids"))):
                if node == (d, g):
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (d, g), hashlib.sha256()
                sha.update(ids.encode())
            if len(out) > 10_000:
                yield _columns(out, [pa.int64(), pa.binary(), pa.string()], ["depth", "digest", "ends_sha256"])
                out = []
        if node:
            out.append((*node, sha.hexdigest()))
            yield _columns(out, [pa.int64(), pa.binary(), pa.string()], ["depth", "digest", "ends_sha256"])

    sorted_ = ends.repartitionByRange("depth", "digest", "conv_id").sortWithinPartitions("depth", "digest", "conv_id")
    parts = sorted_.select("depth", "digest", "conv_id").mapInArrow(joined, "depth long, digest binary, first long, ids string")
    parts = parts.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first")
    return parts.mapInArrow(hashed, "depth long, digest binary, ends_sha256 string")


def _columns(rows: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie over `prefixes`: a row for each, with what its subtree sums to.

    conv_id (least member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes
    of the subtree, itself included), saved_tokens (over the subtree: words of a node's last turn for each member but one),
    ends_sha256 (of the members that end there). An empty table has no node, not even the root. Long texts count whole;
    conversations of any length stream through.
    """
    paths = staged(paths, "trie-prefixes")
    # Every column but the counts is the same for all members of a node.
    nodes = staged(paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("words").alias("words")), "trie-nodes")
    own = (F.col("n_convs") - 1) * F.col("words")

    # A run: nodes with the same members. Its nodes lie on the path of its least member, from `top` down to `bottom`.
    runs = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.max_by("digest", "depth").alias("digest"), F.min_by("parent", "depth").alias("parent"), F.sum(own).alias("saved"))
    runs = staged(runs, "trie-runs")
    unlinked = runs
    below = runs.where(F.col("top") > 0).groupBy((F.col("top") - 1).alias("bottom"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("children"))
    above = runs.select((F.col("bottom") + 1).alias("top"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    runs = runs.join(below, ["bottom", "digest"], "left").join(above, ["top", "parent"], "left")
    runs = staged(runs.select("conv_id", "n_convs", "top", "bottom", "digest", "parent_conv_id", "saved", F.coalesce("children", F.lit(0)).cast("long").alias("children")), "trie-linked")

    # Each run's ancestors: the runs whose bottom lies on the path of its least member, above its top.
    leads = runs.select("conv_id").distinct()
    passed = paths.select("conv_id", F.col("depth").alias("bottom"), "digest").join(leads, "conv_id", "left_semi")
    passed = passed.join(runs.select("bottom", "digest", F.col("conv_id").alias("a_conv"), F.col("n_convs").alias("a_convs")), ["bottom", "digest"])
    parts = runs.select("conv_id", "saved", "children", F.col("bottom").alias("own_bottom")).join(passed, "conv_id").where(F.col("bottom") <= F.col("own_bottom"))
    sums = parts.groupBy(F.col("a_conv").alias("conv_id"), F.col("a_convs").alias("n_convs")).agg(F.sum("saved").alias("under"), F.sum((F.col("children") == 0).cast("long")).alias("n_leaves"))

    whole = runs.select("conv_id", "n_convs", "top", "bottom", "parent_conv_id", "children").join(sums, ["conv_id", "n_convs"])
    # A node's subtree: that of its run without the run's nodes above it.
    before = F.coalesce(F.sum(own).over(Window.partitionBy("conv_id", "n_convs").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = nodes.withColumn("before", before).join(whole, ["conv_id", "n_convs"])
    out = out.join(ends_digests(paths.where("ends")), ["depth", "digest"], "left")
    out = staged(out.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") == F.col("bottom"), F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves", (F.col("under") - F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")), "trie")
    drop_staged(paths, nodes, runs, unlinked)
    return out


def conversation_trie(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of the conversations that `with_donors` rebuilds from rows (conv_id, turn, role, text); columns as in `trie`.

    Turns go by turn, null first, then role, then the digest of role and text, so that repeated rows and ties have one order; repeated rows are
    turns of their own. Null role or text is empty, rows without a conv_id are left out, other columns are not looked at.
    A conversation without turns is a member of the root only.
    """
    return trie(prefixes(with_donors(turns(rows), every, most)))

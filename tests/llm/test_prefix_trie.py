from __future__ import annotations

import hashlib
import random
import re
import zlib

from shelfmark.llm.prefix_trie import conversation_trie, ends_digests

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: (*y[:3], hashlib.sha256(f"{len(y[2].encode()):08X}{y[2]}{y[3]}".encode()).digest()))] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children, out = {}, set()
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def total(p):
        leaves, saved, todo = 0, 0, [p]
        while todo:
            q = todo.pop()
            leaves += q not in children
            saved += (len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
            todo += children.get(q, [])
        return leaves, saved

    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *total(p), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_random_tries(spark):
    rng = random.Random(11)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b b", " c\tc  c ", ""])))
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, None, "user", "x"), (5, 3, "user", "y y"), (5, 3, "user", "y y"), (5, 3, "tool", "z"), (20, 0, "user", "only"), (21, 0, "user", "one"), (1001, 0, "user", "no donor"), (24, 0, None, ""), (25, 7, "", None)]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], SCHEMA + ", depth int, digest binary")
    assert got(conversation_trie(df)) == brute(rows)


def test_long_conversations_that_fork_late(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 150 * (c % 3 + 1) else f"{c} {t}") for c in range(40, 70) for t in range(400)]
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_empty(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_that_end_in_one_node_come_in_segments(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("1L AS depth", "unhex('AB') AS digest", "id AS conv_id")
    want = hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()
    assert [r.ends_sha256 for r in ends_digests(df).collect()] == [want]

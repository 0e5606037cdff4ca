"""Matching, clusters, archives and streams against brute force on small fixtures."""

from __future__ import annotations

import gzip
import random
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import clusters as C
from shelfmark.operators import export as X
from shelfmark.operators import lifecycle as L
from shelfmark.operators import matching as M
from shelfmark.sources import archive as S
from shelfmark.streaming import daily

ITEMS = "id long, store_id int, title string, author string, publisher string, editions array<string>, set_volumes int, volume int, pub_ym string, isbn13 string, list_price long"
BASE = ("longtitleofabook", "jane", "acme", [], None, None, "2020-01", None, 1000)


def item(k, store, **change):
    names = ["title", "author", "publisher", "editions", "set_volumes", "volume", "pub_ym", "isbn13", "list_price"]
    return (k, store, *(change.get(n, v) for n, v in zip(names, BASE, strict=True)))


GATES = [
    ({}, {"store_id": 1}, "store"), ({"isbn13": "1"}, {"isbn13": "2"}, "isbn"), ({"isbn13": "1"}, {"isbn13": "1", "title": "zzz", "publisher": "other"}, None), ({"set_volumes": 3}, {}, "set_volumes"),
    ({}, {"title": "qqqqwwwweeee"}, "title_bound"), ({"editions": ["revised"]}, {}, "edition"), ({}, {"publisher": "zenith"}, "publisher"), ({}, {"pub_ym": "2020-02", "list_price": None}, "month"),
    ({}, {"pub_ym": "2020-02"}, None), ({"volume": 1}, {"volume": 2}, "volume"), ({}, {"list_price": 900}, "price"), ({}, {"title": "longtitleofabook2"}, None), ({}, {"author": None}, None),
]


def test_gates_in_order(spark):
    rows, pairs = [], []
    for k, (x, y, _) in enumerate(GATES):
        y = dict(y)
        rows += [item(2 * k, 1, **x), item(2 * k + 1, y.pop("store_id", 2), **y)]
        pairs.append((2 * k, 2 * k + 1))
    got = {r.a // 2: r for r in M.scored(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, ITEMS)).collect()}
    assert [got[k].rejected_by for k in range(len(GATES))] == [g for *_, g in GATES]
    assert (got[2].score, got[2].decision) == (100, "auto_high")
    assert (got[8].score, got[8].decision) == (90, "auto_high")
    assert (got[12].score, got[12].decision) == (75, "auto_low")


def test_soft_editions_pass_when_all_else_is_equal(spark):
    items = spark.createDataFrame([item(1, 1, editions=["complete"]), item(2, 2)], ITEMS)
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [M.scored(pairs, items, soft).first().rejected_by for soft in ((), ("complete",))] == ["edition", None]


def test_similarity(spark):
    texts = ["", "a", "ab", "abcabc", "cabbage", "longer text", "longer texts", None]
    rows = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string").select("x", "y", M.similarity(F.col("x"), F.col("y")).alias("s"))
    grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)} or ({t} - {""})
    for r in rows.collect():
        if r.x is None or r.y is None:
            assert r.s == 0
        elif r.x == r.y:
            assert r.s == 1
        else:
            union = grams(r.x) | grams(r.y)
            assert r.s == pytest.approx((SequenceMatcher(None, r.x, r.y).ratio() + len(grams(r.x) & grams(r.y)) / len(union)) / 2)


def test_blocks(spark):
    rows = [item(k, 1 + k % 3, title=t, author=a) for k, (t, a) in enumerate([("abcd1", "x"), ("abcd2", None), ("zzzz", "x"), ("yyyy", None), (None, "w")])]
    got = M.block_pairs(spark.createDataFrame(rows, ITEMS)).collect()
    assert sorted(map(tuple, got)) == [(0, 1), (0, 2)]
    assert M.block_pairs(spark.createDataFrame(rows, ITEMS), most=1).collect() == []


LINKS = "a long, b long, score int, decision string"
MANUAL = "a long, b long, decision string"


def members(df):
    return {r.id: r.root for r in df.collect()}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1, 90, "auto_high") for k in range(1, 40)] + [(50, 60, 90, "auto_high"), (60, 55, 70, "auto_low")], LINKS)
    items = spark.createDataFrame([(k,) for k in [*range(1, 41), 50, 55, 60, 99]], "id long")
    assert members(C.components(links, items)) == {k: 1 for k in range(1, 41)} | {50: 50, 55: 50, 60: 50, 99: 99}
    assert members(C.components(links.limit(0), items)) == {r.id: r.id for r in items.collect()}


def test_repair(spark):
    rows = [item(1, 1), item(2, 2, publisher=None), item(3, 3, publisher="zenith"), item(4, 1, volume=1), item(5, 2), item(6, 3, volume=2), item(7, 1), item(8, 2), item(9, 3, publisher="zenith"), item(10, 1)]
    items = spark.createDataFrame(rows, ITEMS)
    links = spark.createDataFrame([(1, 2, 80, "auto_low"), (2, 3, 90, "auto_high"), (4, 5, 90, "auto_high"), (5, 6, 80, "auto_low"), (7, 8, 90, "auto_high"), (7, 9, 0, "manual_merge"), (8, 10, 95, "auto_high"), (7, 10, 95, "auto_high")], LINKS)
    manual = spark.createDataFrame([(10, 7, "manual_split"), (7, 9, "manual_merge")], MANUAL)
    start = C.components(links, items)
    # 2 goes with 3, its better link; 5 with 4; 7 and 9 by hand; 8 with 10, as 7 may not be with 10.
    assert members(C.repair(start, links, manual, items)) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7, 9: 7, 8: 8, 10: 8}
    # Publishers and volumes split clusters of any size, hand-made splits those of up to `most`.
    large = C.repair(start, links, manual, items, most=1)
    assert members(large) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 7, 10: 7}
    assert [tuple(r) for r in C.left_together(large, manual).collect()] == [(7, 7, 10)]


def test_one_per_store(spark):
    items = spark.createDataFrame([item(1, 1), item(2, 2), item(3, 2), item(4, 3), item(5, 3)], ITEMS)
    links = spark.createDataFrame([(1, 2, 80, "auto_low"), (1, 3, 90, "auto_high"), (2, 3, 99, "auto_high")], LINKS)
    assert members(C.one_per_store(C.components(links, items), links, items)) == {1: 1, 3: 1, 2: 2, 4: 4, 5: 5}
    # What a person joined stays, and nothing else of that store, however well it fits.
    links = spark.createDataFrame([(1, 2, 0, "manual_merge"), (1, 3, 95, "auto_high"), (3, 4, 95, "auto_high")], LINKS)
    assert members(C.one_per_store(C.components(links, items), links, items)) == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5}
    links = spark.createDataFrame([(2, 3, 0, "manual_merge"), (1, 3, 95, "auto_high")], LINKS)
    assert members(C.one_per_store(C.components(links, items), links, items)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_fill_needs_pairs_that_were_accepted(spark):
    items = spark.createDataFrame([item(1, 1), item(3, 2), item(4, 3), item(5, 3)], ITEMS)
    own = spark.createDataFrame([(1, 1), (3, 1), (4, 4), (5, 5)], "id long, root long")
    fill = lambda kind, split=(): members(C.fill_missing(own, spark.createDataFrame([(1, 4, 75, kind), (3, 4, 72, "auto_low"), (1, 5, 90, "auto_high"), (3, 5, 71, "auto_low")], LINKS), items, spark.createDataFrame(list(split), MANUAL)))
    assert fill("auto_low") == {1: 1, 3: 1, 4: 1, 5: 5}
    assert fill("rejected") == fill("auto_low", [(4, 1, "manual_split")]) == {1: 1, 3: 1, 5: 1, 4: 4}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fill_in_order_of_the_clusters(spark, seed):
    rng = random.Random(seed)
    store, root = {}, {}
    for k in range(0, 120, 2):
        a, b = rng.sample((1, 2, 3), 2)
        store |= {k: a, k + 1: b}
        root |= {k: k, k + 1: k}
    for k in range(120, 170):
        store[k], root[k] = rng.choice((1, 2, 3)), k
    score = {(a, b): (rng.choice((65, 70, 70, 75, 90)), rng.choice(("auto_low", "auto_high", "rejected"))) for a in range(120) for b in range(120, 170) if rng.random() < 0.4}
    split = {(b, a) for a, b in score if rng.random() < 0.05}
    want, free = dict(root), [k for k in root if k >= 120]
    for k in range(0, 120, 2):
        best = None
        for c in free:
            pair = [score.get((i, c), (0, "rejected")) for i in (k, k + 1)]
            if store[c] not in (store[k], store[k + 1]) and all(s >= 70 and d != "rejected" for s, d in pair) and not any((c, i) in split for i in (k, k + 1)):
                weaker = min(s for s, _ in pair)
                if best is None or weaker > best[0]:
                    best = weaker, c
        if best:
            want[best[1]] = k
            free.remove(best[1])
    items = spark.createDataFrame([item(k, s) for k, s in store.items()], ITEMS)
    pairs = spark.createDataFrame([(a, b, s, d) for (a, b), (s, d) in score.items()], LINKS)
    hand = spark.createDataFrame([(*p, "manual_split") for p in split], MANUAL)
    assert members(C.fill_missing(spark.createDataFrame(list(root.items()), "id long, root long"), pairs, items, hand)) == want


def title_rows(seed, n=140):
    rng = random.Random(seed)
    words = ["sand", "salt", "stone", "river", "a", "of", "und", "é"]
    titles = ["".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n // 2)]
    return [item(k, 1 + k % 3, title=rng.choice([None, "", *titles, *titles]), author=rng.choice(["ann b", "ann bo", "anne b", "ánn b", "zed", None]), isbn13=rng.choice([None, None, None, "1", "2"])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_any_size(spark, seed):
    rows = title_rows(seed)
    keys = {r[0]: {("t", r[2][:4]) if r[2] is not None else None, ("a", r[3]) if r[3] else None} - {None} for r in rows}
    grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)} or ({t} - {""})
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and keys[x[0]] & keys[y[0]]:
                same_isbn = x[9] is not None and x[9] == y[9]
                g, h = grams(x[2] or ""), grams(y[2] or "")
                head = x[2] and y[2] and min(len(x[2]), len(y[2])) >= 4 and (x[2].startswith(y[2]) or y[2].startswith(x[2]))
                if same_isbn or head or (g and h and 5 * len(g & h) >= len(g | h)):
                    want.add((x[0], y[0]))
    items = spark.createDataFrame(rows, ITEMS).repartition(4)
    assert {tuple(r) for r in M.block_pairs(items, most=None).collect()} == want
    # What is accepted of them is what is accepted of all pairs.
    accepted = lambda p: {(r.a, r.b): r.score for r in M.scored(p, items).where("rejected_by IS NULL").collect()}
    assert accepted(M.block_pairs(items, most=None)) == accepted(M.block_pairs(items, most=10**6)) != {}


def test_pairs_of_blocks_are_made_once(spark, monkeypatch):
    """Titles with many items and keys with many titles are cut, and no pair is dealt once more to find its like."""
    monkeypatch.setattr(M, "IDS_A_ROW", 2)
    monkeypatch.setattr(M, "ROWS_A_BLOCK", 3)
    rows = [item(k, 1 + k % 3, title=f"salt{'abcdefg'[k % 7] * (k % 4)}", author=f"w{k % 2}", isbn13=str(k % 5)) for k in range(60)]
    found = M.block_pairs(spark.createDataFrame(rows, ITEMS).repartition(3), most=None)
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(60) for b in range(a + 1, 60)]
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


@pytest.mark.parametrize("seed", [3, 4])
def test_candidates_to_fill_with(spark, seed):
    items = spark.createDataFrame(title_rows(seed, 90), ITEMS).repartition(4)
    x, y = items.select(F.col("id").alias("a")), items.select(F.col("id").alias("b"))
    every = M.scored(x.join(y, F.col("a") < F.col("b")), items).where("decision <> 'rejected' AND score >= 70")
    want = {(r.a, r.b) for r in every.collect()}
    assert want and want <= {tuple(r) for r in M.fill_candidates(items, 70).collect()}


def test_fill_without_a_shared_block(spark):
    far = "zebra crossings of the old town"
    rows = [item(1, 1, title=far, author=None), item(2, 2, title=far, author="w"), item(3, 3, title="x" + far, author="v"), item(4, 3, title="quite another book")]
    items = spark.createDataFrame(rows, ITEMS)
    own = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, root long")
    assert members(M.filled(own, items, spark.createDataFrame([], MANUAL))) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_one_decision_a_pair(spark):
    pairs = spark.createDataFrame([(1, 2, 90, "auto_high"), (3, 4, 90, "auto_high")], LINKS)
    dated = spark.createDataFrame([(2, 1, "manual_merge", 5), (1, 2, "manual_split", 9), (3, 4, "manual_split", 1), (4, 3, "manual_merge", 2), (5, 6, "manual_merge", 1)], MANUAL + ", decided_at int")
    assert {(r.a, r.b): r.decision for r in M.with_decisions(pairs, dated).collect()} == {(3, 4): "manual_merge", (5, 6): "manual_merge"}
    assert {(r.a, r.b) for r in M.with_decisions(pairs, dated.drop("decided_at")).collect()} == {(5, 6)}


def test_price_gate_of_trusted_stores(spark):
    items = spark.createDataFrame([item(1, 1), item(2, 2, list_price=900), item(3, 3, list_price=800)], ITEMS)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {r.b: r.rejected_by for r in M.scored(pairs, items, price_stores=(1, 2)).collect()} == {2: "price", 3: None}


def test_archive(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([("2024-01-01", 1, None), ("2024-01-01", 2, 'q"é'), ("2024-01-02", 3, "x"), ("2024-01-02", 3, "x")], "day string, k int, t string").withColumn("day", F.to_date("day"))
    manifest = S.write_archive(rows, "day", path)
    assert {r.day: r.intact for r in S.verified(spark, path, manifest).collect()} == {"2024-01-01": True, "2024-01-02": True}
    back = S.restored(spark, path, "day date, k int, t string", "2024-01-01", "2024-01-31")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(ValueError, match="31 days"):
        S.restored(spark, path, "k int", "2024-01-01", "2024-03-01")
    # A changed file: its day stays, the other may go.
    file = next(Path(path).glob("day=2024-01-02/*.gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b'"x"', b'"y"')))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    checks = S.verified(spark, path, manifest)
    assert sorted(r.k for r in S.droppable(rows, "day", checks).collect()) == [1, 2]


def test_replaced_days_and_upserts(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "day string, k int")
    S.replace_days(rows(("a", 1), ("b", 2)), "day", str(tmp_path / "days"))
    S.replace_days(rows(("b", 3)), "day", str(tmp_path / "days"))
    assert sorted((r.day, r.k) for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, S.upserted(rows(("a", 1), ("b", 2)), rows(("b", 9), ("c", 4)), ["day"]).collect())) == [("a", 1), ("b", 9), ("c", 4)]


def test_readable_export(spark, tmp_path):
    schema = "snapshot_date date, store_id int, kind string, unified string, rank int, store_book_id long, sales_point int"
    rows = spark.createDataFrame([("2024-01-01", 1, "online", "all", 2, 7, None), ("2024-01-01", 1, "online", "all", 1, 8, 5)], schema.replace(" date", " string")).withColumn("snapshot_date", F.to_date("snapshot_date"))
    lines = X.readable(rows, spark.createDataFrame([(8, 'A "b", c')], "store_book_id long, title string"), spark.createDataFrame([(1, "One")], "store_id int, store string"))
    X.write_readable(lines, str(tmp_path / "csv"))
    (file,) = Path(tmp_path / "csv").glob("*/*.txt")
    assert file.read_bytes() == b'\xef\xbb\xbfdate,store,kind,list,rank,title,sales\r\n2024-01-01,One,online,all,1,"A ""b"", c",5\r\n2024-01-01,One,online,all,2,,\r\n'


def test_stream(spark, tmp_path):
    folder, path, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    rows = spark.createDataFrame([(1, "2024-01-01 10:00", 1, "view"), (2, "2024-01-01 23:59", 2, "view"), (3, "2024-01-02 00:00", 1, "buy")], "event_id long, ts string, user_id long, event_type string")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.lit(1.0)).withColumn("props", F.lit("{}"))
    folder.mkdir()
    rows.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(folder / "events-1.parquet", index=False)
    for _ in range(2):  # nothing new in the second run
        daily.run_daily(daily.events(spark, str(folder)), path, state)
    assert spark.read.parquet(path).count() == 3
    counts = daily.daily_counts(daily.events(spark, str(folder)))
    run = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((str(r.day), r.event_type, r.n, r.users) for r in spark.table("counted").collect()) == [("2024-01-01", "view", 2, 2), ("2024-01-02", "buy", 1, 1)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.nfkc(F.lit("ｆｕｌｌ　①"))) == "full 1"
    assert one(T.is_isbn13(F.lit("978-0-306-40615-7"))) and not one(T.is_isbn13(F.lit("978-0-306-40615-8")))
    assert one(T.is_isbn10(F.lit("0-306-40615-2"))) and one(T.isbn10_to_13(F.lit("0306406152"))) == "9780306406157"
    assert one(T.volume_number(F.lit("Tale vol. 12"))) == 12 and one(T.volume_number(F.lit("Tale 999"))) is None
    assert one(T.csv_field(F.lit('a,"b"'))) == '"a,""b"""'
    assert one(T.parse_year_month(F.lit("2024. 3."))) == "2024-03"


def test_cascade(spark):
    people = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (5, None, "e"), (6, 4, "f"), (7, 7, "g")], "id long, boss long, name string")
    notes = spark.createDataFrame([(1, 3, None), (2, 5, "old"), (3, None, "none"), (4, 6, "x")], "id long, person long, name string")
    marks = spark.createDataFrame([(1, 3), (2, 5), (3, 6)], "id long, person long")
    # A graph that leads back to people, to any depth; marks go with them, notes keep the name.
    keys = [("people", "boss", "people", None), ("marks", "person", "people", None), ("notes", "person", "people", "name")]
    left, gone = L.cascade({"people": people, "notes": notes, "marks": marks}, keys, "people", spark.createDataFrame([(2,), (99,)], "id long"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert {t: [i for i, in rows(df)] for t, df in gone.items()} == {"people": [2, 3, 4, 6], "marks": [1, 3]}
    assert [r[0] for r in rows(left["people"])] == [1, 5, 7] and rows(left["marks"]) == [(2, 5)]
    assert rows(left["notes"]) == [(1, None, "c"), (2, 5, "old"), (3, None, "none"), (4, None, "f")]
    left, gone = L.cascade({"people": people, "notes": notes, "marks": marks}, keys, "people", spark.createDataFrame([(7,)], "id long"))
    assert rows(gone["people"]) == [(7,)] and rows(left["notes"]) == rows(notes)

"""Names, sides, ordered claims, guards and reports against brute force on small fixtures."""

from __future__ import annotations

import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import audit as U
from shelfmark.operators import clusters as C
from shelfmark.operators import names as N
from shelfmark.plans.staging import shared_folder
from shelfmark.sources import archive as S
from shelfmark.sources.boxes import boxes
from shelfmark.sources.html import products, robots
from shelfmark.sources.robots import rules_for, verdicts


def aliases(spark, *rows):
    return spark.createDataFrame(rows, "spelling string, name string")


def test_variants_and_likeness(spark):
    names = ["otter(loutre)", "otter", "kq(kayku)", "kq", "kayku", "reprint", "house(reprint)", "other(reprint)", "(only)", "", None, "aa[bb]{cc}"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", N.variants(F.col("n"), ("reprint",)).alias("v")).collect()
    told = {r.n: r.v and sorted(r.v) for r in rows}
    assert told["otter(loutre)"] == ["loutre", "otter", "otter(loutre)"] and told["house(reprint)"] == ["house", "house(reprint)"]
    assert told["(only)"] == ["(only)", "only"] and told["aa[bb]{cc}"] == ["aa", "aa[bb]{cc}", "bb", "cc"]
    assert told[""] is None and told[None] is None
    pairs = spark.createDataFrame([("otter(loutre)", "otter"), ("kq", "kayku"), ("house(reprint)", "other(reprint)"), ("acme", "acmes"), ("left", "right"), ("éclair", "eclairs")], "x string, y string")
    plain = {(r.x, r.y): r.sim for r in N.publisher_likeness(pairs, "x", "y", categories=("reprint",)).collect()}
    assert plain["otter(loutre)", "otter"] == 1 and plain["kq", "kayku"] < 0.8 and plain["house(reprint)", "other(reprint)"] < 0.8
    assert plain["acme", "acmes"] == pytest.approx((8 / 9 + 3 / 4) / 2)
    assert plain["éclair", "eclairs"] == pytest.approx((12 / 13 + 5 / 6) / 2)
    hand = {(r.x, r.y): r.sim for r in N.publisher_likeness(pairs, "x", "y", aliases(spark, ("left", "house"), ("right", "house"), ("right", "barn"))).collect()}
    assert hand["left", "right"] == 1


def test_likeness_from_a_floor_on(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    pairs = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    for floor in (0.0, 0.6, 0.8):
        got = {(r.x, r.y): r.sim for r in N.likeness(pairs, "x", "y", floor).collect()}
        assert got == {(x, y): (s if (s := N.alike(x, y)) >= floor else 0.0) for x in texts for y in texts if x != y}
    names = spark.createDataFrame([("é", "e"), ("zoé", "zoe b"), ("a", "b"), ("ab", "ab")], "x string, y string")
    got = {(r.x, r.y): r.sim for r in N.name_likeness(names, "x", "y").collect()}
    assert got == {("é", "e"): 1.0, ("zoé", "zoe b"): N.alike("zoe", "zoe b"), ("a", "b"): 0.0, ("ab", "ab"): 1.0}


def test_sides_are_led_by_names_between_them(spark):
    rows = [(1, "kq(kayku)"), (1, "kq"), (1, "kayku"), (2, "sandpiper"), (2, "zenith"), (3, "one"), (3, None), (4, "acme"), (4, "acmes"), (4, "zenith")]
    got = {(r.root, r.publisher): r.side for r in N.sides(spark.createDataFrame(rows, "root long, publisher string"), "root", "publisher").collect()}
    assert len({got[1, n] for n in ("kq(kayku)", "kq", "kayku")}) == 1
    assert got[2, "sandpiper"] != got[2, "zenith"] and got[3, "one"] == "one" and got[4, "acme"] == got[4, "acmes"] != got[4, "zenith"]


def test_canonical_names(spark):
    rows = [("willow(weide)", "Willow(Weide)"), ("willow", "Willow"), ("willow", "WILLOW"), ("willow", "WILLOW"), ("a(reprint)", "A(reprint)"), ("b(reprint)", "B"), ("heron", "Heron"), ("reiher", "Reiher"), (None, "x"), ("y", "  ")]
    rows += [(f"h{k}(shared)", f"H{k}") for k in range(9)] + [("shared", "Shared")]
    names = spark.createDataFrame(rows, "k string, r string")
    kinds = ("reprint",)
    got = {r.k: r.display for r in N.canonical_names(names, "k", "r", aliases(spark, ("heron", "Heron & Co"), ("reiher", "Heron & Co")), categories=kinds).collect()}
    assert got["willow"] == got["willow(weide)"] == "WILLOW" and (got["a(reprint)"], got["b(reprint)"]) == ("A(reprint)", "B")
    assert got["heron"] == got["reiher"] == "Heron & Co" and got["h1(shared)"] == "H1" and None not in got and "y" not in got
    few = {r.k: r.display for r in N.canonical_names(names, "k", "r", shared_most=99, categories=kinds).collect()}
    assert few["h1(shared)"] == few["shared"] == few["h8(shared)"]
    authors = {r.k: r.display for r in N.canonical_names(names, "k", "r", by_spelling=False, categories=kinds).collect()}
    assert authors["willow(weide)"] == "Willow(Weide)"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_master_keys_in_order(spark, seed):
    rng = random.Random(seed)
    members = [(k, rng.choice([j for j in range(1, 41) if j <= k] or [k])) for k in range(1, 121)]
    known = [(k, rng.choice([None, *range(1, 30)])) for k, _ in members]
    taken, want, of = set(), {}, dict(known)
    for root in sorted({r for _, r in members}):
        free = sorted({of[k] for k, r in members if r == root and of[k] is not None} - taken)
        want[root] = free[0] if free else None
        taken |= set(free[:1])
    got = C.master_keys(spark.createDataFrame(members, "id long, root long"), spark.createDataFrame(known, "id long, book_id long")).collect()
    assert {r.root: r.book_id for r in got} == want


def test_guards(spark):
    frame = spark.createDataFrame([(1, 2)], "a int, b int")
    U.guard_columns({"t": frame}, {"t": ["a", "b"]})
    with pytest.raises(ValueError, match="t.c, u.a"):
        U.guard_columns({"t": frame}, {"t": ["a", "c"], "u": ["a"]})
    decisions = spark.createDataFrame([("manual_merge",), ("auto_low",)], "decision string")
    U.same_decisions(decisions, decisions.where("decision <> 'auto_low'"))
    with pytest.raises(ValueError, match="changed"):
        U.same_decisions(decisions, decisions.limit(0))
    lists = spark.createDataFrame([("2024-01-01", 1, "all", "online")], "snapshot_date string, store_book_id long, unified string, kind string").withColumn("snapshot_date", F.to_date("snapshot_date"))
    with pytest.raises(ValueError, match="2024-02-01"):
        U.reset_to(lists, lists, lists, lists, "2024-02-01")


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(U.shortened(F.lit("abc def"), 4)) == "abc\n(cut here)" and one(U.shortened(F.lit("abc"), 4)) == "abc"
    tokens = {one(U.share_token()) for _ in range(2)}
    assert len(tokens) == 2 and all(len(t) == 64 and set(t) <= set("0123456789abcdef") for t in tokens)
    price = lambda t: tuple(one(T.parse_prices(F.lit(t))))
    assert price("was 30,000 won, now 27,000 won") == (30000, 27000)
    assert price("coupon 5,000 won, book 12,000 won") == (12000, None)
    assert price("50,000 won or more; 999 won; 2,000,001 won") == (None, None)
    assert price("29 18,000 won") == (18000, None)
    assert price("points are not near enough here: 18,000 won") == (18000, None)


def test_a_changed_file_breaks_the_seal(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{1 + k % 3}", k) for k in range(60)], "day string, k int")
    paths = [str(tmp_path / p) for p in "ab"]
    for p in paths:
        S.write_archive(rows, "day", p)
    sealed, again = (S.file_digests(spark, p) for p in paths)
    assert {r.day: r.intact for r in S.unbroken(sealed, again).collect()} == {f"2024-01-0{k}": True for k in (1, 2, 3)}
    file = next(Path(paths[1]).glob("day=2024-01-02/*.gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes())[:-10]))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    next(Path(paths[1]).glob("day=2024-01-03/*.gz")).unlink()
    broken = S.unbroken(S.file_digests(spark, paths[0]), S.file_digests(spark, paths[1]))
    assert {r.day: r.intact for r in broken.collect()} == {"2024-01-01": True, "2024-01-02": False, "2024-01-03": False}


def test_robots_rules_of_hosts(spark):
    pages = spark.createDataFrame([(1, "https://A.com/x/1"), (2, "https://a.com/y"), (3, "https://b.com/x/1"), (4, "https://c.com/x/1"), (5, "https://b.com/x/2?q#f")], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/x/", False), ("a.com", "/", True), ("b.com", "/x/*2", False), ("b.com", "/x/*2", True)], "host string, pattern string, allow boolean")
    assert {r.page_id: r.allowed for r in robots(pages, rules).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
    assert {r.page_id: r.allowed for r in robots(pages, rules.drop("host").limit(1)).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


ROBOTS = "Disallow: /early\nUser-agent: *\nDisallow: /\n\nUSER-AGENT: shelf # x\nUser-agent: other\nnoise\nAllow: /ok$\nDisallow: /ok\nDisallow:\nCrawl-delay: 3\nDisallow: /a%20b/*c\nDisallow: /q?x=[1]\r\nDisallow: /tie\nAllow: /tie\nUser-agent: shelfmark\r\nDisallow: /100%\n"


def test_robots_texts(spark):
    texts = spark.createDataFrame([("a.com", ROBOTS), ("d.com", None), ("e.com", "User-agent: other\nDisallow: /")], "host string, text string")
    rules = lambda agent: {(r.host, r.pattern, r.allow) for r in rules_for(texts, agent).collect()}
    assert rules("Shelfbot/1") == {("a.com", p, a) for p, a in (("/ok$", True), ("/ok", False), ("", False), ("/a%20b/*c", False), ("/q?x=[1]", False), ("/tie", False), ("/tie", True))}
    assert rules("SHELFMARK/2") == {("a.com", "/100%", False)} and rules("zzz") == {("a.com", "/", False)}
    urls = ["http://A.com", "http://a.com/ok", "http://a.com/ok/1#f", "http://a.com/a b/xc?q", "http://a.com/a%20b/c", None, "http://b.com/ok", "http://a.com?q=1", "http://a.com/q?x=[1]&y", "http://a.com/q?x=1", "http://a.com/tie/", "/ok"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule if not r.allowed else None for r in verdicts(pages, rules_for(texts, "Shelfbot/1")).collect()}
    assert got == {k: {2: "/ok", 3: "/a%20b/*c", 4: "/a%20b/*c", 8: "/q?x=[1]"}.get(k) for k in range(len(urls))}
    whole = spark.createDataFrame([(1, "http://a.com/100%25/x"), (2, "http://a.com/1000")], "page_id long, url string")
    assert {r.page_id: r.allowed for r in verdicts(whole, rules_for(texts, "shelfmark")).collect()} == {1: False, 2: True}
    bare = spark.createDataFrame([(1, "http://a.com"), (2, "http://b.com?x")], "page_id long, url string")
    assert [r.allowed for r in verdicts(bare, rules_for(texts, "zzz")).orderBy("page_id").collect()] == [False, True]


def test_nested_and_unclosed_boxes(spark):
    page = (
        '<ul><li data-key=7 class="x product"><a class=title href="/i">A &amp; B</a><ul><li>one<li>two</ul><span class="price"><i>29</i><i>18,000</i> won</span><br/><img src="/c.jpg">'
        '<script>var x="</li>"</script></li><LI CLASS="product" data-key="8"><a class="title">C</a><p>9780306406157<li class="product" data-key="9"><b class="title other">D</b></ul><p class="title">after')
    rows = boxes(spark.createDataFrame([(1, page), (2, None), (3, "")], "page int, html string")).collect()
    assert [(r.page, r.place, r.key, r.fields, r.links, r.cover, r.text) for r in rows] == [
        (1, 0, "7", {"title": "A & B", "price": "29 18,000 won"}, ["/i", "/c.jpg"], "/c.jpg", "A & B one two 29 18,000 won"),
        (1, 1, "8", {"title": "C"}, [], None, "C 9780306406157"), (1, 2, "9", {"title": "D", "other": "D"}, [], None, "D")]
    got = products(spark.createDataFrame([(1, page)], "page int, html string")).collect()
    assert [(r.key, r.rank, r.title, r.list_price, r.isbn13, r.cover) for r in got] == [("7", 1, "A & B", 18000, None, "/c.jpg"), ("8", 2, "C", None, "9780306406157", None), ("9", 3, "D", None, None, None)]


def test_normalised_titles_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    title = lambda t: tuple(one(T.normalize_title(F.lit(t))))
    assert title("NEW! Ｕnlimited Ｂook: fully revised (Deluxe Box) all 12 vols") == ("unlimitedbook", "fullyrevisedall12vols", ["all volumes", "boxed", "revised"], 12)
    assert title("Limited ｌimited set") == (None, None, ["limited", "set"], None)
    assert one(T.editions(F.lit("a deluxe box, deluxe and unlimited"))) == ["boxed", "deluxe"]
    assert one(T.normalize_publisher(F.lit("Kq(Kayku) Press Inc."))) == "kq(kayku)" and one(T.normalize_publisher(F.lit("Ｂlue [Books]"))) == "blue[]"
    assert one(T.normalize_author(F.lit("Ａnn (editor)"))) == "ann"


def test_isbn_hits(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    hits = lambda t: [(h.isbn13, h.context) for h in one(T.isbn_hits(F.lit(t), 4, 3))]
    assert hits("ab  9780306406157 cd 0306406152.") == [("9780306406157", "ab 9780306406157 cd"), ("9780306406157", "cd 0306406152.")]
    assert hits("9780306406157") == [("9780306406157", "9780306406157")] and hits("x") == hits("") == []
    assert hits("-9780306406157 9780306406157- 97803064061571 9780306406158 080442957X") == [("9780804429573", "158 080442957X")]
    assert hits("12 9780306406157 12 9780306406157 ") == [("9780306406157", "12 9780306406157 12")]
    assert one(T.isbn_hits(F.lit(None).cast("string"))) is None
    assert tuple(one(T.isbn_in_address(F.lit("/9780306406157.jpg")))) == ("9780306406157", "thirteen")
    assert tuple(one(T.isbn_in_address(F.lit("/0306406152_1")))) == ("9780306406157", "ten") and tuple(one(T.isbn_in_address(F.lit("/1")))) == (None, None)


def test_products_of_broken_boxes(spark):
    box = '<li class="product" data-key="7"><a class="title">A &amp; B</a><span class="price">10,000 won or more</span></li>'
    pages = spark.createDataFrame([(1, box.replace("7", "")), (2, box + '<li class="product" data-key="8"></li>' + box), (3, ""), (4, None)], "page int, html string")
    got = products(pages).collect()
    assert [(r.key, r.page, r.rank, r.title, r.author, r.list_price, r.isbn13) for r in got] == [("7", 2, 21, "A & B", None, None, None), ("7", 2, 23, "A & B", None, None, None)]


def test_isbn_and_times(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.isbn_in(F.lit("no 9780306406158, 19780306406157, but 978-0-306-40615-7."))) == "9780306406157"
    assert one(T.isbn_in(F.lit("none"))) is None and one(T.isbn_in(F.lit(None).cast("string"))) is None
    assert [one(T.duration(F.lit(s))) for s in (0, 59, 61, 3600, 90_061, -1)] == ["0 s", "59 s", "1 min 1 s", "1 h 0 min", "1 d 1 h", None]


def test_a_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


class Parts:
    """Union by the least member."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        a, b = sorted((self.find(i), self.find(j)))
        self.up[b] = a

    def groups(self):
        out = {}
        for i in self.up:
            out.setdefault(self.find(i), []).append(i)
        return list(out.values())


def split(cluster, side, score):
    """A cluster by its members' sides; who has none goes with the best link, the lower id if two are as good."""
    known = [i for i in cluster if side(i) is not None]
    if len({side(i) for i in known}) < 2:
        return [cluster]
    parts = {}
    for i in known:
        parts.setdefault(side(i), []).append(i)
    for i in [i for i in cluster if side(i) is None]:
        best = max(((score[min(i, j), max(i, j)], -j) for j in known if (min(i, j), max(i, j)) in score), default=None)
        parts.setdefault(("alone", i) if best is None else side(-best[1]), []).append(i)
    return list(parts.values())


def repaired(clusters, publisher, volume, score, merges, splits):
    out = []
    for cluster in clusters:
        names = sorted({publisher[i] for i in cluster if publisher[i]})
        sides = Parts(names)
        for x in names:
            for y in names:
                if x < y and N.alike(x, y) >= 0.8:
                    sides.join(x, y)
        pieces = [q for p in split(cluster, lambda i: publisher[i] and sides.find(publisher[i]), score) for q in split(p, lambda i: volume[i], score)]
        again = Parts(range(len(pieces)))
        where = {i: k for k, p in enumerate(pieces) for i in p}
        for a, b in merges:
            if a in where and b in where:
                again.join(where[a], where[b])
        for group in again.groups():
            part = sorted(i for k in group for i in pieces[k])
            mine = {(a, b) for a, b in splits if a in part and b in part}
            if mine:
                own = Parts(part)
                edges = [(1_000_000, a, b) for a, b in merges] + [(s, a, b) for (a, b), s in score.items() if (a, b) not in merges]
                for _, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
                    if a in part and b in part and not any((min(x, y), max(x, y)) in mine for x in part for y in part if own.find(x) == own.find(a) and own.find(y) == own.find(b)):
                        own.join(a, b)
                out += own.groups()
            else:
                out.append(part)
    return {i: min(p) for p in out for i in p}


def test_repair_equals_brute_force(spark):
    rng, rows, links, merges, splits = random.Random(4), [], {}, set(), set()
    for c in range(40):
        ids = [10 * c + k for k in range(rng.randint(2, 8))]
        for i in ids:
            rows.append((i, rng.choice(["acme", "acmes", "zenith", "willow", None]), rng.choice([None, None, 1, 2])))
        for a, b in zip(ids, ids[1:], strict=False):
            links[a, b] = rng.randint(65, 100)
        for a in ids:
            for b in ids:
                if a < b and rng.random() < 0.3:
                    links.setdefault((a, b), rng.randint(65, 100))
        pairs = [(a, b) for a in ids for b in ids if a < b]
        merges |= {p for p in rng.sample(pairs, 1) if rng.random() < 0.4}
        splits |= {p for p in rng.sample(pairs, min(2, len(pairs))) if rng.random() < 0.5} - merges
    publisher, volume = {i: p for i, p, _ in rows}, {i: v for i, _, v in rows}
    joined = Parts(publisher)
    for a, b in [*links, *merges]:
        joined.join(a, b)
    want = repaired(joined.groups(), publisher, volume, links, merges, splits)
    items = spark.createDataFrame(rows, "id long, publisher string, volume int")
    manual = spark.createDataFrame([(b, a, "manual_merge") for a, b in merges] + [(a, b, "manual_split") for a, b in splits], "a long, b long, decision string")
    scored = spark.createDataFrame([(a, b, links.get((a, b), 0), "manual_merge" if (a, b) in merges else "auto_low") for a, b in {*links, *merges}], "a long, b long, score int, decision string")
    got = C.repair(C.components(scored, items), scored, manual, items)
    assert {r.id: r.root for r in got.collect()} == want

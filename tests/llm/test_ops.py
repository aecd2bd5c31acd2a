"""The corpus operators against brute force on small awkward corpora."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cytospark.llm import chat, katz, mixing, neardup, packing, quality, repeats, sharding, urls, vectors
from cytospark.llm.common import Stash
from cytospark.llm.components import components, merged

from . import data

ROWS = data.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return data.frame(spark, ROWS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return data.frame(spark, ROWS[:1]).where("false")


@pytest.mark.parametrize("most", [100_000, 60, 1])
def test_components(spark, monkeypatch, most):
    """All edges in one task, the last ones, and none (as far as more than one is left)."""
    from cytospark.llm import components as module

    monkeypatch.setattr(module, "EDGES_A_TASK", most)
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, x) for x in range(501, 560)] + [tuple(map(int, e)) for e in rng.integers(1000, 1200, (120, 2))] + [(7, 7), (None, 3), (5, 4), (5, 4)]
    g = data.Groups()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            g.join(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Stash(spark)).collect()))
    assert got == {x: g.find(x) for x in list(g.up)}


def test_near_duplicates(spark, docs, none):
    got = neardup.near_duplicates(docs, Stash(spark)).collect()
    want = data.near_groups(ROWS)
    assert len(got) == len(ROWS)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(none, Stash(spark)).count() == 0


def test_registers_estimate():
    rng = np.random.default_rng(3)
    for similarity, want in ((0.4, False), (0.85, True)):
        k = int(800 * similarity / (1 + similarity))
        x = rng.integers(0, 2**63, 800 - k, dtype=np.uint64)
        a, b = neardup.registers(x[:400]), neardup.registers(x[-400:])
        assert neardup.likely(a[None], b[None], np.array([400.0]), np.array([400.0]))[0] == want
        merged = np.maximum(a, b)
        assert (merged == neardup.registers(x)).all()


def test_large_group_of_near_copies(spark):
    """A group whose members are linked through others only, larger than a block."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(3000):
        w = list(base)
        for j in rng.choice(60, 1 + i % 3, replace=False):
            w[j] = f"e{i}x{j}"
        rows.append((i, " ".join(w), "s"))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(data.frame(spark, rows, False), Stash(spark)).collect()}
    sets = [data.shingles(t) for _, t, _ in rows]
    at = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((len(rows), len(at)), np.float32)
    for k, s in enumerate(sets):
        x[k, [at[g] for g in s]] = 1
    both, n = x @ x.T, x.sum(1)
    near = 100 * both >= 75 * (n[:, None] + n[None] - both)
    want = data.Groups()
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        want.join(int(i), int(j))
    assert got == {i: want.find(i) for i in range(len(rows))}


def test_near_duplicates_of_awkward_rows(spark):
    """Null ids, one id with several texts, repeated rows, no words, ties, texts of 20,000 words, in any order."""
    rng = np.random.default_rng(6)
    a, b, long = ([f"{k}{x}" for x in rng.integers(0, 10**6, n)] for k, n in (("a", 80), ("b", 80), ("c", 20_000)))
    rows = [(1, a), (1, b), (5, [*b, "more"]), (5, [*b, "more"]), (None, a), (None, None), (7, []), (7, []), (8, long), (9, ["new", *long[1:]]), (3, a), (3, long[:300]), (2, long[:299])]
    rows = [(d, None if w is None else " ".join(w), "s") for d, w in rows]
    df = data.frame(spark, rows).selectExpr("*", "1 as t", "3 as alone")
    got = collections.Counter(tuple(r) for r in neardup.near_duplicates(df, Stash(spark)).collect())
    want = [(1, 76, 1, True), (1, 76, 1, True), *[(5, 77, 1, False)] * 2, (None, 76, None, True), (None, 0, None, True), *[(7, 0, 7, True)] * 2, (8, 19996, 8, True), (9, 19996, 8, False), (3, 76, 1, False), (3, 296, 2, False), (2, 295, 2, True)]
    assert got == collections.Counter(want)
    kept = neardup.keep(spark, df, "")
    assert kept.columns == df.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(rows[k][0], rows[k][1]) for k in (0, 1, 4, 5, 6, 7, 8, 12)])


def test_urls(spark):
    link = '<LINK href="https://b.example.org/p" rel="canonical">'
    rows = [
        (1, "https://A.Example.com/en/1?x=1", ""), (2, "http://example.com/en/77", ""), (3, "https://b.example.org/p", ""), (4, "http://c.example.org/q", link),
        (5, "http://c.example.org/q/#top", None), (6, "https://b.example.org/es/1", '<meta http-equiv="refresh" content="0; url=/p">'), (7, None, ""), (8, "no scheme", link), (9, "https://notcom/en/1", ""),
        (10, "https://x.net/de/5", '<link rel=canonical href="//z.example.net/k">'), (11, "https://z.example.net/k", ""), (12, "https://w.example.net/de/8", '<link rel=canonical href=https://z.example.net/k>'), (12, "https://w.example.net/de/8", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as node", "2 as host", "3 as group")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, Stash(spark)).collect()}
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block") and got[2][2:] == ("example.com/en/7", "allow") and got[9][2:] == (None, "allow")
    assert [got[i][2:] for i in (3, 4, 5)] == [(None, "block")] * 3, "aliases of a blocked page that redirects to them"
    assert got[6][2:] == ("org/es/", "block") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[12][2:] == ("example.net/de/8", "block") and got[11][2:] == (None, "allow"), "an allowed alias goes before a blocked one"
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(map(str, con.execute(urls.ORACLE_SQL).fetchall())) == sorted(str(tuple(r)) for r in urls.judge(df, Stash(spark)).collect())
    assert urls.judge(df.where("false"), Stash(spark)).count() == 0


def test_urls_that_are_no_rows(spark):
    """Rules that fit a target, or an end of a link, reach the pages of its component."""
    to = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://one.test/a", to("http://example.net/de/8")), (2, "http://two.test/a", to("http://q.com/en/3")), (3, "http://q.org/es/1", to("http://hub.test/")), (4, "http://hub.test", to("http://z.net/de/1")),
        (5, "http://q.com/en", '<meta http-equiv="refresh" content="0; url=http://q.com/en/">'), (6, "http://six.test/a", ""), (7, "http://seven.test/a", ""), (8, "http://eight.test/a", to("http://six.test/b")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    links = spark.createDataFrame([("http://six.test/a", "http://x.org/es/9"), ("http://y.org/es/2", "http://seven.test/a"), (None, "http://x.com/en/1")], "src string, dst string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, Stash(spark), links=links).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: ("org/es/", "block"), 4: (None, "allow"), 5: (None, "block"), 6: (None, "block"), 7: (None, "block"), 8: (None, "allow")}


def test_long_lists_of_rules(spark, monkeypatch):
    """Joined on host suffixes, rules give what the conditional expression gives."""
    rng = np.random.default_rng(3)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "com.net", "b"]
    rules = [(("block", "allow")[int(rng.integers(2))], f"{h}/{p}") for h in hosts for p in ("", "q", "qq/", "r/s")]
    rows = [(i, f"http://{h}/{p}", link) for i, (h, p, link) in enumerate((h, p, k) for h in [*hosts, "z.b.a.com", "acom", "nothing.org"] for p in ("", "q", "qq/1", "r/s/t", "u") for k in (None, '<link rel=canonical href="http://a.com/qq/7">'))]
    df = spark.createDataFrame([*rows, (None, None, None), (3, "http://a.com/q", "")], "page_id long, url string, html string").selectExpr("*", "1 as number", "2 as best")
    run = lambda: collections.Counter(map(tuple, urls.judge(df, Stash(spark), rules).collect()))
    want = run()
    monkeypatch.setattr(urls, "MOST_RULES", 3)
    assert run() == want and len({r[3] for r in want}) > 10


def test_url_targets(spark):
    """Relative, escaped and later targets; what only looks like a url or names no other page."""
    link, meta = (lambda u: f'<link rel="canonical" href="{u}">'), (lambda c: f'<meta http-equiv="refresh" content="{c}">')
    rows = [
        ("http://h.test/a/b?q=1", link("page.html"), ["http://h.test/a/page.html"]), ("http://h.test/a/b/c", link("../x?u=../y"), ["http://h.test/a/x?u=../y"]), ("http://h.test/a/b?q=1", link("?id=3"), ["http://h.test/a/b?id=3"]),
        ("http://h.test", link("p"), ["http://h.test/p"]), ("http://h.test/a/", link("/x/./y/../../../z/.."), ["http://h.test/"]), ("http://h.test/a/b", link("c/."), ["http://h.test/a/c/"]),
        ("http://h.test/a", meta("30") + meta("0; url=/b"), ["http://h.test/b"]), ("http://h.test/a", link("") + link("/c") + link("//g.test/d"), ["http://h.test/c", "http://g.test/d"]),
        ("http://h.test/a", link("/p?a=1&amp;b=2") + meta("0;URL='http://h.test/p?a=1&#38;b=2'"), ["http://h.test/p?a=1&b=2"] * 2), ("http://h.test/a", link("/go?to=http://example.net/x"), ["http://h.test/go?to=http://example.net/x"]),
        ("http://h.test/a", link("#top") + link("mailto:a@b.test"), []), ("http://h.test/a/b", '<base href="/z/">' + link("k"), ["http://h.test/z/k"]), ("no scheme", link("k"), []), (None, link("k"), []), ("http://h.test/a", None, []),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = dict(map(tuple, df.select("page_id", urls.targets(F.col("html"), F.col("url"))).collect()))
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}
    pages = [(1, "http://www.q.com/en/x/", meta("9") + meta("0; url=../../new?a=1&amp;b=2")), (2, "http://www.q.com/new?a=1&b=2", "")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), Stash(spark)).where("page_id = 2").first()
    assert got["rule"] is None and got["verdict"] == "block"


def test_sharding(spark, docs, none):
    got = sharding.shard(docs, shards=5, vnodes=8, cells=64).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert sum(sizes.values()) == len(ROWS) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    text = {r[0]: r[1] or "" for r in ROWS}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    assert sharding.shard(none).count() == 0


def walked(rows, shards, vnodes, cells, cell_of):
    """shard of each row by walking the ring row by row: own shard first, then what overflows goes clockwise."""
    nodes = sharding.ring(shards, vnodes, cells)
    whole, extra = divmod(len(rows), shards)
    room = [whole + (s < extra) for s in range(shards)]
    out, left = {}, []
    for r in sorted(rows, key=lambda r: (cell_of[r[0]], *r[1:])):
        own = next((i for i, (c, _) in enumerate(nodes) if c >= cell_of[r[0]]), 0)
        if room[nodes[own][1]]:
            room[nodes[own][1]] -= 1
            out[r[0]] = nodes[own][1]
        else:
            left.append((own, r[0]))
    for own, k in left:
        i = (own + 1) % len(nodes)
        while not room[nodes[i][1]]:
            i = (i + 1) % len(nodes)
        room[nodes[i][1]] -= 1
        out[k] = nodes[i][1]
    return out


def test_shards_are_those_of_a_walk(spark):
    """Against a plain ring, with ids that are unique."""
    df = data.frame(spark, [(i, f"text {i}", "s") for i in range(300)], False)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - sharding.BITS)
    at = {r[0]: r[1] for r in df.select("doc_id", place).collect()}
    want = walked([(d, p) for d, p in at.items()], 7, 8, 64, {d: p // ((1 << sharding.BITS) // 64) for d, p in at.items()})
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(df, shards=7, vnodes=8, cells=64).collect()} == want


def test_shards_of_hot_ids(spark):
    """Cells beyond part_rows rows (null, repeated ids; equal rows) are ranked in parts: still gapless and balanced."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, None if i % 2 else "t" * (i % 5), "s") for i in range(400)]
    got = sharding.shard(data.frame(spark, rows), shards=5, vnodes=8, cells=64, part_rows=16).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sorted(map(len, slots.values())) == [80] * 5
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((d, len(t or "") + 8) for d, t, _ in rows)


def moved(a: int, b: int, rows: int = 3) -> float:
    """Share of keys in other shards after b shards instead of a."""
    where = lambda n: {(c, k): s for c, lo, hi, s, _ in sharding.layout(dict.fromkeys(range(1 << 14), rows), n, sharding.ring(n, 64, 1 << 14)) for k in range(lo, hi)}
    x, y = where(a), where(b)
    return sum(x[k] != y[k] for k in x) / len(x)


def test_ring_moves_little():
    """Dealing anew by remainder would move 0.9 and 0.96 of the keys."""
    assert moved(10, 11) < 0.13 and moved(24, 25) < 0.08


def test_repeats(spark, docs, none):
    got = collections.Counter(tuple(r) for r in repeats.digest(docs, Stash(spark)).collect())
    want = collections.Counter((r[0], len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, (k, w) in zip(ROWS, data.removed(ROWS), strict=True))
    assert got == want and sum(n for _, _, n, _ in got) > 0
    assert repeats.digest(none, Stash(spark)).count() == 0


def test_cleaned_keeps_columns(spark, docs):
    out = repeats.cleaned(docs, Stash(spark))
    assert out.columns == docs.columns and out.count() == len(ROWS) and {r["row"] for r in out.collect()} == {"row"}
    kept = {(r[0], None if r[1] is None else " ".join(k) if len(k) < len(w) else r[1]) for r, (k, w) in zip(ROWS, data.removed(ROWS), strict=True)}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == kept


def test_repeats_random(spark):
    """Short alphabets: runs, periods and self-overlaps everywhere."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join("ab"[x] for x in rng.integers(0, 2, rng.integers(20, 300))) if i % 2 else " ".join(["a", "b", "c"][: 1 + i % 3] * int(rng.integers(5, 60))), "s") for i in range(60)]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.digest(data.frame(spark, rows, False), Stash(spark)).collect()}
    assert got == {r[0]: len(w) - len(k) for r, (k, w) in zip(rows, data.removed(rows), strict=True)}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(400):
        v = base[i % 30] + rng.normal(size=16) * 0.12
        rows.append([i, [float(np.float32(x)) for x in v], i % 30 % 3])
    rows += [[400 + k, rows[0][1], 0] for k in range(5)] + [[410, None, 0], [411, [0.0] * 16, 0], [412, rows[0][1], None], [413, [math.nan] * 16, 0], [414, [1.0, 2.0], 0], [415, [None] * 16, 0], [416, [math.inf] + [0.0] * 15, 1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as m", "3 as list")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, Stash(spark), block=64).collect()}
    good = [r for r in rows if r[2] is not None and r[1] is not None and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    x = np.array([r[1] for r in good], np.float32).astype(float)
    cos = (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
    links, g = collections.Counter(), data.Groups()
    for i, j in zip(*np.nonzero(cos >= vectors.COSINE), strict=True):
        if i != j and good[i][2] == good[j][2]:
            links[good[i][0]] += 1
            g.join(good[i][0], good[j][0])
    found = sum(got[r[0]][0] for r in rows)
    assert sum(links.values()) > 1000 and found >= 0.99 * sum(links.values()) and all(got[v][0] <= links[v] for v in got)
    assert sum(got[v][1] == g.find(v) for v in got) >= 0.99 * len(got) and all(got[v][0] == 0 and got[v][2] for v in range(410, 417))
    assert vectors.near_duplicates(df.where("false"), Stash(spark)).count() == 0
    assert vectors.near_duplicates(df.where("vec_id >= 410"), Stash(spark)).count() == 7


def test_merged():
    rng = np.random.default_rng(7)
    least, g = np.arange(300), data.Groups()
    for _ in range(6):
        x, y = rng.integers(0, 300, 40), rng.integers(0, 300, 40)
        least = merged(least, x, y)
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            g.join(a, b)
    assert least.tolist() == [g.find(i) for i in range(300)]


def test_vectors_of_low_rank(spark):
    """Many vectors close to borders of lists: all links are found, and count for both ends."""
    rng = np.random.default_rng(4)
    base = np.repeat(rng.normal(size=(500, 6)), 4, 0)
    x = ((base + rng.normal(size=base.shape) * 0.12) @ rng.normal(size=(6, 64))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 8 // 4) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    label = np.arange(len(x)) % 8 // 4
    near = (x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) >= vectors.COSINE) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    g = data.Groups()
    for i, j in zip(*np.nonzero(near), strict=True):
        g.join(int(i), int(j))
    for block in (1024, 64):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, Stash(spark), block=block).collect()}
        assert got == {i: (n, g.find(i)) for i, n in enumerate(near.sum(1).tolist())}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(0, 60, 2)] + [(None, 1, 0), (3, None, 0), (4, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels, Stash(spark)).collect()
    text = {r[0]: r[1] or "" for r in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        t = text[r["doc_id"]]
        w = data.split(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if data.split(x)]
        want = (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(none, labels, Stash(spark)).count() == 0


def test_learned_rules(spark):
    rng = np.random.default_rng(9)
    rows = [{"n_words": 100 + i % 7, "mean_chars": 5.0, "symbol_share": float(s), "dup_line_share": float(d), "repeat_share": 0.0, "bad": bool(s > 0.3 or d > 0.5)} for i, (s, d) in enumerate(rng.random((600, 2)))]
    rules = quality.learn(rows)
    wrong = sum(any(quality._covers(r, x) for r, _ in rules) != x["bad"] for x in rows)
    assert len(rules) >= 2 and wrong < 12
    df = spark.createDataFrame([{k: v for k, v in x.items() if k != "bad"} | {"bad": x["bad"]} for x in rows])
    assert df.where((quality.as_column(rules) == "reject") != F.col("bad")).count() == wrong
    assert quality.learn([x | {"bad": False} for x in rows]) == [] and quality.learn([]) == []


@pytest.mark.parametrize("order", [2, 3])
def test_katz(spark, docs, none, order):
    rows = [*ROWS, (None, "one two three", "s"), (None, None, "s"), (3, "another text of the same id", "s")]
    df = data.frame(spark, rows).repartition(5)
    got = katz.Katz(df, Stash(spark), batch_bytes=3000, order=order).scores().collect()
    seqs = [(r[0], [data.lower(x) for x in data.split(r[1])] + [None]) for r in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    # contexts of each level: the words before, begin marks before those
    contexts = lambda w, k: [tuple((["<s>"] * (k - 1) + w)[i : i + k - 1]) for i in range(len(w))]
    c, grams = collections.Counter(), {k: collections.Counter() for k in range(2, order + 1)}
    for d, w in seqs:
        if not held(d):
            c.update(w)
            for k in grams:
                grams[k].update(zip(contexts(w, k), w, strict=True))
    n, v = sum(c.values()), len(c)
    mass = n + 0.5 * (v + 1)
    alpha, whole = {}, {}

    def p(h, w):
        """P of w after the words h."""
        if not h:
            return (c[w] + 0.5) / mass
        k = len(h) + 1
        if h not in whole:
            return p(h[1:], w)
        return less[k](grams[k][h, w]) / whole[h] if grams[k][h, w] else alpha[h] * p(h[1:], w)

    less = {}
    for k in grams:
        cc = collections.Counter(grams[k].values())
        d = katz.discounts([cc[i] for i in range(katz.MOST + 3)])
        less[k] = lambda x, d=d: x * (d[x] if x <= katz.MOST else 1)
        seen, lower, total = collections.Counter(), collections.Counter(), collections.Counter()
        for (h, w), x in grams[k].items():
            seen[h] += less[k](x)
            lower[h] += p(h[1:], w)
            total[h] += x
        for h in total:
            whole[h] = total[h] + (seen[h] >= total[h] * (1 - 1e-12))
            alpha[h] = (1 - seen[h] / whole[h]) / (1 - lower[h])
    some = [("<s>",), ("same",), ("w1",), ("w2",)] + [("<s>", "<s>"), ("same", "same"), ("w1", "unknown")] * (order > 2)
    for h in some:
        assert math.isclose(sum(p(h, w) for w in c) + p(h, "unknown"), 1, rel_tol=1e-9)
    want = collections.Counter()
    for doc, w in seqs:
        base, score = sum(math.log10((c[x] + 0.5) / mass) for x in w), sum(math.log10(p(*x)) for x in zip(contexts(w, order), w, strict=True))
        want[doc, held(doc), len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(score, 6)] += 1
    assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert katz.Katz(none, Stash(spark), order=order).scores().count() == 0


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(docs, Stash(spark), packing.vocabulary(), room=256, cell_rows=8).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    total, times = 0, collections.Counter(r[0] for r in ROWS)
    for doc, text, _ in set(ROWS):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids) * times[doc]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[doc]) == sorted(want * times[doc])
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.03 * -(-total // 256) + 1
    assert packing.pack(none, Stash(spark), packing.vocabulary()).count() == 0


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    texts = [t for _, t, _ in ROWS if t] + ["  lead", "trail  ", " one", "a  b", "a \n b", "tab\t x", "nb\u00a0sp x", "it's we'll  'S", "x\x1cy z\x85 w", "<|endoftext|> a<|endoftext|>", "\u3000 é 漢字 12ab34 ...", " ", "\n", "a\n", "a ", " a "]
    for t in texts:
        assert list(packing.encoded([t], packing.vocabulary()))[0] == np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes(), repr(t)


def test_swaps_empty_bins():
    kinds = packing.best_fit({6: 4, 5: 2, 4: 1, 3: 4, 2: 2}, room=10)
    better = packing.improve(kinds, room=10)
    items = lambda ks: collections.Counter(x for k, n in ks.items() for _ in range(n) for x in k)
    assert items(kinds) == items(better) and sum(better.values()) <= sum(kinds.values()) and all(sum(k) <= 10 for k in better)
    start = {(6, 2): 1, (7, 1): 1, (4,): 1}
    assert sum(packing.improve(start, room=10).values()) == 2
    assert packing.improve({}, room=10) == {} and packing.best_fit({}) == {}


def test_swaps_empty_sequences(spark):
    """Best fit alone takes 16 sequences; swaps empty two of them."""
    lengths = [3] * 16 + [4] * 18 + [8]
    assert sum(packing.best_fit(collections.Counter(lengths), 10).values()) == 16
    df = data.frame(spark, [(i, " ".join(["the"] * (n - 1)), "s") for i, n in enumerate(lengths)])
    got = packing.pack(df, Stash(spark), packing.vocabulary(), room=10, cell_rows=4).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(bins) == 14 and collections.Counter(r["length"] for r in got) == collections.Counter(lengths)
    for b in bins.values():
        at = [o for o, _ in sorted(b)]
        assert at == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 10


def test_stages_take_awkward_rows(spark):
    """Null ids and texts, one id with unlike texts, repeated rows, a text of 20,000 words, clashing column names."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    a, b, long = prose(80), prose(90), prose(20_000)
    rows = [(None, prose(70), "s"), (None, None, None), (1, a, "s"), (1, b, "t"), (1, b, "t"), (2, "", None), (3, long, "s"), (4, "junk " * 100, "s"), (5, f"{prose(40)} {b} {prose(3)}", "t"), (6, "x", "s")]
    df = data.frame(spark, rows).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name: stages[name](spark, df, "/root/testdata/sf0.001")
    for name in list(stages)[:-1]:
        assert run(name).columns == df.columns, name
    count = lambda out: collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    whole = collections.Counter(r[:2] for r in rows)
    kept = count(run("quality_rules"))
    assert not kept - whole and not {t for _, t in kept} & {None, "", "junk " * 100, "x"}
    want = collections.Counter((r[0], None if r[1] is None else r[1] if len(k) == len(w) else " ".join(k)) for r, (k, w) in zip(rows, data.removed(rows), strict=True))
    assert count(run("substring_dedup")) == want
    taken = count(run("source_mixing"))
    assert all(taken[k] <= 2 * n for k, n in whole.items()) and not taken - whole - whole
    again = run("source_mixing").collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in again) == taken and {r["target"] for r in again} == {"target"}
    pieces = run("best_fit_packing").collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(rows) and sum(r["length"] == 1 for r in pieces) == 2


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "hi <|turn|> \\ <\\|x"), (1, 0, "user", "a"), (1, 2, "assistant", "two\n"), (1, 3, "user", None), (2, 0, None, "x"), (2, None, "assistant", ""), (3, 0, "assistant", "[INST] <s> </s> [\\/INST] [\\\\INST]"),
        (3, 0, "assistant", "[INST] <s> </s> [\\/INST] [\\\\INST]"), (None, 5, "user<|text|>", "é<"), (4, 1, "user", "|more|>"), (4, 2, "user", "<|end|>"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as p", "2 as turns")
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert list(got[c]["loss_texts"]) == [t for role, t in turns if role == "assistant"]
    assert got[1]["formatted"].count("<|turn|>") == 3 and got[1]["formatted"].count("<|more|>") == 1
    assert chat.format_chats(df.where("false")).count() == 0


def test_mixing(spark, docs, none):
    docs = docs.selectExpr("*", "'h' as mix_h_", "'copies' as copies")
    out = mixing.mix(docs, Stash(spark))
    got = out.select("row.*", *(F.col(c).alias(f"mix_{c}_") for c in ("size", "copies", "source_size", "target"))).collect()
    assert mixing.take(spark, docs, "").columns == docs.columns == out.select("row.*").columns
    assert len(got) == len(ROWS) and {r["target"] for r in got} == {"target"}
    sizes = collections.Counter()
    for _, t, s in ROWS:
        sizes[s] += len(data.split(t))
    names = sorted(s for s in sizes if s is not None) + [None]
    targets = mixing.water_fill([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2.0)
    assert math.isclose(sum(targets), 1.5 * sum(sizes.values())) and all(t <= 2 * sizes[s] for s, t in zip(names, targets, strict=True))
    largest = max(len(data.split(r[1])) for r in ROWS)
    for s, t in zip(names, targets, strict=True):
        mine = [r for r in got if r["source"] == s]
        assert {r["mix_source_size_"] for r in mine} == {sizes[s]} and all(math.isclose(r["mix_target_"], t) for r in mine)
        assert abs(sum(r["mix_size_"] * r["mix_copies_"] for r in mine) - t) <= largest
    assert max(r["mix_copies_"] for r in got) <= 2
    again = sorted((r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(3), Stash(spark)).select("row.doc_id", "copies").collect())
    assert again == sorted((r["doc_id"], r["mix_copies_"]) for r in got)
    assert mixing.mix(none, Stash(spark)).count() == 0


@pytest.mark.parametrize("name", ["op2_url_filters", "op9_chat_formatting", "op10_source_mixing"])
def test_matches_sql(spark, name):
    from cytospark.llm.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))


def test_pipeline(spark, tmp_path):
    """Each stage on what its predecessor wrote."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        held[name] = docs, (docs := spark.read.parquet(str(tmp_path / name)))
        assert docs.columns == columns or name == "best_fit_packing"
    before, after = (x.collect() for x in held["near_dedup"])
    want = data.near_groups([(r["doc_id"], r["text"], None) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, (_, c) in want.items() if c == d)
    before, after = (x.collect() for x in held["substring_dedup"])
    kept = {r["doc_id"]: k for r, (k, _) in zip(before, data.removed([(r["doc_id"], r["text"], None) for r in before]), strict=True)}
    assert {r["doc_id"]: data.split(r["text"]) for r in after} == kept
    before, after = (x.collect() for x in held["source_mixing"])
    assert max(collections.Counter(r["doc_id"] for r in after).values()) <= 2
    total = sum(len(data.split(r["text"])) for r in before)
    assert abs(sum(len(data.split(r["text"])) for r in after) - 1.5 * total) < 0.1 * total
    packed = held["best_fit_packing"][1]
    assert packed.where("piece = 0").count() == len(after)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_stages_take_empty_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0

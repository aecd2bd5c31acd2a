"""Substring dedup by recompression: words covered by a window whose word sequence also starts elsewhere are removed.

Rounds of recompression name runs of equal words, then pairs of neighbours, by hashes of their parts, so that equal
passages get equal names in every document without a shared table. Which neighbours pair depends only on their names'
coins, and every symbol carries the span of words that decided it; a symbol is consistent in any window that holds that
span. A window's anchor is the consistent symbol of most words (then of greatest hash, then the leftmost): a function of
the window's words alone, so equal windows have equal anchors.

Consecutive windows of one anchor are a unit, known by (anchor's name, hash of all its words). Units whose anchor occurs
once are unique. Where all occurrences of an anchor have one content, all their windows repeat. Otherwise a content found
twice repeats, and one occurrence of each content has its windows compared (anchor and 64-bit hash of the 35 words).
Counts are aggregated before shuffles, and hot anchors meet only in joins that Spark can split.

Null and empty texts have no words. Windows reach neither over documents nor below 35 words. Repeated rows are elsewhere
to one another, also with equal ids; rows of one id with other texts are rows like others. A null doc_id is as any other.
Ties for a window's anchor go to the greater hash, then to the left. Very long texts are handled whole. An empty table
gives an empty result. Extra columns of any names pass through ``cleaned``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Stash, table

WIDTH = 35
ROUNDS = 7
#: Spans of symbols that are tried as anchors together, from the longest: a window takes the best of the first class.
CLASSES = ((6, 1 << 62), (3, 5), (2, 2))
_U = np.uint64
_FAR = 1 << 40


def symbols(h: np.ndarray, doc: np.ndarray):
    """(name, first word, word after the last, first and last+1 word that decided it) of all symbols of more than a word."""
    n = len(h)
    at = np.arange(n)
    same = np.zeros(n + 1, bool)  # same[i]: word i - 1 is in the same document and equal
    near = np.zeros(n + 1, bool)  # near[i]: word i - 1 is in the same document
    near[1:n] = doc[1:] == doc[:-1]
    same[1:n] = near[1:n] & (h[1:] == h[:-1])
    s = at[~same[:-1]]
    e = np.append(s[1:], n)
    count = (e - s).astype(_U)
    name = np.where(count > 1, tokens.mix(h[s] + count * _U(0x9FB21C651E98DF25)), h[s])
    lo = np.where(near[s], s - 1, -_FAR)
    hi = np.where(near[e], e + 1, _FAR)
    run = count > 1
    yield name[run], s[run], e[run], lo[run], hi[run]
    for k in range(ROUNDS):
        joined = np.zeros(len(s) + 1, bool)  # joined[i]: symbol i has its left neighbour in its document
        joined[1:-1] = doc[s[1:]] == doc[s[:-1]]
        coin = (tokens.mix(name + _U(0x632BE59BD9B4E019 * (k + 1) % 2**64)) >> _U(63)).astype(bool)  # right if set
        pair = np.flatnonzero(joined[1:-1] & ~coin[:-1] & coin[1:])
        # an unpaired symbol depends on the neighbour that it might have paired with
        left = np.concatenate([[-_FAR], np.where(joined[1:-1], lo[:-1], -_FAR)])
        right = np.concatenate([np.where(joined[1:-1], hi[1:], _FAR), [_FAR]])
        new_lo = np.where(coin, np.minimum(lo, left), lo)
        new_hi = np.where(coin, hi, np.maximum(hi, right))
        new_lo[pair] = np.minimum(lo[pair], lo[pair + 1])
        new_hi[pair] = np.maximum(hi[pair], hi[pair + 1])
        name = name.copy()
        e = e.copy()
        name[pair] = tokens.mix(name[pair] * _U(0xC2B2AE3D27D4EB4F) + tokens.mix(name[pair + 1] + _U(k)))
        e[pair] = e[pair + 1]
        yield name[pair], s[pair], e[pair], new_lo[pair], new_hi[pair]
        stay = np.ones(len(s), bool)
        stay[pair + 1] = False
        name, s, e, lo, hi = name[stay], s[stay], e[stay], new_lo[stay], new_hi[stay]


def units(h: np.ndarray, first: np.ndarray):
    """(anchor name, content hash, first window, number of windows, row) of all units of consecutive texts."""
    n = len(h)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    windows = np.zeros(n, bool)
    end = first[1:][doc] if n else doc
    windows[:] = np.arange(n) + WIDTH <= end
    anchor, where = np.zeros(n, _U), np.full(n, -1)
    todo = windows.copy()
    if todo.any():
        all_ = [np.concatenate(x) for x in zip(*symbols(h, doc), strict=True)]
        span = all_[2] - all_[1]
        fits = all_[4] - all_[3] <= WIDTH
        for least, most in CLASSES:
            take = fits & (span >= least) & (span <= most)
            name, s, e, lo, hi = (x[take] for x in all_)
            order = np.argsort(s, kind="stable")
            name, s, e, lo, hi = (x[order] for x in (name, s, e, lo, hi))
            rank = (np.minimum(e - s, 63).astype(_U) << _U(58)) | (tokens.mix(name) >> _U(6))
            best, win = np.zeros(n, _U), np.full(n, n)
            reach = []
            for k in range(WIDTH):
                w = lo - k
                ok = (w >= 0) & (hi - w <= WIDTH)
                ok[ok] = todo[w[ok]]
                i = np.flatnonzero(ok)
                if not len(i):
                    continue
                reach.append((w[i], i))
                np.maximum.at(best, w[i], rank[i])
            for w, i in reach:
                ok = best[w] == rank[i]
                np.minimum.at(win, w[ok], i[ok])
            got = np.flatnonzero(win < n)
            anchor[got], where[got] = name[win[got]], s[win[got]] * 64 + np.minimum(e[win[got]] - s[win[got]], 63)
            todo[got] = False
        rest = np.flatnonzero(todo)  # windows without a consistent symbol of more words: their greatest word
        if len(rest):
            rank = tokens.mix(h)
            best, win = np.zeros(len(rest), _U), np.zeros(len(rest), np.int64)
            for k in range(WIDTH):
                r = rank[rest + k]
                more = r > best if k else np.ones(len(rest), bool)
                best[more], win[more] = r[more], (rest + k)[more]
            anchor[rest], where[rest] = h[win], win * 64 + 1
    w = np.flatnonzero(windows)
    if not len(w):
        return (np.zeros(0, _U),) * 2 + (w,) * 3
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (where[w[1:]] != where[w[:-1]]) | (doc[w[1:]] != doc[w[:-1]])
    u = w[new]
    count = np.diff(np.append(np.flatnonzero(new), len(w)))
    return anchor[u], tokens.spans(tokens.prefix(h), u, u + count + WIDTH - 1), u, count, doc[u]


def _batch(columns, names):
    return pa.record_batch([pa.array(x, t) for x, t in columns], names=names)


def unit_table(docs: DataFrame) -> DataFrame:
    """a, c, row (key of the document), u (first window), n (windows)."""
    def run(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            for i, _, h, first in tokens.words(b.column(1), False):
                a, c, u, n, row = units(h, first)
                yield _batch([(tokens.signed(a), pa.int64()), (tokens.signed(c), pa.int64()), (key[i + row], pa.int64()), (u - first[row], pa.int32()), (n, pa.int32())], ["a", "c", "row", "u", "n"])

    return docs.select("row", "text").mapInArrow(run, "a long, c long, row long, u int, n int")


def _kept(text: str | None, gone: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, removed, kept words joined by spaces) with words [s, e) of each span removed."""
    w = (text or "").encode().split()
    out, at, removed = [], 0, 0
    for s, e in sorted(gone):
        if e > at:
            out += w[at : max(s, at)]
            removed += e - max(s, at)
            at = e
    out += w[at:]
    return len(w), removed, b" ".join(out)


def marked(docs: DataFrame, stash: Stash) -> DataFrame:
    """row, gone: array<struct<u, n>> (runs of repeated windows) of the documents that have any; docs: row, text."""
    ut = stash(unit_table(docs), "units")
    twice = ut.groupBy("a").agg(F.count("*").alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("k > 1")
    # aggregates are written before they are joined: a join on its own exchanges is one that Spark can split
    twice = stash(twice.select("a", (F.col("c0") < F.col("c1")).alias("mixed")), "twice")
    stash.release()
    found = stash(ut.join(twice, "a"), "found")
    stash.drop("units", "twice")
    stash.release()
    several = found.where("mixed").groupBy("a", "c").agg(F.count("*").alias("k"), F.min(F.struct("row", "u", "n")).alias("one"))
    several = stash(several, "several")
    joined = found.where("mixed").join(several.select("a", "c", "k"), ["a", "c"])
    sure = found.where("not mixed").select("row", "u", "n").unionAll(joined.where("k > 1").select("row", "u", "n"))
    sure = stash(sure, "sure")
    seen = several.select(F.col("one.row").alias("row"), F.struct(F.col("one.u").alias("u"), F.col("one.n").alias("n"), "a", F.least(F.col("k"), F.lit(2)).cast("int").alias("weight")).alias("s"))
    # what is collected for a row is at most what its own text has
    of = seen.groupBy("row").agg(F.collect_list("s").alias("segs"))
    looked = stash(docs.join(of, "row").mapInArrow(_windows, "a long, w long, row long, u int, weight int"), "windows")
    stash.drop("found", "several")
    stash.release()
    again = stash(looked.groupBy("a", "w").agg(F.sum("weight").alias("k")).where("k > 1").select("a", "w"), "again")
    single = looked.where("weight = 1").join(again, ["a", "w"]).select("row", "u", F.lit(1).alias("n"))
    gone = sure.unionAll(single).groupBy("row").agg(F.collect_list(F.struct("u", "n")).alias("gone"))
    gone = stash(gone, "gone")
    stash.drop("sure", "windows", "again")
    stash.release()
    return gone


def _windows(batches):
    """Each window of each segment: anchor, hash, document, place, weight."""
    for b in batches:
        names = b.schema.names
        rows, text, segs = (b.column(names.index(x)) for x in ("row", "text", "segs"))
        rows, segs = rows.to_numpy(), segs.to_pylist()
        for i, _, h, first in tokens.words(text, False):
            sums = tokens.prefix(h)
            a, u, n, k, row = [], [], [], [], []
            for j in range(len(first) - 1):
                for s in segs[i + j]:
                    a.append(s["a"])
                    u.append(first[j] + s["u"])
                    n.append(s["n"])
                    k.append(s["weight"])
                    row.append(j)
            if not a:
                continue
            n, row = np.array(n), np.array(row)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, row = np.repeat(np.array(u), n) + step, np.repeat(row, n)
            yield _batch([(np.repeat(np.array(a), n), pa.int64()), (tokens.signed(tokens.spans(sums, at, at + WIDTH)), pa.int64()), (rows[i + row], pa.int64()), (at - first[row], pa.int32()), (np.repeat(np.array(k), n), pa.int32())], ["a", "w", "row", "u", "weight"])


def numbered(docs: DataFrame, stash: Stash) -> DataFrame:
    """The rows, written once with a number each (row): repeated rows and ids stay apart, and none is a hot key."""
    return stash(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def digest(docs: DataFrame, stash: Stash) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    def run(batches):
        for b in batches:
            out = [_kept(t, [(x["u"], x["u"] + x["n"] + WIDTH - 1) for x in g or ()]) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    d = numbered(docs.select("doc_id", "text"), stash)
    gone = marked(d.select("row", "text"), stash)
    return d.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, stash: Stash) -> DataFrame:
    """The documents with repeated words removed: texts that lose none stay as they are, others join what is left by spaces."""
    def run(batches):
        for b in batches:
            text = [t if not g else _kept(t, [(x["u"], x["u"] + x["n"] + WIDTH - 1) for x in g])[2].decode() for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(text, pa.string()), *b.columns[2:]], names=["text", *b.schema.names[2:]])

    # columns go by place, so that those of the documents may have any names
    rest = [c for c in docs.columns if c != "text"]
    d = numbered(docs.select("text", F.struct(*rest).alias("rest")), stash)
    gone = marked(d.select("row", "text"), stash)
    x = d.join(gone, "row", "left").select("text", "gone", "rest")
    x = x.mapInArrow(run, x.select("text", "rest").schema)
    chars = {"n_chars": F.length("text").cast("long")} if "n_chars" in rest else {}
    return x.select(*(F.col("text") if c == "text" else chars[c].alias(c) if c in chars else F.col("rest")[c].alias(c) for c in docs.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), Stash(spark))


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without their repeated windows; those left without a word stay, empty."""
    return cleaned(docs, Stash(spark))

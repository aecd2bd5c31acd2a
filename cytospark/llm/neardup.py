"""Near-duplicate documents by SetSketch registers, bands, joint likelihood and verification on full shingle sets.

A set's register i is floor(1 - log_b x), x the least of exponential variables that the shingles draw for i: minima
spaced exponentially and truncated to 16 bits, equal in two sets with a probability of about their similarity. Bands of
five registers find candidates; every candidate is confirmed on the full sets, so no false link is made. At similarity
0.75 a pair shares none of 60 bands with probability 1e-7.

No group's pairs are listed. Sets that are equal are one class. Each class is first verified against one partner, the
smallest id in the bands they share; links contract into components; buckets whose members are by then in one component
are finished. In the rest, members outside a bucket's largest component are compared with all others, 512 against 1,024
at a time: by likelihood given both sizes (4.5 standard errors of margin), which says whose full sets are needed; then
those sets meet in one group, where an inverted index of the asking ones counts all intersections, and only links that
join two components come out. So what is shuffled grows with a bucket's rows, not with its pairs.

Null and empty texts (no words) have no set, size 0, and are linked with nothing; texts of under five words are one
shingle. Long texts are handled whole. Rows with equal doc_id and different texts are linked each for itself, and share
the name only; equal rows are one class. A null doc_id is linked with nothing. Of ties the least doc_id names a group. An
empty table gives an empty result. Extra columns are not read; ``keep`` passes them on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Stash, table
from .components import components

SHINGLE = 5
NUM, DEN = 75, 100
BANDS, ROWS = 60, 5
M = BANDS * ROWS
SPACING = 1.001
#: Members of a bucket that are compared in one group, and members asking at a time.
BLOCK, CHUNK = 1024, 512
#: Shingles of the asking members that a group holds while the others pass.
SHINGLES = 1 << 20
#: Candidates estimated below this are dropped unverified.
CUT = NUM / DEN - 4.5 * math.sqrt(NUM / DEN * (1 - NUM / DEN) / M)
_A = (np.random.default_rng(7).integers(0, 2**31, M, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_U = np.uint64


def shingle_sets(column: pa.Array):
    """Sorted distinct shingle hashes of each text, in order of rows."""
    for _, _, h, first in tokens.words(column, True):
        sums = tokens.prefix(h)
        begin = np.arange(max(0, len(h) - SHINGLE + 1))
        grams = tokens.spans(sums, begin, begin + SHINGLE)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= SHINGLE:
                yield np.unique(grams[s : e - SHINGLE + 1])
            elif e > s:
                yield tokens.spans(sums, np.array([s]), np.array([e]))
            else:
                yield np.zeros(0, _U)


def registers(s: np.ndarray) -> np.ndarray:
    half = M // 2
    low, high = s.astype(np.uint32), (s >> _U(32)).astype(np.uint32)
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), 256):
        for part, x in ((slice(0, half), low), (slice(half, M), high)):
            np.minimum(least[part], (x[k : k + 256, None] * _A[None, part]).min(0), out=least[part])
    x = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x) / math.log(SPACING)), 0, 65535).astype("<u2")


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n (set size), k1 and k2 (128-bit fingerprint of the set), sig (registers; null for
    an empty set)."""
    def run(batches):
        for b in batches:
            n, k1, k2, sig = [], [], [], []
            for s in shingle_sets(b.column(2)):
                n.append(len(s))
                k1.append(int(tokens.mix(s).sum(dtype=_U)) - 2**63)
                k2.append(int(tokens.mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)) - 2**63)
                sig.append(registers(s).tobytes() if len(s) else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "t", "n", "k1", "k2", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc_id long, t long, n long, k1 long, k2 long, sig binary")


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the most likely similarity, given registers and set sizes, reaches CUT, and the sizes allow a link.

    The likelihood is concave in the similarity, so the sign of its slope at CUT decides.
    """
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = M - above - below
    u, v = na / (na + nb), nb / (na + nb)
    z, lb = (SPACING - 1) / SPACING, math.log(SPACING)
    p = lambda x: -np.log1p(-z * x) / lb
    slope = lambda x: z / (lb * (1 - z * x))
    xa, xb = np.maximum(u - v * CUT, 1e-12), np.maximum(v - u * CUT, 1e-12)
    pa_, pb = p(xa), p(xb)
    rest = np.maximum(1 - pa_ - pb, 1e-12)
    d = -above * v * slope(xa) / pa_ - below * u * slope(xb) / pb + same * (v * slope(xa) + u * slope(xb)) / rest
    return (d >= 0) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb))


def by_group(batches, names: tuple[str, ...]):
    """Tables of one or more whole groups, from batches sorted by the columns names, and where each group starts."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        g = [held.column(x).to_numpy() for x in names]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in g], axis=0)) + 1
        if len(change):
            yield held.slice(0, change[-1]), np.concatenate([[0], change])
            held = held.slice(change[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


GROUP = ("key", "bi", "bj")
PART = "key long, bi int, bj int, sub int, side int, id long, c long"


def open_rows(at: DataFrame, reps: DataFrame, stash: Stash) -> DataFrame:
    """Rows for likely_parts of the buckets whose members are in several components; at: key, i, id, c.

    A bucket's largest component is compared with the others only, not with itself: all members stand once in blocks
    (side 1), and those outside the largest component ask each block (side 0), in chunks of their own.
    """
    by = at.groupBy("key", "c").agg(F.count("*").alias("k"))
    some = by.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    up = lambda x, n: F.ceil(x / n).cast("int")
    some = some.select("key", F.col("top.c").alias("major"), up(F.col("size"), BLOCK).alias("nb"), up(F.col("size") - F.col("top.k"), CHUNK).alias("nm"))
    # aggregates are written before they are joined: a join on its own exchanges is one that Spark can split
    some = stash(some, "open")
    rest = at.join(some, "key")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = rest.select("key", "i", "id", "c", own("nb").alias("bi"), each("nm").alias("bj"), F.lit(1).alias("side"))
    asking = rest.where("c <> major").select("key", "i", "id", "c", each("nb").alias("bi"), own("nm").alias("bj"), F.lit(0).alias("side"))
    full = there.unionAll(asking).join(reps.select("id", "n", "sig"), "id").select("key", "i", "bi", "bj", "side", "id", "c", "n", "sig")
    return full.repartition(*GROUP).sortWithinPartitions(*GROUP)


def likely_parts(rows: DataFrame) -> DataFrame:
    """PART: the members of each group that may be linked with one of another component, in the first band the two share.

    No pairs come out. sub cuts a group so that its asking members (side 0) hold about SHINGLES shingles.
    """
    def run(batches):
        for t, at in by_group(batches, GROUP):
            ids, c, n, side, band = (t.column(x).to_numpy() for x in ("id", "c", "n", "side", "i"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, M)
            size, take, sub = n.astype(float), [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                asks, members = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                cut, held, used = 0, 0, np.zeros(len(members), bool)
                for i in asks.tolist():
                    m = np.flatnonzero((c[members] != c[i]) & (DEN * np.minimum(n[members], n[i]) >= NUM * np.maximum(n[members], n[i])))
                    j = members[m]
                    if not len(j):
                        continue
                    # a pair that shares several buckets is looked at in one
                    first = (sig[j] == sig[i]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i]
                    m, j = m[first], j[first]
                    if not len(j):
                        continue
                    ok = likely(np.broadcast_to(sig[i], (len(j), M)), sig[j], np.full(len(j), size[i]), size[j])
                    if not ok.any():
                        continue
                    if held and held + n[i] > SHINGLES:
                        take.append(members[used])
                        sub.append(np.full(int(used.sum()), cut))
                        cut, held, used = cut + 1, 0, np.zeros(len(members), bool)
                    used[m[ok]] = True
                    held += n[i]
                    take.append(np.array([i]))
                    sub.append(np.array([cut]))
                take.append(members[used])
                sub.append(np.full(int(used.sum()), cut))
            if sum(map(len, take)):
                r = pa.array(np.concatenate(take).astype(np.int64))
                part = {x: t.column(x).combine_chunks().take(r) for x in ("key", "bi", "bj", "side", "id", "c")} | {"sub": pa.array(np.concatenate(sub).astype(np.int32))}
                yield pa.record_batch([part[x] for x in ("key", "bi", "bj", "sub", "side", "id", "c")], names=["key", "bi", "bj", "sub", "side", "id", "c"])

    return rows.mapInArrow(run, PART)


class _Asks:
    """The asking members of a group and an inverted index of their full sets."""

    def __init__(self):
        self.ids, self.c, self.sets, self.index = [], [], [], None

    def add(self, id_: int, c: int, s: np.ndarray) -> None:
        self.ids.append(id_)
        self.c.append(c)
        self.sets.append(s)

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Which asking members reach the threshold with the set s."""
        if self.index is None:
            every, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
            order = np.argsort(every, kind="stable")
            names, start = np.unique(every[order], return_index=True)
            self.index = names, np.append(start, len(every)), owner[order]
            self.size = np.array([len(x) for x in self.sets])
            self.sets = []
        names, start, owner = self.index
        at = np.searchsorted(names, s)
        at = at[np.append(names, _U(0))[at] == s] if len(names) else at[:0]
        at = at[at < len(names)]
        k = start[at + 1] - start[at]
        places = np.repeat(start[at] - np.cumsum(k) + k, k) + np.arange(k.sum())
        both = np.bincount(owner[places], minlength=len(self.ids))
        return np.flatnonzero((both > 0) & (DEN * both >= NUM * (self.size + len(s) - both)))


def links_in_parts(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links on full sets between components of each part, only those that still join two of them there."""
    def run(batches):
        group, asks, up = None, _Asks(), {}

        def root(v):
            while up.setdefault(v, v) != v:
                up[v] = v = up[up[v]]
            return v

        for t in batches:
            a, b = [], []
            cols = [t.column(x).to_pylist() for x in ("key", "bi", "bj", "sub", "side", "id", "c")]
            for *g, side, id_, c, s in zip(*cols, shingle_sets(t.column(t.schema.names.index("text"))), strict=True):
                if g != group:
                    group, asks, up = g, _Asks(), {}
                if side == 0:
                    asks.add(id_, c, s)
                    continue
                if not asks.ids:
                    continue
                for k in asks.linked(s).tolist():
                    x, y = root(c), root(asks.c[k])
                    if x != y:
                        up[x] = y
                        a.append(id_)
                        b.append(asks.ids[k])
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ("key", "bi", "bj", "sub")
    x = parts.join(texts, "id").select(*keys, "side", "id", "c", "text")
    return x.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(shingle_sets(t.column(2)), shingle_sets(t.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(DEN * both >= NUM * (len(x) + len(y) - both) > 0)
            t = t.select([0, 1]).filter(pa.array(ok, pa.bool_()))
            if t.num_rows:
                yield t

    x = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    x = x.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return x.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def contracted(cc: DataFrame, links: DataFrame, stash: Stash, name: str) -> DataFrame:
    """(id, component) after more links: only the links between components are followed."""
    at = lambda c: cc.select(F.col("id").alias(c), F.col("component").alias(f"{c}_"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    new = components(between, stash, name).select(F.col("id").alias("component"), F.col("component").alias("next"))
    old = cc.join(new, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    alone = new.join(cc.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("next").alias("component"))
    return stash(old.unionAll(alone), f"{name}-all")


def groups(docs: DataFrame, stash: Stash) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches of all rows, classes of equal sets, components that links join: id, component).

    A class has an id of its own, its set's fingerprint (k1, k2, n) and its first row: the least (doc_id, t).
    """
    sk = stash(sketch(docs), "sketch")
    cls = sk.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "t")).alias("row"), F.first("sig").alias("sig"))
    reps = stash(cls.select(F.monotonically_increasing_id().alias("id"), "row", "n", "k1", "k2", "sig"), "reps")
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    keys = reps.select("id", "sig", band.alias("i")).select(F.xxhash64("i", F.substring("sig", F.col("i") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("key"), "id", "i")
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "lo")
    # aggregates are written before they are joined: a join on its own exchanges is one that Spark can split
    shared = stash(shared, "shared")
    stash.release()
    hits = stash(keys.join(shared, "key"), "hits")
    met = hits.select("id").distinct().join(reps.select("id", "row"), "id").select("id", F.col("row.doc_id").alias("doc_id"), F.col("row.t").alias("t"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(met, ["doc_id", "t"]).select("id", "text").dropDuplicates(["id"])
    texts = stash(texts, "texts")
    stash.release()
    star = hits.where("id <> lo").groupBy("id", "lo").agg(F.count("*").alias("n"))
    first = star.groupBy("id").agg(F.max(F.struct("n", (-F.col("lo")).alias("lo"))).alias("m")).select(F.col("id").alias("a"), (-F.col("m.lo")).alias("b"))
    cc = components(verified(first, texts), stash, "near1")
    at = hits.select("key", "i", "id").join(cc, "id", "left").select("key", "i", "id", F.coalesce("component", "id").alias("c"))
    at = stash(at, "at")
    cc = contracted(cc, links_in_parts(likely_parts(open_rows(at, reps, stash)), texts), stash, "near2")
    stash.drop("hits", "at", "shared", "texts", "open")
    stash.release()
    return sk, reps, cc


def first_rows(reps: DataFrame, cc: DataFrame, stash: Stash) -> DataFrame:
    """c, top: each component's (or unlinked class's) least (doc_id, t); and the classes' ids: id, c."""
    at = stash(reps.select("id", "row", "k1", "k2", "n").join(cc, "id", "left").select("row", "k1", "k2", "n", F.coalesce("component", "id").alias("c")), "placed")
    return at, stash(at.groupBy("c").agg(F.min("row").alias("top")), "tops")


def near_duplicates(docs: DataFrame, stash: Stash) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    sk, reps, cc = groups(docs, stash)
    at, tops = first_rows(reps, cc, stash)
    cls = stash(at.join(tops, "c").select("k1", "k2", "n", F.col("top.doc_id").alias("top")), "named")
    stash.release()
    out = sk.select("doc_id", "n", "k1", "k2").join(cls, ["k1", "k2", "n"], "left")
    top = F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), top.alias("component_id"), F.coalesce(F.col("doc_id") == top, F.lit(True)).alias("kept"))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Stash(spark))


def keep(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group, that of the least (doc_id, hash of the text); of equal rows any one. Rows
    without an id or without words are linked with nothing and all stay."""
    stash = Stash(spark)
    _, reps, cc = groups(docs, stash)
    _, tops = first_rows(reps, cc, stash)
    stash.release()
    alone = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)) | F.col("doc_id").isNull()
    # the columns go as one struct, so that they may have any names
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("t"), alone.alias("alone"))
    one = rows.where("not alone").join(tops.select("top.doc_id", "top.t"), ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
    return one.select("row.*").unionAll(rows.where("alone").select("row.*"))

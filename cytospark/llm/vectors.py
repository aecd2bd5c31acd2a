"""Embedding near-dedup: coarse inverted lists, product-quantised residuals, table-lookup distances, exact rerank.

Codebooks are trained on a bounded sample (``sample`` vectors of least hash of their id); every vector is indexed: its
nearest centroid's list, the codes of its residual and their error. A query probes its own list and each list whose
border with it is within the link distance (``slack`` 1): a vector beyond a border is no nearer than the border, so no
link is dropped, and a found link counts for both ends. In a list, distances are sums of table lookups; a vector passes if its distance less its own coding error
allows a link, which drops no link, and is then compared by cosine in double precision.

Equal vectors of one label are one class, searched once. Lists beyond ``block`` members are searched in blocks, pairs of
blocks being separate groups. A block answers with counts and a spanning forest of its links, never with all pairs.

Vectors that are null, zero, of another length than most, or hold null or non-finite components, and rows with a null
label, have no links. Rows with equal vec_id and vector are one class like other equal vectors. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, table
from .components import components, merged

COSINE = 0.93


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles (bad ones zero), and which are usable."""
    rows = column.to_pylist() if column.null_count or len(column.flatten()) != dim * len(column) or column.flatten().null_count else None
    if rows is None:
        x = column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)
    else:
        x = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            if r is not None and len(r) == dim and None not in r:
                x[i] = r
    ok = np.isfinite(x).all(1)
    x[~ok] = 0
    return x, ok & (np.abs(x).max(1, initial=0) > 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


class Index:
    """Centroids and residual codebooks: a bounded model, at most lists * dim and codes * dim numbers."""

    def __init__(self, x: np.ndarray, lists: int, parts: int = 16, codes: int = 32, seed: int = 5):
        self.centroids = kmeans(x, lists, 8, seed)
        self.parts = next(p for p in range(min(parts, x.shape[1]), 0, -1) if x.shape[1] % p == 0)
        self.width = x.shape[1] // self.parts
        r = x - self.centroids[nearest(x, self.centroids)]
        self.books = [kmeans(r[:, self.cut(p)], codes, 6, seed + p) for p in range(self.parts)]

    def cut(self, p: int) -> slice:
        return slice(p * self.width, (p + 1) * self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the distance to what the codes stand for."""
        own = nearest(x, self.centroids)
        r = x - self.centroids[own]
        codes = np.stack([nearest(r[:, self.cut(p)], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1)
        return own, codes, np.sqrt(((r - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """Which lists each query visits: those whose border with its own list is within reach."""
        c = self.centroids
        d = (c * c).sum(1) - 2 * (x @ c.T)
        gap = np.sqrt(np.maximum((c * c).sum(1)[own][:, None] + (c * c).sum(1)[None] - 2 * c[own] @ c.T, 0))
        return d - d[np.arange(len(x)), own][:, None] <= 2 * (gap + 1e-7) * reach + 1e-9

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """For each part, squared distances of each code of a list to each query's residual: (codes, queries)."""
        r = (x - self.centroids[at]).T
        return [(b * b).sum(1)[:, None] - 2 * (b @ r[self.cut(p)]) + (r[self.cut(p)] ** 2).sum(0)[None] for p, b in enumerate(self.books)]


def prepared(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, label, ok, k1, k2 (fingerprint of the vector), e (little-endian doubles, normalised)."""
    import hashlib

    def run(batches):
        for b in batches:
            x, ok = _matrix(b.column(2), dim)
            ok &= b.column(1).is_valid().to_numpy(zero_copy_only=False)
            keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x + 0.0]
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            e = [r.tobytes() if good else None for r, good in zip(x, ok.tolist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ok), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(e, pa.binary())], names=["vec_id", "label", "ok", "k1", "k2", "e"])

    return vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(run, "vec_id long, label long, ok boolean, k1 long, k2 long, e binary")


ROW = "label long, bundle int, asks boolean, id long, m long, e binary, list int, codes binary, err double"


def _expand(index: Index, reach: float, bundles: int):
    """Each class as a row of its own bundle of lists, and as a query row of its own and of other bundles it probes.

    Of two bundles one asks the other: the lower, if their numbers add up to an even one, else the higher.
    """
    def run(batches):
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            ids, label, m, raw = (b.column(i) for i in range(4))
            x = unit(np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(len(ids), -1))
            own, codes, err = index.encode(x)
            hit = np.zeros((len(x), bundles), bool)
            q, at = np.nonzero(index.probes(x, own, reach))
            hit[q, at % bundles] = True
            mine, other = (own % bundles)[:, None], np.arange(bundles)[None]
            hit &= (mine == other) | ((mine < other) == ((mine + other) % 2 == 0))
            q, at = np.nonzero(hit)
            take = pa.array(np.concatenate([np.arange(len(ids)), q]))
            asks = np.concatenate([np.zeros(len(ids), bool), np.ones(len(q), bool)])
            yield pa.record_batch([
                label.take(take), pa.array(np.concatenate([own % bundles, at]).astype(np.int32)), pa.array(asks), ids.take(take), m.take(take), raw.take(take),
                pa.array(own.astype(np.int32)).take(take), pa.array([c.tobytes() for c in codes], pa.binary()).take(take), pa.array(err).take(take),
            ], names=["label", "bundle", "asks", "id", "m", "e", "list", "codes", "err"])

    return run


def _search(index: Index, cosine: float, reach: float, bundles: int):
    """One group: the members of a block of a bundle, list by list, against a block of its queries.

    A pair of different bundles is met here only, and counts for both ends; one of the same bundle is met once from
    either end.
    """
    link = math.sqrt(2 - 2 * cosine) + 1e-9

    def run(t: pa.Table) -> pa.Table:
        asks, at = t.column("asks").to_numpy(), t.column("bundle")[0].as_py()
        ids, m, err, own = (t.column(c).to_numpy() for c in ("id", "m", "err", "list"))
        raw = np.frombuffer(b"".join(t.column("e").to_pylist()), "<f8").reshape(len(ids), -1)
        norm = np.sqrt((raw * raw).sum(1))
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        limit = (link + err + 1e-9) ** 2
        members = {v: np.flatnonzero(~asks & (own == v)) for v in np.unique(own[~asks]).tolist()}
        query = np.flatnonzero(asks)
        total = np.zeros(len(ids), np.int64)
        names, who = np.unique(ids, return_inverse=True)
        least = np.arange(len(names))  # of the vectors linked so far, by place among names
        for k in range(0, len(query), 256):
            visits = index.probes(raw[query[k : k + 256]] / norm[query[k : k + 256], None], own[query[k : k + 256]], reach)
            for v, member in members.items():
                q = query[k : k + 256][visits[:, v]]
                if not len(q):
                    continue
                near = np.zeros((len(member), len(q)))
                for p, table_ in enumerate(index.tables(raw[q] / norm[q, None], v)):
                    near += table_[codes[member, p]]
                y, x = np.nonzero(near <= limit[member, None])
                i, j = q[x], member[y]
                dots = [np.einsum("ij,ij->i", raw[i[s : s + 20_000]], raw[j[s : s + 20_000]]) for s in range(0, len(i), 20_000)]
                ok = np.concatenate([np.zeros(0), *dots]) / (norm[i] * norm[j]) >= cosine
                ok &= ids[i] != ids[j]
                i, j = i[ok], j[ok]
                np.add.at(total, i, m[j])
                other = own[i] % bundles != at
                np.add.at(total, j[other], m[i[other]])
                least = merged(least, who[i], who[j])
        some, up = np.flatnonzero(total), np.flatnonzero(least != np.arange(len(names)))
        a, n = np.concatenate([ids[some], names[up]]), np.concatenate([total[some], np.zeros(len(up), np.int64)])
        return pa.table([pa.array(a), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(names[least[up]])]), pa.array(n)], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, stash: Stash, cosine: float = COSINE, sample: int = 20_000, most_lists: int = 1024, block: int = 1024, slack: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    none = lambda: vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not dims or not dims["d"]:
        return none()
    p = stash(prepared(vectors, dims["d"]), "prepared")
    cls = p.where("ok").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))
    cls = stash(cls, "classes")
    first = p.where("ok").select(F.col("vec_id").alias("id"), "label", "k1", "k2", "e").join(cls, ["label", "k1", "k2", "id"])
    reps = stash(first.dropDuplicates(["label", "k1", "k2"]).select("id", "label", "m", "e"), "reps")
    got = reps.orderBy(F.xxhash64("id"), "label").limit(sample).collect()
    if not got:
        return none()
    n = reps.count()
    x = unit(np.frombuffer(b"".join(bytes(r["e"]) for r in got), "<f8").reshape(len(got), -1))
    index = Index(x, max(1, min(most_lists, round(math.sqrt(n) / 2), len(got))))
    reach = slack * math.sqrt(2 - 2 * cosine)
    # lists of few members are searched in bundles of about a block, so that a query is not copied for each list
    bundles = max(1, min(len(index.centroids), -(-n // (block * reps.select("label").distinct().count()))))
    rows = stash(reps.select("id", "label", "m", "e").mapInArrow(_expand(index, reach, bundles), ROW), "rows")
    sizes = rows.groupBy("label", "bundle").agg(F.count_if("asks").alias("q"), F.count_if(~F.col("asks")).alias("s")).where("q > 0 and s > 0")
    sizes = sizes.select("label", "bundle", F.ceil(F.col("s") / block).cast("int").alias("sb"), F.ceil(F.col("q") / block).cast("int").alias("qb"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("asks"), F.col("qb")).otherwise(F.col("sb"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("sb")).otherwise(F.col("qb")) - 1))
    dealt = rows.join(sizes, ["label", "bundle"]).select(*rows.columns, own.alias("own"), others.alias("other"))
    dealt = dealt.select(*rows.columns, F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("si"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("qi"))
    found = stash(dealt.groupBy("label", "bundle", "si", "qi").applyInArrow(_search(index, cosine, reach, bundles), "a long, b long, n long"), "found")
    stash.drop("rows")
    stash.release()
    cc = components(found.where("b is not null").select("a", "b"), stash, "vec")
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("other_links"))
    full = cls.join(links, "id", "left").join(cc, "id", "left").select(F.col("label").alias("l_"), F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), "id", "m", "other_links", "component")
    out = p.join(full, F.expr("ok and label = l_ and k1 = k1_ and k2 = k2_"), "left")
    top = F.coalesce("component", "id", "vec_id")
    n_links = F.when(F.col("id").isNull(), 0).otherwise(F.col("m") - 1 + F.coalesce("other_links", F.lit(0)))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), top.alias("component_id"), F.coalesce(F.col("vec_id") == top, F.lit(True)).alias("kept"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), Stash(spark))

"""Katz backoff language model over add-half unigrams: counted, stored in partitioned tables, evaluated level by level.

Training documents give counts of words and, for each level k up to ``order`` (two by default), of (context of k - 1
words, word). P_k(w | h) is the Good-Turing discounted share of c(h, w) where that is positive, else alpha(h) times
P_{k-1}(w | h without its first word); alpha(h) makes the sum over all words, the unknown one included, exactly one. The
recursion ends at the add-half unigram. A context whose continuations keep all their mass (all counts beyond the
discounted ones) is treated as seen once more, and that share is its backoff mass. Documents begin after as many begin
marks as a context has words.

Documents are tokenised once, into written batches of about ``batch_bytes`` of text (distinct words and places in them).
A batch asks each partition of a table for its distinct keys once, with its own training counts; the partition adds the
counts of all batches (that is the table's content), and answers in the order asked. So what is shuffled is distinct
keys a batch, packed, and no word is hot. Partitions are ranges of the keys' hashes, as many as there are batches, so a
task's share does not grow with the corpus. Rounds: words; then for each level the continuations, where one batch is told
to own each, and the contexts: the batches send the discounted counts and lower-level masses of what they own, from
which the partition makes alpha. Answers and tables (``words``, ``grams-k``, ``contexts-k``) are written to the shared
folder.

Null texts count as empty: one end token. A null doc_id counts as the empty text in the split. Repeated rows, and rows
of one id with other texts, are counted and scored each for itself. Long texts are handled whole: a text beyond the batch
size is a batch of its own. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Stash, table

FOLDS, HELD = 5, 1
#: Counts up to this are discounted.
MOST = 5
_U = np.uint64
BEGIN, END = _U(0x1D8E4E27C47D124F), _U(0xEB44ACCAB455D165)
BATCHED = "batch long, ids binary, sizes binary, words binary, places binary"
ASK = "batch long, bucket int, keys binary, counts binary"
ANSWER = "kind int, batch long, bucket int, a binary, b binary"
#: What an answer table's rows are: statistics, answers to batches, the model's table.
STATS, REPLY, TABLE = 0, 1, 2


def _zip(x: np.ndarray) -> bytes:
    """Packed by columns and byte planes: the high bytes of small numbers vanish."""
    x = np.ascontiguousarray(x.T)
    return zstandard.ZstdCompressor(level=1).compress(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unzip(b: bytes, kind: str, width: int = 1) -> np.ndarray:
    """(rows, width), or (rows,) of one column."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    flat = np.ascontiguousarray(planes.T).view(kind).ravel()
    return flat if width == 1 else flat.reshape(width, -1).T


def _zip_keys(sorted_: np.ndarray) -> bytes:
    return _zip(np.diff(sorted_, prepend=_U(0)))


def _unzip_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unzip(b, "<u8"), dtype=_U)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


class Batch:
    """Tokens of some documents: their distinct words (sorted hashes), each token's place in them, documents' firsts."""

    def __init__(self, ids: pa.Array, size: np.ndarray, words: np.ndarray, at: np.ndarray):
        self.ids, self.size, self.words, self.at = ids, size, words, at
        self.first = np.cumsum(size) - size
        self.held = np.array([held_out(i) for i in ids.to_pylist()], bool)
        self.train = np.repeat(~self.held, size)

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array) -> Batch:
        parts, sizes = [], []
        for _, _, h, first in tokens.words(texts, True):
            parts.append(h)
            sizes.append(np.diff(first))
        size = (np.concatenate(sizes) if sizes else np.zeros(0, np.int64)) + 1
        word = np.full(int(size.sum()), END, _U)
        inner = np.ones(len(word), bool)
        inner[np.cumsum(size) - 1] = False
        word[inner] = np.concatenate(parts) if parts else np.zeros(0, _U)
        return cls(ids, size, *np.unique(word, return_inverse=True))

    def row(self, name: int) -> tuple:
        sink = pa.BufferOutputStream()
        part = pa.record_batch([self.ids], names=["doc_id"])
        with pa.ipc.new_stream(sink, part.schema) as w:
            w.write_batch(part)
        return name, sink.getvalue().to_pybytes(), _zip(self.size.astype("<u4")), _zip_keys(self.words), _zip(self.at.astype("<u4"))

    @classmethod
    def read(cls, ids: bytes, sizes: bytes, words: bytes, places: bytes) -> Batch:
        x = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
        return cls(x, _unzip(sizes, "<u4").astype(np.int64), _unzip_keys(words), _unzip(places, "<u4"))

    def grams(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Each token's context of level - 1 words, and its key with the word."""
        word = self.words[self.at]
        place = np.arange(len(word)) - np.repeat(self.first, self.size)
        context = np.zeros(len(word), _U)
        for back in range(1, level):
            before = np.full(len(word), BEGIN, _U)
            before[place >= back] = word[np.flatnonzero(place >= back) - back]
            context = tokens.mix(context * _U(0x9FB21C651E98DF25) + before)
        return context, tokens.mix(context * _U(0xC2B2AE3D27D4EB4F) + tokens.mix(word))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each of x among them."""
    keys, at = np.unique(x, return_inverse=True)
    return keys, at.astype(np.uint32)


def batched(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """BATCHED rows of the documents, named by partition and place; they are written once and then read."""
    def run(stream):
        name = TaskContext.get().partitionId() << 32
        for b in stream:
            _, at = tokens.strings(b.column(1))
            # equal parts, so that no small rest asks for its keys again
            most = -(-(at[-1] - at[0]) // max(1, round((at[-1] - at[0]) / batch_bytes)))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
                part = b.slice(i, j - i)
                yield pa.record_batch([pa.array([x]) for x in Batch.of(part.column(0), part.column(1)).row(name)], names=["batch", "ids", "sizes", "words", "places"])
                name, i = name + 1, j

    return docs.select("doc_id", "text").mapInArrow(run, BATCHED)


def _cuts(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of n buckets (ranges of hashes) starts and ends among sorted keys."""
    border = np.array([-(-(i << 64) // n) for i in range(1, n)], _U)
    cut = np.searchsorted(keys, border, "left")
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])


def _asks(name: int, keys: np.ndarray, counts: np.ndarray, n: int):
    start, end = _cuts(keys, n)
    some = np.flatnonzero(end > start)
    return pa.record_batch([
        pa.array([name] * len(some), pa.int64()), pa.array(some.astype(np.int32)),
        pa.array([_zip_keys(keys[start[i] : end[i]]) for i in some], pa.binary()), pa.array([_zip(counts[start[i] : end[i]]) for i in some], pa.binary()),
    ], names=["batch", "bucket", "keys", "counts"])


def _replies(rows: list[tuple[int, bytes]], keys: np.ndarray, n: int, kind: str, width: int = 1) -> np.ndarray:
    """Values in the order of the sorted keys, from this batch's (bucket, packed values)."""
    start, end = _cuts(keys, n)
    out = np.zeros((len(keys), width) if width > 1 else len(keys), kind)
    for bucket, packed in rows:
        out[start[bucket] : end[bucket]] = _unzip(packed, kind, width)
    return out


def _gather(t: pa.Table, kind: str, width: int = 1):
    """A bucket's asks in order of batch: batches, distinct keys, counts as asked, each one's place, and cuts by batch."""
    t = t.take(pc.sort_indices(t, [("batch", "ascending")]))
    keys = [_unzip_keys(x) for x in t.column("keys").to_pylist()]
    counts = np.concatenate([_unzip(x, kind, width) for x in t.column("counts").to_pylist()])
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return t.column("batch").to_pylist(), distinct, counts, first, at, np.cumsum([len(k) for k in keys])[:-1]


def _answers(bucket: int, stats: np.ndarray, keys: np.ndarray, values: np.ndarray, names: list[int], replies: list[np.ndarray]) -> pa.Table:
    rows = [(STATS, None, bucket, stats.tobytes(), None), (TABLE, None, bucket, _zip_keys(keys), _zip(values))]
    cols = list(zip(*rows, *((REPLY, name, bucket, _zip(v), None) for name, v in zip(names, replies, strict=True)), strict=True))
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "batch", "bucket", "a", "b"])


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r = 0..MOST from counts of counts n[1..MOST + 1]: Good-Turing after Katz; where that leaves (0, 1), an
    absolute discount."""
    d = np.ones(MOST + 1)
    n1, n2 = n[1], n[2]
    top = (MOST + 1) * n[MOST + 1] / n1 if n1 else 1.0
    for r in range(1, MOST + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        v = (star / r - top) / (1 - top) if top < 1 else 0.0
        d[r] = v if 0 < v < 1 else 1 - (n1 / (n1 + 2 * n2) if n1 and n2 else 0.5) / r
    return d


class Katz:
    """The model's rounds over a corpus; the written tables are ``words``, ``grams-k`` and ``contexts-k``."""

    def __init__(self, docs: DataFrame, stash: Stash, batch_bytes: int = 1 << 23, order: int = 2):
        self.stash, self.order = stash, order
        self.batches = stash(batched(docs, batch_bytes), "batches")
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # a bucket has about as many keys as a batch, whatever the number of batches
        self.count = self.batches.count()
        self.n = max(self.parts, self.count)
        #: Answers in the order of rounds: words, grams 2, contexts 2, grams 3, ...
        self.rounds: list[DataFrame] = []
        self.discount: list[np.ndarray] = []
        phases = [self.words, *(p for level in range(2, order + 1) for p in (partial(self.grams, level), partial(self.contexts, level)))]
        for phase in phases:
            phase()
            # out here, where nothing refers to the phase's plans any more
            stash.release()

    def spread(self, df: DataFrame, key: str, n: int) -> DataFrame:
        """Grouped by key; in more tasks than the session's where the data need them."""
        return (df.repartition(n, key) if n > self.parts else df).groupBy(key)

    def answered(self, asked: DataFrame, answer, name: str) -> None:
        self.rounds.append(self.stash(self.spread(asked, "bucket", self.n).applyInArrow(answer, ANSWER), name))

    def stats(self) -> np.ndarray:
        """Sum of the last round's statistics: at most eight numbers a bucket."""
        return sum(np.frombuffer(bytes(r["a"]), "<i8") for r in self.rounds[-1].where(F.col("kind") == STATS).select("a").toLocalIterator())

    def words(self) -> None:
        n = self.n

        def ask(stream):
            for name, x in each(stream):
                yield _asks(name, x.words, np.bincount(x.at[x.train], minlength=len(x.words)).astype("<u4"), n)

        def answer(t: pa.Table) -> pa.Table:
            names, keys, counts, _, at, cuts = _gather(t, "<u4")
            c = np.bincount(at, counts, len(keys)).astype("<i8")
            return _answers(t.column("bucket")[0].as_py(), np.array([c.sum(), (c > 0).sum()], "<i8"), keys[c > 0], c[c > 0], names, np.split(c[at], cuts))

        self.answered(self.batches.mapInArrow(ask, ASK), answer, "words")
        self.tokens, self.distinct = map(int, self.stats()) if self.count else (0, 0)

    def grams(self, level: int) -> None:
        n = self.n

        def ask(stream):
            for name, x in each(stream):
                keys, at = distinct(x.grams(level)[1])
                yield _asks(name, keys, np.bincount(at[x.train], minlength=len(keys)).astype("<u4"), n)

        def answer(t: pa.Table) -> pa.Table:
            names, keys, counts, first, at, cuts = _gather(t, "<u4")
            c = np.bincount(at, counts, len(keys)).astype("<i8")
            mine = np.zeros(len(at), bool)
            mine[first] = True
            stats = np.bincount(np.minimum(c, MOST + 2), minlength=MOST + 3).astype("<i8")
            reply = (np.minimum(c, 2**31 - 1)[at] * 2 + mine).astype("<u4")
            return _answers(t.column("bucket")[0].as_py(), stats, keys[c > 0], c[c > 0], names, np.split(reply, cuts))

        self.answered(self.batches.mapInArrow(ask, ASK), answer, f"grams-{level}")
        self.discount.append(discounts(self.stats().tolist()) if self.count else np.ones(MOST + 1))

    def met(self) -> tuple[DataFrame, object]:
        """Batches grouped with the answers so far, and the function that evaluates such a group."""
        none = [F.lit(None).cast("binary").alias(c) for c in ("sizes", "words", "places")]
        out = self.batches.select(F.lit(-1).alias("round"), "batch", F.lit(0).alias("bucket"), F.col("ids").alias("a"), "sizes", "words", "places")
        for k, r in enumerate(self.rounds):
            out = out.unionAll(r.where(F.col("kind") == REPLY).select(F.lit(k).alias("round"), "batch", "bucket", "a", *none))
        n, discount, rounds = self.n, self.discount, len(self.rounds)
        mass = self.tokens + 0.5 * (self.distinct + 1)

        def evaluate(t: pa.Table):
            """Batch, words' counts, log10 of the unigram, then of the last whole level; grams of an unfinished level."""
            number, bucket, a = (t.column(c).to_pylist() for c in ("round", "bucket", "a"))
            own = number.index(-1)
            x = Batch.read(a[own], *(t.column(c)[own].as_py() for c in ("sizes", "words", "places")))
            got: dict[int, list] = {}
            for k, b, v in zip(number, bucket, a, strict=True):
                got.setdefault(k, []).append((b, v))
            count = _replies(got[0], x.words, n, "<i8")
            base = p = np.log10((count[x.at] + 0.5) / mass)
            level, left = 2, None
            for k in range(1, rounds, 2):
                d = discount[level - 2]
                context, key = x.grams(level)
                contexts, h = distinct(context)
                keys, at = distinct(key)
                del context, key
                v = _replies(got.pop(k), keys, n, "<u4")
                c = (v >> 1)[at]
                share = np.where(c <= MOST, d[np.minimum(c, MOST)], 1.0) * c
                if k + 1 == rounds:
                    # the first token of each key that the batch owns
                    owns = np.unique(at, return_index=True)[1][(v & 1).astype(bool) & (v > 1)]
                    left = contexts, h, c, owns, share
                    break
                del keys, at, v
                r = _replies(got.pop(k + 1), contexts, n, "<f8", 2)
                alpha, total = np.abs(r[:, 0]), r[:, 1] + np.signbit(r[:, 0])
                with np.errstate(divide="ignore", invalid="ignore"):
                    back = np.where(total > 0, np.log10(alpha), 0.0)[h] + p
                    p = np.where(c > 0, np.log10(share / total[h]), back)
                level += 1
            return x, count, base, p, left

        return self.spread(out, "batch", self.count), evaluate

    def contexts(self, level: int) -> None:
        n, (groups, evaluate) = self.n, self.met()

        def ask(t: pa.Table) -> pa.Table:
            x, _, _, p, (keys, h, c, owns, share) = evaluate(t)
            need = np.zeros(len(keys))
            need[h[c == 0]] = 1
            sums = [np.bincount(h[owns], v, len(keys)) for v in (share[owns], 10.0 ** p[owns], c[owns])]
            return pa.Table.from_batches([_asks(t.column("batch")[0].as_py(), keys, np.stack([*sums, need], 1), n)])

        def answer(t: pa.Table) -> pa.Table:
            names, keys, asked, _, at, cuts = _gather(t, "<f8", 4)
            seen, lower, total = (np.bincount(at, asked[:, i], len(keys)) for i in range(3))
            whole = (total > 0) & (seen >= total * (1 - 1e-12))
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = np.where(total > 0, (1 - seen / (total + whole)) / (1 - lower), 1.0)
            told = np.copysign(np.where(asked[:, 3] > 0, alpha[at], 0.0), np.where(whole, -1.0, 1.0)[at])
            real = total > 0
            table_ = np.stack([alpha, total + whole], 1)[real]
            return _answers(t.column("bucket")[0].as_py(), np.zeros(0, "<i8"), keys[real], table_, names, np.split(np.stack([told, total[at]], 1), cuts))

        self.answered(groups.applyInArrow(ask, ASK), answer, f"contexts-{level}")

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        groups, evaluate = self.met()
        total = self.tokens

        def run(t: pa.Table) -> pa.Table:
            x, count, base, p, _ = evaluate(t)
            add = lambda v: np.add.reduceat(v, x.first)
            return pa.table([
                x.ids, pa.array(x.held), pa.array(x.size), pa.array(add((count[x.at] > 0).astype(np.int64))), pa.array(np.full(len(x.size), total)),
                pa.array(add(base)), pa.array(add(p)),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return groups.applyInArrow(run, schema)


def each(stream):
    """(name, Batch) of BATCHED rows."""
    for b in stream:
        for i in range(b.num_rows):
            name, *rest = (b.column(c)[i].as_py() for c in ("batch", "ids", "sizes", "words", "places"))
            yield name, Batch.read(*rest)


def op7(spark, sf_dir: str) -> DataFrame:
    return Katz(table(spark, sf_dir, "documents"), Stash(spark)).scores()

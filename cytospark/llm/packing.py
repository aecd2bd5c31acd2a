"""Best-fit packing of tokenised documents into sequences, improved by swaps.

A document's ids are its text's tokens and one end id. Documents longer than a sequence are cut into whole-sequence
pieces after a shorter first one. Which pieces share a sequence depends on lengths alone, so only the histogram of
lengths (at most ``room`` rows) comes to the driver: best-fit decreasing over it opens kinds of sequences with
multiplicities, and local search moves pieces between underfull kinds, one for one, two for one, or without return,
whenever that raises the sum of squared fills, until sequences empty. Pieces then take their places by rank among pieces of
their length; ranks are counted in small cells, so one common length does not meet in one task.

Null texts count as empty (one end id). A null doc_id is as any other. Repeated rows, and rows of one id with other texts,
are packed each for itself: pieces are numbered, so that equal ones are no hot key. Of pieces of one length any may take any
place. An empty table gives an empty result. Extra columns are not read. A text of any length is tokenised whole, in pieces
cut at single spaces, where token boundaries always are; one that holds an added token of the vocabulary (such as
``<|endoftext|>``) is handed to the tokenizer itself.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, table

ROOM = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A single space between two non-spaces always starts a token of a byte-level vocabulary's pattern.
CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}


class Ids:
    """Little-endian ids of texts, by the tokenizer's model on each part its pattern finds.

    Words after a space, and parts, are remembered, up to ``most`` of each; what is not remembered is tokenised anew.
    """

    def __init__(self, path: str, most: int = 600_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        added = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        #: Texts that hold an added token go to the tokenizer as they are.
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.letters = byte_letters()
        self.most = most
        self.parts: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}

    def part(self, x: str) -> bytes:
        got = self.parts.get(x)
        if got is None:
            got = _bytes([t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(self.letters))])
            if len(x) <= 64 and len(self.parts) < self.most:
                self.parts[x] = got
        return got

    def chunk(self, x: str) -> bytes:
        return b"".join(map(self.part, self.pattern.findall(x)))

    def text(self, t: str) -> bytes:
        if self.added and self.added.search(t):
            return _bytes(self.whole.encode(t, add_special_tokens=False).ids)
        words = t.split(" ")
        got = list(map(self.after.get, words))
        got[0] = self.chunk(words[0])
        if None in got or words[0] != words[0].rstrip():
            for i, g in enumerate(got):
                if g is None or i == 0:
                    w = words[i]
                    if not w or w[-1].isspace() or i and w[0].isspace():
                        return b"".join(map(self.chunk, CUT.split(t)))
                    if g is None:
                        got[i] = g = self.chunk(" " + w)
                        if len(w) <= 64 and len(self.after) < self.most:
                            self.after[w] = g
        return b"".join(got)


def _bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


_IDS: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def encoded(texts: list[str | None], path: str):
    """Little-endian ids of each text and the end id."""
    ids, end = _ids(path), END_ID.to_bytes(4, "little")
    for t in texts:
        yield ids.text(t) + end if t else end


def pieces(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    def run(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for doc, data in zip(b.column(0).to_pylist(), encoded(b.column(1).to_pylist(), path), strict=True):
                n = len(data) // 4
                first = (n - 1) % room + 1
                at = [0, *range(first, n, room)]
                for p, (s, e) in enumerate(zip(at, [*at[1:], n], strict=True)):
                    for column, v in zip(out, (doc, p, s, e - s, zlib.crc32(data[4 * s : 4 * e])), strict=True):
                        column.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], room: int = ROOM) -> dict[tuple[int, ...], int]:
    """Kinds of sequences (lengths, descending) and how many of each; every piece goes to the fullest that it fits."""
    done: dict[tuple[int, ...], int] = {}
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    gaps: list[int] = []

    def add(kind: tuple[int, ...], n: int) -> None:
        gap = room - sum(kind)
        if gap < smallest:
            done[kind] = done.get(kind, 0) + n
            return
        if gap not in open_:
            insort(gaps, gap)
            open_[gap] = {}
        open_[gap][kind] = open_[gap].get(kind, 0) + n

    smallest = min(counts, default=room)
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                each = room // size
                if n >= each:
                    add((size,) * each, n // each)
                if n % each:
                    add((size,) * (n % each), 1)
                break
            gap = gaps[i]
            kind, m = next(iter(open_[gap].items()))
            k = min(n, m)
            del open_[gap][kind]
            if m > k:
                open_[gap][kind] = m - k
            if not open_[gap]:
                del open_[gap], gaps[i]
            add((*kind, size), k)
            n -= k
    for kinds in open_.values():
        for kind, n in kinds.items():
            done[kind] = done.get(kind, 0) + n
    return done


def improve(kinds: dict[tuple[int, ...], int], room: int = ROOM, rounds: int = 4000, width: int = 64) -> dict[tuple[int, ...], int]:
    """Local search between the emptiest kind and other underfull ones, whole multiplicities at a time.

    Each step raises the sum of squared fills, so it ends; ``rounds`` and ``width`` (partners looked at) bound the
    driver's work whatever the input.
    """
    kinds = dict(kinds)
    least = -(-sum(sum(k) * n for k, n in kinds.items()) // room)

    def change(a, b, give, take):
        """a takes `give` from b and returns `take`, in as many pairs as there are."""
        n = min(kinds[a], kinds[b]) if a != b else kinds[a] // 2
        for kind, minus, plus in ((a, take, give), (b, give, take)):
            kinds[kind] -= n
            if not kinds[kind]:
                del kinds[kind]
            new = list(kind)
            for x in minus:
                new.remove(x)
            if new := tuple(sorted((*new, *plus), reverse=True)):
                kinds[new] = kinds.get(new, 0) + n

    def step(b) -> bool:
        under = sorted((k for k in kinds if sum(k) < room and (k != b or kinds[k] > 1)), key=lambda k: (-sum(k), k))
        for a in under[:width] + under[-width:]:
            gap = room - sum(a)
            if sum(a) < sum(b):
                continue
            best = (0, None)
            singles, mine = sorted(set(b)), sorted(set(a))
            takes = [()] + [(x,) for x in mine] + [(x, y) for i, x in enumerate(mine) for y in mine[i:] if x != y or a.count(x) > 1][:500]
            gives = [(x,) for x in singles] + [(x, y) for i, x in enumerate(singles) for y in singles[i:] if x != y or b.count(x) > 1][:500]
            for give in gives:
                for take in takes:
                    if len(give) + len(take) <= 3 and best[0] < (d := sum(give) - sum(take)) <= gap:
                        best = (d, (give, take))
            if best[1]:
                change(a, b, *best[1])
                return True
        return False

    for _ in range(rounds):
        if sum(kinds.values()) <= least:
            break
        low = sorted((k for k in kinds if sum(k) < room), key=lambda k: (sum(k), k))[:8]
        if not any(step(b) for b in low):
            break
    return kinds


def places(kinds: dict[tuple[int, ...], int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset in it) for the pieces of each length."""
    out, used, base = [], {}, 0
    for kind, n in sorted(kinds.items(), reverse=True):
        at = 0
        for size in kind:
            lo = used.get(size, 0)
            out.append((size, lo, lo + n, base, at))
            used[size] = lo + n
            at += size
        base += n
    return out


def pack(docs: DataFrame, stash: Stash, path: str, room: int = ROOM, cell_rows: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    p = stash(pieces(docs, path, room).withColumn("piece_no", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = spark.createDataFrame(places(improve(best_fit(counts, room), room)), "len_ long, lo long, hi long, first long, offset long")
    # so many cells a length that each has about cell_rows pieces
    cells = F.create_map(*(F.lit(x) for n, k in counts.items() for x in (n, -(-k // cell_rows))))[F.col("length")] if counts else F.lit(1)
    p = p.withColumn("cell", F.pmod(F.xxhash64("piece_no"), cells))
    sizes = p.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before")
    own = F.row_number().over(Window.partitionBy("length", "cell").orderBy("piece_no")) - 1
    ranked = p.withColumn("own", own).join(sizes.select("length", "cell", before), ["length", "cell"]).withColumn("rank", F.col("own") + F.col("before"))
    # ranges has a row for each place in a kind of sequence: bounded by room and the search, not by the rows
    out = ranked.alias("x").join(F.broadcast(ranges).alias("y"), F.expr("length = len_ and rank >= lo and rank < hi"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("first + rank - lo").alias("sequence_id"), "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Stash(spark), vocabulary())


def sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every document and their places."""
    return pack(docs, Stash(spark), vocabulary())

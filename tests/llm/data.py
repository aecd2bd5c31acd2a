"""Small corpora with awkward rows, and brute-force versions of the operators."""

import collections
import itertools
import random
import re

COLUMNS = ("row", "n", "key", "id", "a", "b", "c", "h", "cell", "size", "rank", "target", "threshold", "passes", "gone", "batch", "words", "stats", "kept", "part", "number", "piece_no", "place")


def documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text, source): copies, near copies, shared passages, runs, nulls, blanks, one long text, repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "ÜBER", "x<|y|>"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts: list[str | None] = [prose(rng.randint(1, 150)) for _ in range(40)]
    base, passage = prose(120), prose(60)
    for k in range(12):
        w = base.split()
        for j in range(k // 3):
            w[10 + 17 * j] = f"edit{k}{j}"
        texts.append(" ".join(w))
    texts += [f"{prose(30)}\n{passage}\n{prose(25)}" for _ in range(6)] + [base] * 5 + [prose(6000)]
    texts += ["same " * 200, "x " + "same " * 120, "a b " * 90, None, None, "", " \t\n ", "one", "one two three four", "one two three four", "A B C D E", "a b c d e"]
    texts += ["\n".join(["line of text here"] * 9 + [prose(60)]), prose(34), prose(35)]
    rows = [(i, t, None if i % 13 == 5 else f"src{i % 4 if i % 3 else 0}") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[40]]


def frame(spark, rows, extra: bool = True):
    """The rows as a table with extra columns whose names operators use inside."""
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, source string, n_chars long")
    return df.selectExpr("*", *(f"'{c}' as `{c}`" for c in COLUMNS)) if extra else df


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(w: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = [lower(x) for x in split(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_groups(rows):
    """{doc_id: (set size, component)}."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    g = Groups()
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            g.join(a, b)
    return {d: (len(s), g.find(d)) for d, s in sets.items()}


def removed(rows, width: int = 35):
    """Kept and all words of each row."""
    words = [split(r[1]) for r in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append(([x for i, x in enumerate(w) if i not in gone], w))
    return out

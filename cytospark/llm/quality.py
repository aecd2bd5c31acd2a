"""Quality rules: statistics of texts, and decision lists learned from labelled ones (DataFrame functions only).

Sequential covering: a rule (a conjunction of thresholds on statistics) is grown literal by literal on two thirds of
the labelled rows by FOIL's information gain, pruned back from its last literal on the other third, and accepted if
enough of what it covers there is bad; the rows it covers leave, and the next rule is grown. The list is emitted as an
ordered chain of ``CASE WHEN``. Learning reads at most ``sample`` labelled documents (20,000: those of least md5 of the id)
and stops at ``max_rules`` rules (8) of ``max_literals`` literals (4) that each cover ``least`` held-back bad rows (5);
the statistics and the verdicts cover every row and every whole text. Of literals with equal gain the first feature's and
least threshold's wins; a bad row is one of quality 0.

Null text counts as empty; empty tables give an empty result; labels without a document, null or repeated are ignored
(repeated ones by their smallest value). A null doc_id is as any other, without a label. Repeated rows, and rows of one id
with other texts, are judged each for itself. Texts of any length are read whole. Extra columns are not read; ``keep``
passes them on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, Stash, let, table, words

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share")


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more; each text in O(n log n), without quadratic lookups."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def hits(s: Column) -> Column:
            same = lambda j: s[j]["h"] == s[j + 1]["h"]
            last = F.size(s) - 1
            found = F.filter(s, lambda x, j: F.when(j > 0, same(j - 1)).otherwise(False) | F.when(j < last, same(j)).otherwise(False))
            return F.array_sort(F.transform(found, lambda x: x["i"]))

        def cover(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.when(j + 1 < F.size(p), F.least(F.lit(3), p[j + 1] - x)).otherwise(3))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        dup = let(let(pairs, hits), cover)
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(dup)

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(grams, covered))


def statistics(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """The columns keep (doc_id by default) and the base statistics of every whole text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    sizes = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))
    dups = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    df = docs.select(
        *(keep or ("doc_id",)),
        F.length(F.regexp_replace(t, WS + "+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(words(t), sizes).alias("w_"),
        let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), dups).alias("l_"),
    )
    return df.select("*", "w_.*", "l_.*").drop("w_", "l_")


def with_features(stats: DataFrame) -> DataFrame:
    share = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return stats.withColumns({
        "mean_chars": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def _covers(rule: list[tuple], x: dict) -> bool:
    return all(x[f] >= v if op == ">=" else x[f] <= v for f, op, v in rule)


def _grow(rows: list[dict], max_literals: int) -> list[tuple]:
    """Add the literal of most FOIL gain until only bad rows are covered or nothing gains."""
    rule, at = [], rows
    while len(rule) < max_literals:
        p0, n0 = sum(x["bad"] for x in at), sum(not x["bad"] for x in at)
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in FEATURES:
            ordered = sorted(at, key=lambda x: x[f])
            p = n = 0
            for i, x in enumerate(ordered):
                p, n = p + x["bad"], n + (not x["bad"])
                if i + 1 < len(ordered) and ordered[i + 1][f] != x[f]:
                    for pp, nn, lit in ((p, n, (f, "<=", x[f])), (p0 - p, n0 - n, (f, ">=", ordered[i + 1][f]))):
                        if pp:
                            gain = pp * (math.log2(pp / (pp + nn)) - base)
                            if gain > best[0]:
                                best = (gain, lit)
        if best[1] is None:
            break
        rule.append(best[1])
        at = [x for x in at if _covers([best[1]], x)]
    return rule


def _prune(rule: list[tuple], rows: list[dict]) -> list[tuple]:
    """The prefix of most (bad - good) / covered on held-back rows."""
    def worth(r):
        c = [x["bad"] for x in rows if _covers(r, x)]
        return (2 * sum(c) - len(c)) / len(c) if c else -1
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])


def learn(rows: list[dict], precision: float = 0.9, max_rules: int = 8, max_literals: int = 4, least: int = 5) -> list[tuple[list[tuple], str]]:
    """Ordered rules [(literals, "reject")] from labelled statistics (dicts with FEATURES and bad)."""
    grow, prune, rules = [x for i, x in enumerate(rows) if i % 3], rows[::3], []
    while len(rules) < max_rules:
        rule = _prune(_grow(grow, max_literals), prune)
        hit = [x["bad"] for x in prune + grow if _covers(rule, x)]
        held = [x["bad"] for x in prune if _covers(rule, x)]
        if not rule or sum(held) < least or sum(held) < precision * len(held) or sum(hit) < precision * len(hit):
            break
        rules.append((rule, "reject"))
        grow, prune = ([x for x in part if not _covers(rule, x)] for part in (grow, prune))
    return rules


def as_column(rules: list[tuple[list[tuple], str]], default: str = "keep") -> Column:
    """The decision list as one ordered CASE WHEN."""
    out = None
    for rule, verdict in rules:
        cond = F.lit(True)
        for f, op, v in rule:
            cond = cond & (F.col(f) >= F.lit(v) if op == ">=" else F.col(f) <= F.lit(v))
        out = F.when(cond, verdict) if out is None else out.when(cond, verdict)
    return F.lit(default) if out is None else out.otherwise(default)


def chosen(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, quality of at most sample labelled documents: those of least md5 of the id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)


def labelled(features: DataFrame, known: DataFrame, sample: int) -> list[dict]:
    """The rows of the chosen documents that pass the base rules; of repeated ids at most sample in all."""
    got = features.where(~F.col("base_failed")).join(known, "doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", *FEATURES).limit(sample)
    return [x.asDict() | {"bad": x["quality"] == 0} for x in got.select("doc_id", "quality", *FEATURES).collect()]


def judge(docs: DataFrame, labels: DataFrame, stash: Stash, sample: int = 20_000, precision: float = 0.9) -> DataFrame:
    """Statistics, base_failed, the rule list's verdict and kept of every document."""
    stats = stash(statistics(docs), "stats")
    full = with_features(stats)
    rules = learn(labelled(full, stash(chosen(docs, labels, sample), "chosen"), sample), precision)
    return full.withColumn("verdict", as_column(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("verdict") == "keep"))


def op6(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Stash(spark))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that the rules keep, with their own columns of any names.

    Rules are learned from the statistics of the chosen documents alone (at most 20,000 of them); then rows are filtered
    by the decision list over their own statistics, in the same scan: no join back to the texts.
    """
    stash = Stash(spark)
    cols = docs.columns
    known = stash(chosen(docs, table(spark, sf_dir, "labels"), 20_000), "chosen")
    seen = stash(with_features(statistics(docs.select("doc_id", "text").join(known, "doc_id", "left_semi"))), "stats")
    rules = learn(labelled(seen, known, 20_000))
    judged = with_features(statistics(docs, F.struct(*cols).alias("row")))
    return judged.where(~F.col("base_failed") & (as_column(rules) == "keep")).select("row.*")

"""Learned decision lists over text statistics, with DataFrame operations only.

Every statistic of a text comes from built-in functions over its own row; nothing
is shuffled.  Sequential covering learns the list from labelled rows: a rule
starts empty and grows by the threshold condition of greatest information gain on
two thirds of the rows, is pruned from its end on the other third, and is kept
while it is precise on both; the rows it covers are set aside and the next rule
is learned.  The list becomes one ordered conditional expression.

Learning uses at most LABELLED rows, those of least hash; the list is then
applied to all documents.  Rows without quality teach nothing.  Without labels
the list is empty and only the base rules reject.

Words are `[^\\x20\\x09-\\x0D]+`; null and empty texts have none, and are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, unused

#: At most so many labelled rows are learned from.
LABELLED = 20_000
THRESHOLDS = 48
MAX_CONDITIONS = 4
MAX_RULES = 16
LEAST_COVERED = 4
PRECISION = 0.9
WINDOW = 5

_BLANK = " \t\n\x0b\f\r"
_BLANKS = r"[\x20\x09-\x0D]+"


def _bound(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _count(text: Column, others: str) -> Column:
    """How many characters are left without those of the class others; they go in whole runs, much faster than one by one."""
    return F.length(F.regexp_replace(text, others + "+", "")).cast("long")


def repeat_words(words: Column, k: int = WINDOW) -> Column:
    """How many words lie in windows of k words that are found twice or more in the array (words, or their hashes)."""

    def places(s: Column) -> Column:
        n = F.size(s)

        def twice(i: Column) -> Column:
            h = F.get(s, i)["h"]
            return F.coalesce(F.get(s, i - 1)["h"] == h, F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == h, F.lit(False))

        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), twice), lambda i: F.get(s, i)["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(k), lambda n, i: n + F.least(F.lit(k), F.get(p, i) - F.get(p, i - 1)))

    def of(h: Column) -> Column:
        numbered = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(_bound(F.sort_array(numbered), places), covered))

    return F.when(F.size(words) <= k, F.lit(0)).otherwise(
        _bound(F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))), of)
    )


#: What statistics adds; columns of these names are replaced.
STATISTICS = ("n_words", "n_repeat_words", "n_distinct", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_upper", "n_cries", "n_stops", "n_digits")


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and the statistics of text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, _BLANKS, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    row = F.struct(
        _bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeat_words(h).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct"))).alias("w"),
        _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("x"),
        F.length(F.regexp_replace(text, _BLANKS, "")).cast("long").alias("word_chars"),
        _count(text, "[^#*$%&|<>]").alias("n_symbols"),
        _count(text, "[^A-Z]").alias("n_upper"),
        _count(text, "[^!?]").alias("n_cries"),
        _count(text, "[^.,;:]").alias("n_stops"),
        _count(text, "[^0-9]").alias("n_digits"),
    )
    rest = [c for c in docs.columns if c != "text" and c.lower() not in STATISTICS]
    one = unused(rest, "row")
    # a generator keeps the statistics from being computed again wherever they are used
    flat = docs.select(*rest, F.explode(F.array(row)).alias(one))
    names = STATISTICS[5:]
    return flat.select(*rest, *(F.col(f"{one}.w.{n}") for n in STATISTICS[:3]), *(F.col(f"{one}.x.{n}") for n in STATISTICS[3:5]), *(F.col(f"{one}.{n}") for n in names))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "word_chars"),
        "upper": _share("n_upper", "word_chars"),
        "cries": _share("n_cries", "n_words"),
        "stops": _share("n_stops", "n_words"),
        "digits": _share("n_digits", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeated": _share("n_repeat_words", "n_words"),
        "distinct": _share("n_distinct", "n_words"),
        "line_words": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def expression(self) -> Column:
        f = features()[self.feature]
        return f > F.lit(self.threshold) if self.above else f <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    rule: Rule = ()
    hit = live.copy()
    while len(rule) < MAX_CONDITIONS and hit.any() and bad[hit].mean() < 1:
        p, n = bad[hit].sum(), hit.sum()
        best, gain = None, 1e-9
        for name in sorted(x):
            values, is_bad = x[name][hit], bad[hit]
            order = np.argsort(values, kind="stable")
            total = np.concatenate([[0], np.cumsum(is_bad[order])])
            k = np.searchsorted(values[order], cuts[name], "right")
            for above, pos, all_ in ((False, total[k], k), (True, p - total[k], n - k)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where((pos > 0) & (all_ >= LEAST_COVERED), pos * (np.log2(pos / all_) - np.log2(p / n)), 0.0)
                i = int(np.argmax(g)) if len(g) else 0
                if len(g) and g[i] > gain:
                    best, gain = Condition(name, above, float(cuts[name][i])), float(g[i])
        if best is None:
            break
        rule = (*rule, best)
        hit &= best.holds(x)
    return rule


def learned_list(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Rules for bad rows, most reliable first as they are found; fold 2 of 0..2 prunes."""
    n = len(bad)
    grow, prune = fold != 2, fold == 2
    cuts = {}
    for k, v in x.items():
        q = np.unique(np.quantile(v, np.linspace(0, 1, THRESHOLDS + 1))) if n else np.zeros(0)
        some = np.unique(v)
        # between two values, so that equality plays no part
        after = np.searchsorted(some, q, "right")
        cuts[k] = np.unique((some[np.maximum(after - 1, 0)] + some[np.minimum(after, len(some) - 1)]) / 2) if n else q
    rules: list[Rule] = []
    left = np.ones(n, bool)
    while len(rules) < MAX_RULES and (bad & left & grow).any():
        rule = _grown(x, bad, left & grow, cuts)
        if not rule:
            break

        def worth(r: Rule, left=left) -> float:
            hit = _covers(r, x, n) & left & prune
            p = int(bad[hit].sum())
            return (2 * p - int(hit.sum())) / max(1, int(hit.sum()))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x, n) & left
        held, seen = hit & prune, hit & grow
        if seen.sum() < LEAST_COVERED or bad[seen].mean() < PRECISION or (held.any() and bad[held].mean() < PRECISION):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> list[Rule]:
    """The decision list for quality = 0, from at most limit labelled documents."""
    some = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    got = rows.select("quality", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).alias("fold"), *(c.alias(k) for k, c in features().items()), "doc_id").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"]))  # ordered here: a range partition would compute the statistics twice
    x = {k: np.array([r[k] for r in got], float) for k in features()}
    return learned_list(x, np.array([r["quality"] == 0 for r in got], bool), np.array([r["fold"] for r in got], np.int64))


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects; rules are tried in order."""
    out = F.when(F.col("n_words").isNull(), F.lit(False))
    for rule in rules:
        every = rule[0].expression()
        for c in rule[1:]:
            every = every & c.expression()
        out = out.when(every, F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics of docs with base_failed and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

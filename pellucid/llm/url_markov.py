"""URL filtering by the ratio of two character language models.

Rules on host and path decide what they fit.  The rest is judged by two smoothed
variable-order Markov models, one of accepted and one of rejected URLs: a
character's probability is that after the longest context seen in training,
interpolated with all shorter ones (Witten-Bell).  The verdict compares the
log-likelihood difference for each character with a threshold that is calibrated
on URLs kept back from training.

The models learn from every distinct rule-judged URL that isn't kept back (a fifth, by hash), and the threshold
from every one that is; Spark counts the continuations of contexts.  Up to ENTRIES of them (counted) are
sent to all tasks, 110 MB at most.  Beyond that nothing is broadcast but the counts of contexts of at
most one character and 1,000 frequent differences: the distinct runs of ORDER + 1 characters are joined with the
counts, and URLs with what their runs gave.  Differences are summed up as whole numbers, so both ways and
any number of tasks give the same verdicts.

A null URL, or one without `://`, has empty host and path, fits no rule and is
judged by the models like any text.  If a class has no URLs, all are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from . import flat
from .common import cut, parts, ship, table, unused

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 5
ALPHABET = 257
#: Continuations up to which models are sent to all tasks; bytes of URLs that are taken apart at a time; rows of a sorted range.
ENTRIES, STEP, RANGE = 3_000_000, 1 << 18, 50_000
#: Whole numbers that stand for 1 in sums of log-likelihoods; a run is frequent if it makes up one in so many.
UNIT, SHARE = 1 << 32, 1_000
#: If learn() is asked for a sample, so many characters of it at most, and URLs of so many.
SAMPLE_CHARS, MOST_CHARS = 600_000, 4_096


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct (verdict, rule), or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For k = 0..ORDER hashes of the k characters before each character and of it with them, over all texts; characters; owners.

    A text is its bytes and an end; contexts reach back to ORDER starts.
    """
    data, at = flat.buffers(pa.array(texts, pa.string()))
    n = len(texts)
    bounds = at + (ORDER + 1) * np.arange(n + 1)
    x = np.full(int(bounds[-1]), 300, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    x[np.arange(len(data)) + (ORDER + 1) * owner + ORDER] = data
    if n:
        x[bounds[1:] - 1] = 301
    place = np.flatnonzero(x != 300)
    context = [np.full(len(place), 7, flat.U64)]
    for k in range(1, ORDER + 1):
        context.append(flat.mix(context[-1] * flat.U64(1099511628211) + x[place - k] + flat.U64(1)))
    return context, x[place], np.repeat(np.arange(n), np.diff(at) + 1)


def _joint(context: np.ndarray, character: np.ndarray) -> np.ndarray:
    return flat.mix(context ^ flat.mix(character + flat.U64(77)))


def _blended(seen: list[np.ndarray], kinds: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Log-probabilities from what is known of the contexts of 0..ORDER characters, and of the character after them."""
    p = np.full(len(seen[0]) if seen else 0, 1.0 / ALPHABET)
    for n, t, c in zip(seen, kinds, counts, strict=True):
        p = np.where(n > 0, (c + t * p) / np.maximum(n + t, 1), p)
    return np.log(p)


def _whole(allow: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Differences of log-likelihoods as whole numbers, whose sums have no order."""
    return np.rint((allow - block) * UNIT).astype(np.int64)


@dataclass
class Markov:
    """Counts by hash, sorted: contexts with (occurrences, kinds of followers), and contexts with a character."""

    contexts: np.ndarray
    seen: np.ndarray
    kinds: np.ndarray
    joints: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(joints: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> Markov:
        """From distinct joints, sorted, their contexts and counts."""
        contexts, place = np.unique(owner, return_inverse=True)
        return Markov(contexts, np.bincount(place, counts, minlength=len(contexts)), np.bincount(place, minlength=len(contexts)).astype(np.float32), joints, counts.astype(float))

    @staticmethod
    def learned(texts: list[str]) -> Markov:
        context, character, _ = _grams(texts)
        every = np.concatenate(context)
        joints, first, counts = np.unique(np.concatenate([_joint(c, character) for c in context]), return_index=True, return_counts=True)
        return Markov.of(joints, every[first], counts)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(x))
        k = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[k] == x, values[k].astype(float), 0.0)

    def log_likelihood(self, context: list[np.ndarray], character: np.ndarray) -> np.ndarray:
        look = lambda values, of=lambda c: c, keys=self.contexts: [self._look(keys, values, of(c)) for c in context]
        return _blended(look(self.seen), look(self.kinds), look(self.counts, lambda c: _joint(c, character), self.joints))


@dataclass
class Judge:
    allow: Markov | None
    block: Markov | None
    threshold: float = 0.0

    def ratio(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood difference for each character, the end included."""
        if self.allow is None or self.block is None:
            return np.full(len(texts), np.inf)
        context, character, owner = _grams(texts)
        d = _whole(self.allow.log_likelihood(context, character), self.block.log_likelihood(context, character))
        first = np.flatnonzero(np.diff(owner, prepend=-1))  # a text has its end at least
        return np.add.reduceat(d, first) / (np.bincount(owner, minlength=len(texts)) * float(UNIT)) if len(d) else np.zeros(0)


def calibrated(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold of greatest balanced accuracy: good at or above, bad below; the middle of the best stretch."""
    if not len(good) or not len(bad):
        return 0.0
    cuts = np.unique(np.concatenate([good, bad]))
    right = 1 - np.searchsorted(np.sort(good), cuts, "left") / len(good) + np.searchsorted(np.sort(bad), cuts, "left") / len(bad)
    best = np.flatnonzero(right == right.max())
    k = best[len(best) // 2]
    return float((cuts[k] + cuts[k - 1]) / 2) if k else float(cuts[0])


def _sampled(urls: DataFrame, sample: int) -> Judge:
    """A judge of at most sample distinct URLs of each class, those of least hash."""
    sides = {}
    for label in ("allow", "block"):
        some = urls.where((F.col("label") == label) & (F.length("url") <= MOST_CHARS)).select("url").distinct()
        texts = [r["url"] for r in some.orderBy(F.xxhash64("url"), "url").limit(sample).collect()]
        texts = texts[: int(np.searchsorted(np.cumsum([len(t.encode()) + 1 for t in texts]), SAMPLE_CHARS, "right"))]
        # the order is by hash, so every fifth is a random fifth
        sides[label] = ([t for i, t in enumerate(texts) if i % 5], texts[::5])
    if not sides["allow"][0] or not sides["block"][0]:
        return Judge(None, None)
    judge = Judge(Markov.learned(sides["allow"][0]), Markov.learned(sides["block"][0]))
    judge.threshold = calibrated(judge.ratio(sides["allow"][1]), judge.ratio(sides["block"][1]))
    return judge


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [u or "" for u in batch.column(batch.schema.get_field_index("url")).to_pylist()]


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (url, allow): the continuations (allow, k, joint, context, n) of contexts of k characters, a row for each in a step."""
    for batch in flat.steps(batches, "url", STEP):
        context, character, owner = _grams(_texts(batch))
        side = batch.column(batch.schema.get_field_index("allow")).to_numpy(zero_copy_only=False)[owner]
        for allow in (True, False):
            for k, c in enumerate(context):
                own = c[side == allow]
                joints, first, counts = np.unique(_joint(own, character[side == allow]), return_index=True, return_counts=True)
                n = len(joints)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, allow)), pa.array(np.full(n, k, np.int32)), _signed(joints), _signed(own[first]), pa.array(counts.astype(np.int64))], ["allow", "k", "joint", "context", "n"])


def _judge(counts: DataFrame) -> Judge:
    """The models of few continuations, on the driver."""
    t = counts.select("allow", "joint", "context", "n").toArrow()
    allow, joint, context, n = (t.column(k).to_numpy() for k in range(4))
    sides = []
    for which in (True, False):
        own = np.flatnonzero(allow == which)
        own = own[np.argsort(joint[own].view(np.uint64))]
        sides.append(Markov.of(joint[own].view(np.uint64), context[own].view(np.uint64), n[own]))
    return Judge(*sides)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (u, url): (u, g, n, contexts, joints): how often a run of ORDER + 1 characters, named g, is in a URL; its contexts are told once in a step."""
    for batch in flat.steps(batches, "url", STEP):
        context, character, owner = _grams(_texts(batch))
        joint = [_joint(c, character) for c in context]
        g, u = joint[ORDER], batch.column(batch.schema.get_field_index("u")).to_numpy()[owner]
        order = np.lexsort((g, owner))
        start = np.flatnonzero((np.diff(owner[order], prepend=-1) != 0) | np.concatenate([[True], g[order][1:] != g[order][:-1]]))
        n, at = np.diff(np.append(start, len(order))), order[start]
        told = np.zeros(len(at), bool)
        told[np.unique(g[at], return_index=True)[1]] = True
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(told * (ORDER + 1))]).astype(np.int32)), _signed(np.stack([v[at[told]] for v in x], 1).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(u[at]), _signed(g[at]), pa.array(n.astype(np.int64)), lists(context), lists(joint)], ["u", "g", "n", "contexts", "joints"])


_KNOWN = ("sa", "ka", "na", "sb", "kb", "nb")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (g, known): the difference (g, d) of the two models' log-likelihoods."""
    for batch in batches:
        lists = batch.column(1).flatten()
        of = {c: list(lists.field(c).to_numpy().astype(float).reshape(-1, ORDER + 1).T) for c in _KNOWN}
        d = _whole(_blended(of["sa"], of["ka"], of["na"]), _blended(of["sb"], of["kb"], of["nb"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d)], ["g", "d"])


def _ratios(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(url, ratio) of distinct URLs by joins with the counts: Judge.ratio where models are too large to be sent."""
    urls = cut(urls.select("url").distinct().withColumn("u", F.monotonically_increasing_id()))
    runs = cut(urls.select("u", "url").mapInArrow(_runs, "u long, g long, n long, contexts array<long>, joints array<long>"))
    of = lambda allow, x: F.sum(F.when(F.col("allow") == allow, x).otherwise(0))
    contexts = counts.groupBy("k", "context").agg(of(True, F.col("n")).alias("sa"), of(True, F.lit(1)).alias("ka"), of(False, F.col("n")).alias("sb"), of(False, F.lit(1)).alias("kb"))
    joints = counts.groupBy("k", "joint").agg(of(True, F.col("n")).alias("na"), of(False, F.col("n")).alias("nb"))
    each = runs.where(F.size("contexts") > 0).dropDuplicates(["g"]).select("g", F.posexplode(F.arrays_zip("contexts", "joints")).alias("k", "x")).select("g", "k", "x.contexts", "x.joints").withColumnsRenamed({"contexts": "context", "joints": "joint"})

    def known(rows: DataFrame, few: bool) -> DataFrame:
        # contexts of at most one character are few, and every run has them
        side = lambda df: F.broadcast(df.where("k <= 1")) if few else df.where("k > 1")
        return rows.where("k <= 1" if few else "k > 1").join(side(contexts), ["k", "context"], "left").join(side(joints), ["k", "joint"], "left")

    facts = known(each, True).unionByName(known(each, False)).na.fill(0, list(_KNOWN))
    known_of = facts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", *_KNOWN))).alias("known"))
    found = cut(known_of.mapInArrow(_differences, "g long, d long"))
    total = runs.agg(F.sum("n")).first()[0] or 0
    often = cut(runs.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") * SHARE > total).select("g").join(found, "g"))  # under SHARE rows
    each = runs.join(F.broadcast(often), "g").unionByName(runs.join(F.broadcast(often.select("g")), "g", "left_anti").join(found, "g"))
    sums = each.groupBy("u").agg(F.sum(F.col("n") * F.col("d")).alias("d"), F.sum("n").alias("n"))
    return urls.join(sums, "u").select("url", (F.col("d").cast("double") / (F.col("n").cast("double") * F.lit(float(UNIT)))).alias("ratio"))


def _calibrated(held: DataFrame) -> float:
    """calibrated() of rows (allow, ratio): ranges of ratios are summed up each by itself and start where the one before ends."""
    values = cut(held.groupBy("ratio").agg(F.count_if("allow").alias("good"), F.count_if(~F.col("allow")).alias("bad")))
    n, good, bad = values.agg(F.count(F.lit(1)), F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return 0.0
    ranges = max(1, min(parts(held.sparkSession), -(-n // RANGE)))
    values = cut((values.repartitionByRange(ranges, "ratio") if ranges > 1 else values.coalesce(1)).withColumn("part", F.spark_partition_id()))
    starts, g, b, last = [], 0, 0, None
    for r in values.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("ratio").alias("last")).orderBy("part").collect():
        starts.append((r["part"], g, b, last))
        g, b, last = g + r["g"], b + r["b"], r["last"]
    here = Window.partitionBy("part").orderBy("ratio")
    rows = values.join(F.broadcast(held.sparkSession.createDataFrame(starts, "part int, g long, b long, last double")), "part")
    below = lambda c, start: F.col(start) + F.sum(c).over(here) - F.col(c)
    # balanced accuracy times good * bad, as a whole number
    rows = cut(rows.select("ratio", F.coalesce(F.lag("ratio").over(here), "last").alias("before"), (below("bad", "b") * good - below("good", "g") * bad).alias("right")))
    top = rows.agg(F.max("right")).first()[0]
    best = ranked(rows.where(F.col("right") == top), [F.col("ratio").asc()])
    middle = best.where(F.col("place") == best.count() // 2 + 1).first()
    return middle["ratio"] if middle["before"] is None else (middle["ratio"] + middle["before"]) / 2


def _ratio_column(rows: DataFrame, judge: Judge, name: str) -> DataFrame:
    """rows with the ratio of url, by a judge that is sent to all tasks."""
    sent = rows.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.steps(batches, "url", STEP):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.ratio(_texts(batch)), pa.float64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{name}` double"]))


def learn(urls: DataFrame, sample: int) -> Judge:
    """A judge of a bounded number of rows (url, label), label allow or block; judged() learns from all unless it's asked for a sample."""
    return _sampled(urls, sample)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int | None = None, entries: int = ENTRIES) -> DataFrame:
    """The columns of pages with host, path, rule, verdict and ratio (replaced if there, whatever case)."""
    spark = pages.sparkSession
    ship(spark)
    names = ("host", "path", "rule", "verdict", "ratio")
    rest = [c for c in pages.columns if c.lower() not in names]
    fits = unused(pages.columns, "fits")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = pages.select(*rest, host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias(fits))
    ruled = ruled.select(*rest, "host", "path", F.col(fits)["rule"].alias("rule"), F.col(fits)["verdict"].alias("verdict"))
    threshold = 0.0
    labelled = ruled.select("url", F.col("verdict").alias("label")).where("label is not null")
    if sample is not None:
        judge = learn(labelled, sample)
        rows, threshold = _ratio_column(ruled, judge, "ratio"), judge.threshold
    else:
        taught = cut(labelled.select("url", (F.col("label") == "allow").alias("allow")).distinct())
        kept = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
        counts = taught.where(~kept).mapInArrow(_tallied, "allow boolean, k int, joint long, context long, n long")
        counts = cut(counts.groupBy("allow", "k", "joint").agg(F.min("context").alias("context"), F.sum("n").alias("n")))
        n, sides = counts.agg(F.count(F.lit(1)), F.count_distinct("allow")).first()
        if sides < 2:
            rows = _ratio_column(ruled, Judge(None, None), "ratio")
        elif n <= entries:
            judge = _judge(counts)
            rows, threshold = _ratio_column(ruled, judge, "ratio"), _calibrated(_ratio_column(taught.where(kept), judge, "ratio"))
        else:
            url = unused(ruled.columns, "judged_url")
            ratios = cut(_ratios(ruled.select(F.coalesce("url", F.lit("")).alias("url")), counts))
            threshold = _calibrated(taught.where(kept).join(ratios, "url").select("allow", "ratio"))
            rows = ruled.join(ratios.withColumnRenamed("url", url), F.coalesce(ruled["url"], F.lit("")) == F.col(url)).drop(url)
    own = F.coalesce("verdict", F.when(F.col("ratio") >= F.lit(threshold), "allow").otherwise("block"))
    return rows.withColumn("verdict", own)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "ratio")

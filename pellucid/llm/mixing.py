"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key, of its id and text.  Ranges of keys (the
hash is uniform, so a fixed grid of the key space is a range partitioning of each
source) are the unit of distributed prefix sums: token counts are summed for each
(source, range), a running sum over the small table of ranges finds the one range in
which a source's budget ends, and only that range is sorted to find the key at the
exact word.  Documents of lesser keys are taken whole, those of greater keys not at
all; a row needs no more than its source's cut, so neither a hot source nor a large
corpus is ever sorted or gathered.

Sources by code point, null last, weigh WEIGHTS, repeating.  They share SHARE
of all words; a target stops at EPOCHS times its source's size and the excess
goes to the others by weight.  A target above the size repeats the source:
whole epochs first, then the part that is left.

Empty and null texts have size 0 and are taken 0 times.  Rows that share a doc_id, or
have none, have keys of their own by their texts; rows equal in id and text have one
key, are summed up before anything is sorted, and share evenly what the cut leaves
them.  So every run gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words_of, table, unused, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
#: Key ranges of a source: one for each so many documents.
RANGE_ROWS = 4096
SEED = "mix"
#: Above so many sources, their cuts aren't broadcast.
BROADCAST_ROWS = 100_000


def fair_targets(sizes: Sequence[int], weights: Sequence[float], total: float, epochs: int = EPOCHS) -> list[float]:
    """Shares of total by weight, none above epochs times its size; the excess is shared again among the rest."""
    target = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(total)
    while free:
        all_weights = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / all_weights >= epochs * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / all_weights
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
        free = [i for i in free if i not in set(over)]
        left -= sum(target[i] for i in over)
    return target


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Hex digits that order documents at random, alike in every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def budgets(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> tuple[list[tuple], DataFrame]:
    """One row for each source (source, source_size, n_docs, target), from (source, size); the sources are few and known by name."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["source_size"] or 0) for r in rows]
    targets = fair_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), epochs)
    out = [(r["source"], s, int(r["n_docs"]), float(t)) for r, s, t in zip(rows, sizes, targets, strict=True)]
    return out, docs.sparkSession.createDataFrame(out, "source string, source_size long, n_docs long, target double")


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """(own, source, size, mix_key): own has all columns of docs."""
    return docs.select(F.struct(*docs.columns).alias("own"), "source", n_words_of(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("mix_key"))


def cuts(counted: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """For each source its source_size and target, the whole epochs, and the key at which the last one ends with the words for each row of that key; from (source, size, mix_key)."""
    listed, sources = budgets(counted, weights, share, epochs)
    few = len(listed) <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda x: x)
    same = F.col("b.source").eqNullSafe(F.col("a.source"))
    place = F.conv(F.substring("a.mix_key", 1, 8), 16, 10).cast("long")
    key_range = F.shiftright(place * (F.floor(F.col("b.n_docs") / RANGE_ROWS) + 1), 32).alias("key_range")
    ranged = counted.where("size > 0").alias("a").join(small(sources.alias("b")), same).select("a.*", key_range)
    # what of the budget is left for the last epoch
    whole = F.floor(F.floor("target") / F.greatest(F.col("source_size"), F.lit(1)))
    plan = sources.select("source", "source_size", "target", whole.alias("whole"), (F.floor("target") - whole * F.col("source_size")).alias("rest"))
    ranges = ranged.groupBy("source", "key_range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("key_range")) - F.col("words")
    ranges = ranges.select("source", "key_range", "words", before.alias("before")).alias("a").join(small(plan.alias("b")), same).select("a.*", "b.rest")
    ends = ranges.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("source", "key_range", "before", "rest")
    mine = ranged.alias("a").join(small(ends.alias("b")), same & (F.col("a.key_range") == F.col("b.key_range"))).select("a.source", "mix_key", "size", "before", "rest")
    keys = mine.groupBy("source", "mix_key", "before", "rest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    run = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("mix_key")) - F.col("words")
    at = keys.withColumn("run", run).where((F.col("run") < F.col("rest")) & (F.col("run") + F.col("words") >= F.col("rest")))
    at = at.select("source", F.col("mix_key").alias("cut_key"), F.floor((F.col("rest") - F.col("run")) / F.col("rows")).alias("part"))
    return plan.alias("a").join(at.alias("b"), same, "left").select("a.source", "source_size", "target", "whole", "cut_key", "part")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document, and the columns of docs named in keep; a result's name goes to the result."""
    slim = docs.select(*dict.fromkeys(("doc_id", "source", "text", *keep)))
    counted = cut(_keyed(slim, seed).select(F.col("own.doc_id").alias("doc_id"), "source", "size", "mix_key"))
    plan = cut(cuts(counted, weights, share, epochs))
    plan = F.broadcast(plan) if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else plan
    rows = (_keyed(slim, seed) if keep else counted.withColumn("own", F.struct("doc_id"))).alias("a")
    rows = rows.join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    last = F.when(F.col("a.mix_key") < F.col("b.cut_key"), F.col("a.size")).when(F.col("a.mix_key") == F.col("b.cut_key"), F.least(F.col("a.size"), F.col("b.part"))).otherwise(F.lit(0))
    taken = (F.col("b.whole") * F.col("a.size") + F.when(F.col("a.size") > 0, last).otherwise(F.lit(0))).cast("long")
    results = {"size": F.col("a.size"), "source_size": F.col("b.source_size"), "target": F.col("b.target"), "taken": taken}
    kept = [c for c in (keep or ["doc_id"]) if c.lower() not in results]
    return rows.select(*(F.col("a.own")[c].alias(c) for c in kept), *(v.alias(k) for k, v in results.items()))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of docs and epoch (from 1; docs' own epoch is replaced), a row each time a document is read; where the budget ends within a text, its first words joined by one space."""
    names = [unused(docs.columns, n) for n in ("mix_size", "mix_taken")]
    rows = mix(docs, weights, share, epochs, seed, keep=docs.columns)
    plain = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken", "epoch")]
    rows = rows.where("taken > 0").select(*plain, F.col("size").alias(names[0]), F.col("taken").alias(names[1]))
    size, taken = (F.col(n) for n in names)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))).alias("epoch"))
    left = F.least(size, taken - (F.col("epoch") - 1) * size)
    head = F.array_join(F.slice(words_of(F.col("text")), F.lit(1), left.cast("int")), " ")
    text = F.when(left < size, head).otherwise(F.col("text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col(c) for c in plain), "epoch")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS mix_key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
-- sources fill up in the order of size by weight; level: words for a unit of weight once the earlier ones are full
l AS (
  SELECT source, source_size, w, 2 * source_size AS most,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS k
  FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source IS NULL, source)),
c AS (SELECT min(k) AS k FROM l WHERE level * w < most),
t AS (
  SELECT source, source_size, CASE WHEN l.k < coalesce((SELECT k FROM c), 1000000000) THEN CAST(most AS DOUBLE) ELSE (SELECT level FROM l AS x WHERE x.k = (SELECT k FROM c)) * w END AS target
  FROM l),
g AS (
  SELECT source, mix_key, words, n, coalesce(sum(words) OVER (PARTITION BY source ORDER BY mix_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM (SELECT source, mix_key, sum(size) AS words, count(*) AS n FROM d GROUP BY 1, 2)),
e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, g.run, g.words, g.n,
         CAST(floor(floor(target) / greatest(source_size, 1)) AS BIGINT) AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.mix_key = g.mix_key)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
       CAST(epochs * size + floor(greatest(0, least(words, floor(target) - epochs * source_size - run)) / n) AS BIGINT) AS taken
FROM e
"""

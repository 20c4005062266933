"""Language-model scores from a log-frequency Bloom filter.

Unigram and bigram counts of all training documents are added up in hash
segments, whose number follows from the number of documents alone.  A count c is
quantised to level 1 + floor(log c / log BASE), and an n-gram of level L enters the
filter of its segment L times, as (n-gram, 1) .. (n-gram, L).  A probe asks for level
1, 2, ... until one is missing; errors only ever add, and a level too many is as
rare as a false positive, ERROR = 2 ** -HASHES.  A segment's filter is as large as its
entries ask for, so that no count is dropped.  Up to MAX_FILTER_BYTES in all the
filter is broadcast; a larger one stays in its segments, and the distinct n-grams of
every CHUNK tokens are sent to them and their levels back.  Both ways, and any number
of partitions, give the same scores.

P(word | before) = (c(before, word) + PRIOR * P(word)) / (c(before) + PRIOR), with
add-0.1 unigrams, all counts from the filter (Dirichlet smoothing).  Bigrams seen
once are left out, as is usual.

The exact unigram counts behind base_score are broadcast as hashes with counts
for the most frequent words, at most MAX_VOCABULARY; those of rarer words, if
there are any, are joined with the words of the documents.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased and one end for each
document; null and empty texts are an end alone.  Repeated rows count each time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import cut, parts, ship, table, unused

BASE = 1.5
HASHES = 4
ERROR = 2.0**-HASHES
LEAST_BIGRAM = 2
#: Words that the unigram estimate counts for behind every word; of 0.5 to 10,000, 1,000 fits held-out texts of the test tables best.
PRIOR = 1000.0
#: Documents for each segment of the counts, and the least number of segments.
SEGMENT_ROWS, LEAST_SEGMENTS = 1 << 17, 64
#: A filter of more bytes isn't broadcast.
MAX_FILTER_BYTES = 48 << 20
MAX_VOCABULARY = 16_000_000
#: Tokens that a task counts before it sends the sums.
FLUSH = 1_500_000
#: Tokens whose n-grams are sent to the parts of the filter together.
CHUNK = 1_500_000

_START, _END = flat.mix(np.array([101, 102], flat.U64))
_PAIR = flat.U64(0xD6E8FEB86659FD93)
UNIGRAM, BIGRAM, FILTER = 0, 1, 2


def level_of(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def _value(level: int) -> float:
    return (math.ceil(BASE ** (level - 1) - 1e-9) + math.ceil(BASE**level - 1e-9) - 1) / 2 if level else 0.0


#: The middle of the counts of each level.
VALUES = np.array([_value(k) for k in range(120)])


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return flat.mix(before * _PAIR + flat.mix(word))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start, words and end of each text, and the n+1 bounds."""
    data, at = flat.buffers(column)
    data = flat.LOWER[data]
    starts, ends, first = flat.words(data, at, flat.WORD_BYTES)
    h = flat.word_hashes(data, starts, ends)
    n = len(at) - 1
    bounds = first + 2 * np.arange(n + 1)
    out = np.empty(len(h) + 2 * n, flat.U64)
    out[bounds[:-1]] = _START
    out[bounds[1:] - 1] = _END
    out[np.arange(len(h)) + 2 * flat.owner(first, len(h)) + 1] = h
    return out, bounds


def _places(key: np.ndarray, level: np.ndarray | int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Bit numbers of (key, level) in filters of the given bits."""
    x = flat.mix(key + np.asarray(level).astype(flat.U64) * flat.U64(0xA24BAED4963EE407))
    a, b = x & flat.U64(0xFFFFFFFF), (x >> flat.U64(32)) | flat.U64(1)
    for i in range(HASHES):
        yield (a + flat.U64(i) * b) % bits


PART = "kind int, part int, key binary, n binary"


def _count(parts_: int):
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("key", "n"))])

    def flush(held: list[np.ndarray]):
        every = np.concatenate(held)
        seen, place, count = np.unique(every, return_inverse=True, return_counts=True)
        word = np.flatnonzero(seen != _START)
        part = (seen[word] % flat.U64(parts_)).astype(np.int64)
        rows = [{"kind": UNIGRAM} | r for r in flat.spread(part, parts_, {"key": seen[word], "n": count[word].astype(np.int32)})]
        inner = np.flatnonzero(every[1:] != _START)
        code = np.sort(place[inner] * len(seen) + place[inner + 1])
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        n = np.diff(np.append(first, len(code))).astype(np.int32)
        before, after = np.divmod(code[first], len(seen))
        key = pair_hash(seen[before], seen[after])
        part = (key % flat.U64(parts_)).astype(np.int64)
        rows += [{"kind": BIGRAM} | r for r in flat.spread(part, parts_, {"key": key, "n": n})]
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        held, size = [], 0
        for batch in flat.steps(batches, "text"):
            x, _ = tokens(batch.column(batch.schema.get_field_index("text")))
            held.append(x)
            size += len(x)
            if size > FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


SUMS = "kind int, part int, key binary, n binary, total long, size long"


def _sum():
    """The vocabulary and the filter of each segment, from rows sorted by it; one segment is held at a time."""

    def add_up(x: list[tuple[bytes, bytes]]):
        key, n = np.frombuffer(b"".join(k for k, _ in x), flat.U64), np.frombuffer(b"".join(c for _, c in x), np.int32)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], np.add.reduceat(n, first)

    def summed(p: int, held: dict[int, list[tuple[bytes, bytes]]]):
        out, items, levels = [], [], []
        if UNIGRAM in held:
            key, n = add_up(held.pop(UNIGRAM))
            items.append(key)
            levels.append(level_of(n))
            out.append((UNIGRAM, p, key.tobytes(), n.tobytes(), int(n.sum()), len(key)))
        if BIGRAM in held:
            key, n = add_up(held.pop(BIGRAM))
            items.append(key[n >= LEAST_BIGRAM])
            levels.append(level_of(n[n >= LEAST_BIGRAM]))
        key, level = np.concatenate(items), np.concatenate(levels)
        size = int(max(64, level.sum() * HASHES / math.log(2)))
        size = -(-size // 64) * 64
        bit = np.zeros(size, bool)
        for q in range(1, int(level.max()) + 1 if len(level) else 1):
            some = key[level >= q]
            for place in _places(some, q, np.full(1, size, flat.U64)):
                bit[place.astype(np.int64)] = True
        out.append((FILTER, p, np.packbits(bit, bitorder="little").tobytes(), b"", 0, size))
        k, p, key, n, total, size = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(key, pa.binary()), pa.array(n, pa.binary()), pa.array(total, pa.int64()), pa.array(size, pa.int64())], ["kind", "part", "key", "n", "total", "size"])

    def run(batches):
        here, held = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != here and held:
                    yield summed(here, held)
                    held = {}
                here = r["part"]
                held.setdefault(r["kind"], []).append((r["key"], r["n"]))
        if held:
            yield summed(here, held)

    return run


def _frequencies(batches):
    """How many words occur at least 1, 2, 4, ... times."""
    above = np.zeros(64, np.int64)
    for batch in batches:
        for raw in batch.column(batch.schema.get_field_index("n")).to_pylist():
            n = np.sort(np.frombuffer(raw, np.int64))
            above[:63] += len(n) - np.searchsorted(n, np.int64(1) << np.arange(63, dtype=np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([above.tobytes()], pa.binary())], ["above"])


def _chosen(least: int | None, below: int | None):
    """The words that occur at least, or less than, so often."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                key, n = np.frombuffer(r["key"], np.int64), np.frombuffer(r["n"], np.int64)
                some = (n >= (least or 0)) & ((n < below) if below else True)
                yield pa.RecordBatch.from_arrays([pa.array([key[some].tobytes()], pa.binary()), pa.array([n[some].tobytes()], pa.binary()), pa.array([int(some.sum())])], ["key", "n", "size"])

    return run


@dataclass
class Filter:
    """Quantised counts by probing; one stretch of bytes for each part."""

    parts: int
    at: np.ndarray
    bits: np.ndarray
    data: np.ndarray

    def level(self, key: np.ndarray) -> np.ndarray:
        level = np.zeros(len(key), np.int64)
        if not len(self.data):
            return level
        part = (key % flat.U64(self.parts)).astype(np.int64)
        base, bits = self.at[part], self.bits[part]
        live = np.arange(len(key))
        q = 0
        while len(live) and q < len(VALUES) - 1:
            q += 1
            hit = np.ones(len(live), bool)
            for place in _places(key[live], q, bits[live]):
                place = place.astype(np.int64)
                hit &= (self.data[base[live] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 > 0
            live = live[hit]
            level[live] = q
        return level


class Ngrams:
    """The distinct n-grams of some texts, by place, and the keys that the filter is asked for."""

    def __init__(self, x: np.ndarray, bounds: np.ndarray):
        seen, place = np.unique(x, return_inverse=True)
        self.fill(seen, place, bounds)

    def fill(self, seen: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> Ngrams:
        self.seen, self.place, self.bounds = seen, place, bounds
        inner = np.flatnonzero(seen[place] != _START)
        self.owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[inner]
        before, self.word = place[inner - 1], place[inner]
        pairs, self.back = np.unique(before.astype(np.int64) * len(seen) + self.word, return_inverse=True)
        self.a, self.b = np.divmod(pairs, max(len(seen), 1))
        return self

    @classmethod
    def of(cls, seen: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> Ngrams:
        return cls.__new__(cls).fill(seen, place, bounds)

    def keys(self) -> np.ndarray:
        return np.concatenate([np.where(self.seen == _START, _END, self.seen), pair_hash(self.seen[self.a], self.seen[self.b])])


@dataclass
class Model:
    filter: Filter | None  # None: too large to be broadcast
    segments: int
    total: int
    distinct: int
    vocabulary: tuple[np.ndarray, np.ndarray]
    least: int  # the vocabulary has the words that occur so often; 1: all

    def exact(self, word: np.ndarray) -> np.ndarray:
        """Counts of words, 0 for those that the vocabulary lacks."""
        key, count = self.vocabulary
        if not len(key):
            return np.zeros(len(word), np.int64)
        k = np.minimum(np.searchsorted(key, word), len(key) - 1)
        return np.where(key[k] == word, count[k], 0).astype(np.int64)

    def base(self, g: Ngrams) -> tuple[np.ndarray, np.ndarray]:
        """For each text: known tokens and the sum of logs behind base_score, both of the vocabulary's words."""
        n = len(g.bounds) - 1
        below = self.total + 0.1 * (self.distinct + 1)
        exact = self.exact(g.seen)
        term = np.where((exact > 0) | (self.least == 1), np.log10((exact + 0.1) / below), 0.0)
        return np.bincount(g.owner, (exact > 0)[g.word], minlength=n).astype(np.int64), np.bincount(g.owner, term[g.word], minlength=n)

    def score(self, g: Ngrams, level: np.ndarray) -> np.ndarray:
        """The score of each text, from the levels of its n-grams' keys."""
        unigram, c = VALUES[level[: len(g.seen)]], VALUES[level[len(g.seen) :]]
        below = self.total + 0.1 * (self.distinct + 1)
        c = np.where(c >= LEAST_BIGRAM, c, 0.0)
        p = (np.minimum(c, unigram[g.a]) + PRIOR * (unigram[g.b] + 0.1) / below) / (unigram[g.a] + PRIOR)
        return np.bincount(g.owner, np.log10(p)[g.back], minlength=len(g.bounds) - 1)


def _broadcast_filter(sums: DataFrame, n: int, size: int) -> Filter:
    """All parts of the filter in one."""
    at, bits = np.zeros(n, np.int64), np.full(n, 64, flat.U64)
    # one partition at a time, so that the driver never holds the rows and the model at once
    data = np.zeros(size + 8, np.uint8)
    end = 8  # parts without entries share an empty stretch
    for r in sums.where(F.col("kind") == FILTER).select("part", "key", "size").toLocalIterator():
        at[r["part"]], bits[r["part"]] = end, r["size"]
        data[end : end + len(r["key"])] = np.frombuffer(r["key"], np.uint8)
        end += len(r["key"])
    return Filter(n, at, bits, data)


PROBE, LEVELS, HOME = 3, 4, 5
PROBES = "kind int, part int, home int, chunk string, from_part int, size long, key binary, place binary, bounds binary, rows binary"


def _message(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "part": pa.int32(), "home": pa.int32(), "chunk": pa.string(), "from_part": pa.int32(), "size": pa.int64()}
    kinds |= dict.fromkeys(("key", "place", "bounds", "rows"), pa.binary())
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))


def _sent_out(parts_: int, kept: Callable[[pa.RecordBatch, Ngrams], pa.RecordBatch]):
    """For every chunk of texts its keys, each to the part of the filter that knows it, and the rest to its home."""

    def flush(held, number):
        x = np.concatenate([x for _, x, _ in held])
        # named alike when a task is run again on the same rows
        chunk = f"{hashlib.md5(x.tobytes()).hexdigest()}-{TaskContext.get().partitionId()}-{number}"
        home = int(chunk[:8], 16) % parts_
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, _, b in held]))])
        g = Ngrams(x, bounds)
        rows = kept(pa.Table.from_batches([b for b, _, _ in held]).combine_chunks().to_batches()[0], g)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        yield _message([{"kind": HOME, "part": home, "home": home, "chunk": chunk, "key": g.seen.tobytes(), "place": g.place.astype(np.uint32).tobytes(), "bounds": bounds.astype(np.int64).tobytes(), "rows": sink.getvalue().to_pybytes()}])
        key = g.keys()
        yield _message([{"kind": PROBE, "home": home, "chunk": chunk, "from_part": r["part"], **r} for r in flat.spread((key % flat.U64(parts_)).astype(np.int64), parts_, {"key": key})])

    def run(batches):
        held, size, number = [], 0, 0
        for batch in flat.steps(batches, "text"):
            x, bounds = tokens(batch.column(batch.schema.get_field_index("text")))
            held.append((batch, x, bounds))
            size += len(x)
            if size > CHUNK:
                yield from flush(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield from flush(held, number)

    return run


def _asked(batches):
    """Levels for the keys that came to a part of the filter; homes pass through."""
    filters, held = {}, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == FILTER:
                filters[r["part"]] = Filter(1, np.zeros(1, np.int64), np.full(1, r["size"], flat.U64), np.frombuffer(r["key"], np.uint8))
            elif r["kind"] == HOME:
                yield _message([r])
            else:
                held.append(r)
    for r in held:
        key = np.frombuffer(r["key"], flat.U64)
        level = filters[r["part"]].level(key) if r["part"] in filters else np.zeros(len(key), np.int64)
        yield _message([r | {"kind": LEVELS, "part": r["home"], "key": level.astype(np.uint8).tobytes()}])


def segments_of(rows: int) -> int:
    """A power of two; the counts of that many documents are in so many segments, whatever the partitions."""
    return max(LEAST_SEGMENTS, 1 << max(0, (rows // SEGMENT_ROWS).bit_length()))


def learn(training: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES, max_vocabulary: int = MAX_VOCABULARY) -> tuple[Model, DataFrame]:
    """The model of the texts of training, and the sums it came from (vocabulary blobs are of kind UNIGRAM)."""
    spark = training.sparkSession
    ship(spark)
    n = segments_of(training.count())
    dealt = training.select("text").mapInArrow(_count(n), PART).repartitionById(parts(spark), F.col("part") % parts(spark)).sortWithinPartitions("part")
    sums = cut(dealt.mapInArrow(_sum(), SUMS))
    heads = sums.where(F.col("kind") == UNIGRAM).agg(F.sum("total"), F.sum("size")).first()
    total, distinct = int(heads[0] or 0), int(heads[1] or 0)
    size = int(sums.where(F.col("kind") == FILTER).agg(F.sum(F.length("key"))).first()[0] or 0)
    filter_ = _broadcast_filter(sums, n, size) if size <= max_filter_bytes else None
    words, least = sums.where(F.col("kind") == UNIGRAM).select("key", "n", "size"), 1
    size = distinct
    if distinct > max_vocabulary:
        above = np.zeros(64, np.int64)
        for r in words.mapInArrow(_frequencies, "above binary").toLocalIterator():
            above += np.frombuffer(r["above"], np.int64)
        k = int(np.argmax(above <= max_vocabulary))
        least, size = 1 << k, int(above[k])
        words = words.mapInArrow(_chosen(least, None), "key binary, n binary, size long")
    key, count, end = np.empty(size, flat.U64), np.empty(size, np.uint32 if total < 1 << 32 else np.int64), 0
    for r in words.toLocalIterator():
        key[end : end + r["size"]] = np.frombuffer(r["key"], flat.U64)
        count[end : end + r["size"]] = np.frombuffer(r["n"], np.int64)
        end += r["size"]
    order = np.argsort(key)
    vocabulary = key[order], count[order]
    del key, count, order
    return Model(filter_, n, total, distinct, vocabulary, least), sums


def scored(docs: DataFrame, model: Model, sums: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) and the other columns of docs but text."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "n_known", "base_score", "score")]
    key, more_known, more_base = (unused(docs.columns, c) for c in ("row_key", "more_known", "more_base"))
    kept = docs.select(*rest, "text")
    names = ["n_tokens", "n_known", "base_score", "score"]
    exact = model.least == 1
    if not exact:
        kept = kept.withColumn(key, F.monotonically_increasing_id())
        rest = [*rest, key]
        kept = cut(kept)

    def named(batch: pa.RecordBatch, g: Ngrams) -> pa.RecordBatch:
        known, base = sent.value.base(g)
        columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(g.bounds) - 1), pa.array(known), pa.array(base)], [*rest, *names[:3]])

    def scores(rows: pa.RecordBatch, g: Ngrams, level: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(sent.value.score(g, level))], [*rest, *names])

    def run(batches):
        for batch in flat.steps(batches, "text"):
            g = Ngrams(*tokens(batch.column(batch.schema.get_field_index("text"))))
            yield scores(named(batch, g), g, sent.value.filter.level(g.keys()))

    n, many = model.segments, parts(spark)

    def answered(batches):
        homes, levels = {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == HOME:
                    homes[r["chunk"]] = r
                else:
                    levels.setdefault(r["chunk"], {})[r["from_part"]] = r["key"]
        for chunk in list(homes):
            r, mine = homes.pop(chunk), levels.pop(chunk, {})
            g = Ngrams.of(np.frombuffer(r["key"], flat.U64), np.frombuffer(r["place"], np.uint32).astype(np.int64), np.frombuffer(r["bounds"], np.int64))
            key = g.keys()
            level = np.empty(len(key), np.int64)
            # as flat.spread dealt them
            level[np.argsort((key % flat.U64(n)).astype(np.int64), kind="stable")] = np.frombuffer(b"".join(mine[p] for p in sorted(mine)), np.uint8)
            with pa.ipc.open_stream(r["rows"]) as source:
                for rows in source:
                    yield scores(rows, g, level)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text"), "n_tokens long, n_known long, base_score double, score double"])
    if model.filter is not None:
        out = kept.mapInArrow(run, schema)
    else:
        probes = kept.mapInArrow(_sent_out(n, named), PROBES)
        filters = sums.where(F.col("kind") == FILTER).select("kind", "part", "size", "key")
        asked = probes.unionByName(filters, allowMissingColumns=True).repartitionById(many, F.col("part") % many).mapInArrow(_asked, PROBES)
        out = asked.repartitionById(many, F.col("part") % many).mapInArrow(answered, schema)
    if exact:
        return out

    def pairs(batches):
        for batch in flat.steps(batches, "text"):
            x, bounds = tokens(batch.column(batch.schema.get_field_index("text")))
            row = batch.column(batch.schema.get_field_index(key)).to_numpy()
            owner = np.repeat(np.arange(len(row)), np.diff(bounds))
            inner = (x != _START) & (sent.value.exact(x) == 0)
            order = np.lexsort((x[inner], owner[inner]))
            w, o = x[inner][order], owner[inner][order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(w)), bool), (w[1:] != w[:-1]) | (o[1:] != o[:-1])]))
            n = np.diff(np.append(first, len(w)))
            yield pa.RecordBatch.from_arrays([pa.array(row[o[first]]), pa.array(w[first].view(np.int64)), pa.array(n)], ["row_key", "word", "n"])

    def listed(batches):
        for batch in batches:
            for r in batch.to_pylist():
                key, n = np.frombuffer(r["key"], np.int64), np.frombuffer(r["n"], np.int64)
                for s in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[s : s + 100_000]), pa.array(n[s : s + 100_000])], ["word", "c"])

    rare = sums.where(F.col("kind") == UNIGRAM).select("key", "n", "size").mapInArrow(_chosen(None, model.least), "key binary, n binary, size long")
    vocabulary = rare.select("key", "n").mapInArrow(listed, "word long, c long")
    below = model.total + 0.1 * (model.distinct + 1)
    c = F.coalesce("c", F.lit(0))
    term = kept.select(key, "text").mapInArrow(pairs, "row_key long, word long, n long").join(vocabulary, "word", "left")
    each = term.groupBy("row_key").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(F.lit(0))).alias(more_known), F.sum(F.col("n") * F.log10((c + 0.1) / F.lit(below))).alias(more_base)).withColumnRenamed("row_key", key)
    both = out.join(each, key, "left").withColumns({"n_known": F.col("n_known") + F.coalesce(more_known, F.lit(0)), "base_score": F.col("base_score") + F.coalesce(more_base, F.lit(0.0))})
    return both.drop(key, more_known, more_base)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text leaves remainder 0 by 10; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model, sums = learn(docs.where("not held_out"))
    return scored(docs, model, sums).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")

"""Spelling variants: words one edit apart, found by Aho-Corasick automata over halves of words.

Of two words one edit apart the shorter (or either, if they are as long) is kept whole on
one side of its middle: one half occurs in the other word, at the start or at the end.
So every word gives two segments, each with the range [a, b) of letters between which
the edit must then lie.  Segments are dealt to shards by hash, and a word is sent to
the shards of the segments it could hold by its length: of words as long as itself or
one letter shorter.  A shard builds one automaton of its segments, scans every word it got, and
keeps an occurrence if it starts or ends where the segment must and the lengths agree.
What is left is verified: the ranges of both words are packed into 64-bit numbers,
and one byte differs, or one inserted byte shifts the rest.

A segment that more than HEAVY words meet is refined: its range is cut in two, the words on either
side of the edit are kept whole further, and the shard then asks for two segments, one from the
start and one at the end.  That is repeated while a segment is heavy, so no group is
compared pair by pair as a whole.  Ranges of a word never overlap, so a pair is found
once: an insertion counts in the range that holds the first letter that differs.

Words are counted where texts are read; runs under five letters never leave that task.
Runs of one step of 2 MB that agree in 64 bits of hash and in length count as equal.

Null texts have no words; a null id stands as nothing before the colon.  Rows that share an id
count each.  A table without words gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, table
from .flat import LOWER, buffers, mix, steps

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A run is damaged if this divides its checksum.
DAMAGED = 97
#: How many times a word's n its form's must be.
RATIO = 2
#: Words that a task counts before it sends them on.
HELD = 300_000
#: A segment that more words meet is refined.
HEAVY = 4096
#: Rows of a shard, about.
SHARD_ROWS = 16_384
#: Up to so many refined segments are broadcast, 8 bytes each.
BROADCAST_ROWS = 100_000
#: Pairs that are verified at once.
BLOCK = 1 << 19
#: Longer runs are checksummed one by one.
LONG = 64

_u = np.uint64
_LOW, _HIGH, _ONE, _SEVEN = _u(0x7F7F7F7F7F7F7F7F), _u(0x8080808080808080), _u(1), _u(7)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


_CRC = _crc_table()


def _runs(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and code points of the runs of letters of lower-cased texts that are long enough."""
    lead = low == 0xC3  # its one other byte makes it U+00C0 to U+00FF
    inside = (low >= 0x61) & (low <= 0x7A) | lead
    inside[1:] |= lead[:-1]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = at[:-1] < at[1:]
    begin[at[:-1][filled]] = inside[at[:-1][filled]]
    end[at[1:][filled] - 1] = inside[at[1:][filled] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    some = ends - starts >= LEAST_LETTERS
    starts, ends = starts[some], ends[some]
    before = np.concatenate([[0], np.cumsum(lead)])
    letters = ends - starts - (before[ends] - before[starts])
    some = letters >= LEAST_LETTERS
    return starts[some], ends[some], letters[some]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the runs of each text, damaged where their checksum says so; a word may come several times."""
    held: dict[str, int] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in steps(batches, "text"):
        data, at = buffers(batch.column("text"))
        low = LOWER[data]
        starts, ends, letters = _runs(low, at)
        if not len(starts):
            continue
        order = np.argsort((np.iinfo(np.int64).max - (ends - starts)), kind="stable")
        starts, ends, letters = starts[order], ends[order], letters[order]
        size = ends - starts
        doc = np.searchsorted(at, starts, "right") - 1
        first = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in batch.column("doc_id").to_pylist()], np.uint32)
        state, key = first[doc] ^ np.uint32(0xFFFFFFFF), size.astype(np.uint64) * _u(0x9E3779B97F4A7C15)
        raw = low.tobytes()
        n_long = int(np.searchsorted(-size, -LONG, "left"))
        longest = min(int(size[n_long:].max(initial=0)), LONG)
        more = len(size) - n_long - np.cumsum(np.bincount(size[n_long:], minlength=longest + 1))  # runs of more than j bytes
        for j in range(longest):
            own = slice(n_long, n_long + int(more[j]))
            byte = low[starts[own] + j]
            s = state[own]
            state[own] = _CRC[(s ^ byte) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
            key[own] = (key[own] ^ byte) * _u(0x100000001B3)
        check = state ^ np.uint32(0xFFFFFFFF)
        for k in range(n_long):
            word = raw[starts[k] : ends[k]]
            check[k] = zlib.crc32(word, int(first[doc[k]]))
            key[k] = _u(hash(word) & (2**64 - 1))  # the same in this process, which is enough
        key = mix(key)
        hit = check % DAMAGED == 0
        for k in np.flatnonzero(hit).tolist():
            word, i = raw[starts[k] : ends[k]].decode(), int(check[k]) % int(letters[k])
            if letters[k] > LEAST_LETTERS:
                word = word[:i] + word[i + 1 :]
                held[word] = held.get(word, 0) + 1
        _, one, n = np.unique(key[~hit], return_index=True, return_counts=True)
        a, b = starts[~hit][one].tolist(), ends[~hit][one].tolist()
        for x, y, c in zip(a, b, n.tolist(), strict=True):
            word = raw[x:y].decode()
            held[word] = held.get(word, 0) + c
        if len(held) >= HELD:
            yield out()
            held.clear()
    yield out()


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all texts (doc_id, text)."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, size, a, b) with the hash of their segments: what stands before a, and behind b letters of a word of that size."""
    before = F.substring("word", F.lit(1), F.col("a"))
    behind = F.substring("word", F.char_length("word") - (F.col("size") - F.col("b")) + 1, F.col("size") - F.col("b"))
    return rows.withColumn("k", F.xxhash64("size", "a", "b", before, behind))


def _halves(size: Column, a: Column, b: Column) -> Column:
    """The two ranges of a range; what lies beside each is kept whole."""
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(F.struct(size.alias("size"), middle.alias("a"), b.alias("b")), F.struct(size.alias("size"), a.alias("a"), middle.alias("b")))


def segments(counted: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(word, n, size, a, b, k): every word with the segments it is looked for by, and those of words a letter shorter."""
    own, none = F.char_length("word"), F.lit(0)
    shorter = F.when(own > LEAST_LETTERS, _halves(own - 1, none, own - 1))
    every = F.concat(_halves(own, none, own), F.coalesce(shorter, F.array().cast("array<struct<size:int,a:int,b:int>>")))
    rows = _keyed(counted.select("word", "n", F.inline(every)))
    while True:
        many = cut(rows.where(F.col("b") - F.col("a") > 1).groupBy("k").count().where(F.col("count") > heavy).select("k", F.lit(True).alias("many")))
        n = many.count()
        if not n:
            return rows
        parts = F.when(F.col("many") & (F.col("b") - F.col("a") > 1), _halves(F.col("size"), F.col("a"), F.col("b"))).otherwise(F.array(F.struct("size", "a", "b")))
        joined = rows.join(F.broadcast(many) if n <= BROADCAST_ROWS else many, "k", "left")
        rows = _keyed(joined.select("word", "n", F.inline(parts)))


def _packed(words_: list[bytes], a: int, b: int) -> np.ndarray:
    return np.frombuffer(b"".join(w[a:b].ljust(8, b"\0") for w in words_), "<u8")


def _bytes(words_: list[bytes], a: int, b: int) -> np.ndarray:
    return np.frombuffer(b"".join(w[a:b] for w in words_), np.uint8).reshape(len(words_), b - a)


def _differing(x: np.ndarray) -> np.ndarray:
    """The top bit of each byte of x that isn't 0."""
    return (((x & _LOW) + _LOW) | x) & _HIGH


def _replaced(same: list[bytes], a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, both ways, of words that differ in one letter, and that in [a, b)."""
    block = max(1, BLOCK // len(same) // (1 if b - a <= 8 else b - a))
    own = _packed(same, a, b) if b - a <= 8 else _bytes(same, a, b)
    for at in range(0, len(same), block):
        if b - a <= 8:
            z = _differing(own[at : at + block, None] ^ own[None, :])
            found = (z != 0) & ((z & (z - _ONE)) == 0)
        else:
            found = (own[at : at + block, None, :] != own[None, :, :]).sum(2) == 1
        i, j = np.nonzero(found)
        yield i + at, j


def _inserted(short: list[bytes], long: list[bytes], a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words where long has one letter more; the first letter that differs is in [a, b), or behind all."""
    m, last = b - a, b == len(short[0])
    block = max(1, BLOCK // len(long) // (1 if m <= 8 else m))
    pack = _packed if m <= 8 else _bytes
    own, low, high = pack(short, a, b), pack(long, a, b), pack(long, a + 1, b + 1)
    for at in range(0, len(short), block):
        if m <= 8:
            z = _differing(own[at : at + block, None] ^ low[None, :])
            # from the first byte that differs, the rest must agree one place on
            found = (own[at : at + block, None] ^ high[None, :]) <= ((z & (~z + _ONE)) >> _SEVEN) - _ONE
            if not last:
                found &= z != 0
        else:
            same = np.logical_and.accumulate(own[at : at + block, None, :] == low[None, :, :], 2).sum(2)
            rest = np.logical_and.accumulate((own[at : at + block, None, :] == high[None, :, :])[:, :, ::-1], 2).sum(2)
            found = same + rest >= m
            if not last:
                found &= same < m
        i, j = np.nonzero(found)
        yield i + at, j


def _shard(rows: pa.Table) -> pa.Table:
    """(word, n_near, near, near_n) of the words of a shard: how many of its words are near by its segments, and the most frequent of them."""
    import ahocorasick

    text, counts = rows["word"].to_pylist(), rows["n"].to_pylist()
    index: dict[str, int] = {}
    n: list[int] = []
    found: dict[tuple, tuple[list[int], list[int]]] = {}
    ranges: dict[int, set[tuple[int, int]]] = {}
    scan = ahocorasick.Automaton()
    for w, c, size, a, b in zip(text, counts, rows["size"].to_pylist(), rows["a"].to_pylist(), rows["b"].to_pylist(), strict=True):
        if w not in index:
            index[w] = len(n)
            n.append(c)
        if len(w) == size:  # its own segments
            before, behind = w[:a], w[b:]
            found[size, a, b, before, behind] = [], []
            ranges.setdefault(size, set()).add((a, b))
            for s in (before, behind):
                if s:
                    scan.add_word(s, len(s))
    listed = list(index)
    if len(scan):
        scan.make_automaton()
        for k, w in enumerate(listed):
            end = len(w) - 1
            starting, ending = {0}, {0}
            for stop, size in scan.iter(w):
                if stop == size - 1:
                    starting.add(size)
                if stop == end:
                    ending.add(size)
            for longer in (0, 1):
                size = len(w) - longer
                for a, b in ranges.get(size, ()):
                    if a in starting and size - b in ending:
                        own = found.get((size, a, b, w[:a], w[len(w) - (size - b) :]))
                        if own is not None:
                            own[longer].append(k)
    latin = [w.encode("latin-1") for w in listed]
    best_first = np.array(sorted(range(len(listed)), key=lambda k: (-n[k], listed[k])), np.int64)
    place = np.empty(len(listed), np.int64)
    place[best_first] = np.arange(len(listed))
    near, best = np.zeros(len(listed), np.int64), np.full(len(listed), len(listed), np.int64)

    def count(i: np.ndarray, j: np.ndarray) -> None:
        near[:] += np.bincount(i, minlength=len(listed))
        np.minimum.at(best, i, place[j])

    for (_, a, b, _, _), (same, longer) in found.items():
        short = [latin[k] for k in same]
        own = np.array(same, np.int64)
        if len(same) > 1:
            for i, j in _replaced(short, a, b):
                if len(i):
                    count(own[i], own[j])
        if longer:
            others = np.array(longer, np.int64)
            for i, j in _inserted(short, [latin[k] for k in longer], a, b):
                if len(i):
                    count(own[i], others[j])
                    count(others[j], own[i])
    some = np.flatnonzero(near)
    top = best_first[best[some]]
    return pa.table({
        "word": pa.array([listed[k] for k in some], pa.string()),
        "n_near": pa.array(near[some]),
        "near": pa.array([listed[k] for k in top], pa.string()),
        "near_n": pa.array([n[k] for k in top], pa.int64()),
    })


def neighbours(counted: DataFrame, heavy: int = HEAVY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n_near, near, near_n) of every word of (word, n) that has a near one; near is the most frequent, the first of equals."""
    rows = segments(counted, heavy)
    shards = max(1, -(-4 * counted.count() // shard_rows))
    dealt = rows.select(F.pmod("k", F.lit(shards)).alias("shard"), "word", "n", "size", "a", "b")
    found = dealt.groupBy("shard").applyInArrow(_shard, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last; pointers double their reach in each round.

    A form has at least RATIO times the word's count, so there is no circle and few rounds.
    """
    held = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if held.join(on, "root", "left_semi").isEmpty():
            return held
        held = cut(held.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, heavy: int = HEAVY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each word of the texts."""
    counted = cut(words(docs))
    near = neighbours(counted, heavy, shard_rows)
    is_form = F.col("near_n") >= RATIO * F.col("n")
    judged = cut(counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
checked AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':', ''), lambda x: CAST(unicode(x) AS BIGINT)) ||
  flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM each, tab),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM checked),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(near, {'m': -near_n, 'w': near}) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.last WHERE j.form IS NOT NULL),
ends AS (SELECT c.word, c.last AS root FROM chain c JOIN judged j ON j.word = c.last WHERE j.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)"""

"""Benchmark decontamination with an FM-index for every training shard.

A shard is a few megabytes of documents inside one task.  Only runs of words
that the benchmark knows, long enough to hold its shortest window, can contain
an occurrence; they form the shard's text, with a separator between runs.  Its
suffixes are sorted, the Burrows-Wheeler transform goes into a wavelet matrix,
and all windows are searched backward at once through its ranks.  Occurrences
are located by walking to sampled suffix positions, and their words merge into
removal spans.

Up to BLOCK_BYTES of benchmark text nothing is shuffled: every document is judged
where it is read.  A larger benchmark is read in blocks of no more bytes, larger
items in stretches that share all but one word of a window; each block takes a pass
over the unchanged texts, and the spans of all passes are merged for each row before
any is cut.  The driver holds one block at a time.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.
Null and empty texts have no words and no hits.  Items without words, and items
without an id, match nothing.  Rows with the same doc_id are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import cut, ship, table, unused

#: Words of a window.
WINDOW = 10
#: Benchmark text that is searched in one pass.
BLOCK_BYTES = 8 << 20
#: Every so many positions of a shard's text keep their place in the suffix array.
SAMPLE = 8
_ITEM_WORD = re.compile("[0-9A-Za-z\\x80-\\U0010FFFF]+")


@dataclass
class Phrases:
    """The windows of a block of items, as vocabulary symbols 1.. in rows padded by 0."""

    vocabulary: np.ndarray  # sorted word hashes
    symbols: np.ndarray  # phrase x position
    length: np.ndarray
    items: list[str]
    owner_at: np.ndarray  # for each phrase, its range in owner
    owner: np.ndarray  # indices into items

    @property
    def shortest(self) -> int:
        return int(self.length.min()) if len(self.length) else 0


def phrases_of(rows: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """The distinct windows of (item_id, text) rows."""
    rows = sorted({(str(i), t) for i, t in rows if i is not None and t})
    data, at = flat.buffers(pa.array([t for _, t in rows], pa.string()))
    data = flat.LOWER[data]
    starts, ends, first = flat.words(data, at, flat.ITEM_BYTES)
    h = flat.word_hashes(data, starts, ends)
    vocabulary, symbol = np.unique(h, return_inverse=True)
    items = sorted({i for i, _ in rows})
    number = {x: k for k, x in enumerate(items)}
    item = np.array([number[i] for i, _ in rows], np.int32)
    size = np.diff(first)
    many = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
    row = np.repeat(np.arange(len(rows)), many)
    begin = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    padded = np.concatenate([symbol.astype(np.int32) + 1, np.zeros(window, np.int32)])
    each = padded[begin[:, None] + np.arange(window)] * (np.arange(window) < np.minimum(size[row], window)[:, None]) if len(row) else np.zeros((0, window), np.int32)
    # rows as big-endian bytes are ordered like their symbols
    keys = np.ascontiguousarray(each.astype(">i4")).view(f"V{4 * window}").ravel()
    order = np.argsort(keys, kind="stable") if len(keys) else np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    symbols = each[order[new]]
    owners = np.unique(np.stack([np.cumsum(new) - 1, item[row[order]].astype(np.int64)], 1), axis=0) if len(order) else np.zeros((0, 2), np.int64)
    return Phrases(vocabulary, symbols, (symbols > 0).sum(1), items, np.searchsorted(owners[:, 0], np.arange(len(symbols) + 1)), owners[:, 1].astype(np.int32))


class WaveletMatrix:
    """Ranks of symbols in a sequence, one prefix-count array for each bit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            one = (sequence >> b) & 1
            ones = np.concatenate([[0], np.cumsum(one)])
            zeros = len(sequence) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            sequence = np.concatenate([sequence[one == 0], sequence[one == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before i; arrays of equal length."""
        low = np.zeros_like(i)
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - low


class FMIndex:
    """Over a text of symbols 1..; 0 separates runs and ends the text."""

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        gap = text == 0
        # separators are distinct and smaller than all symbols, so no match and no comparison runs past one
        rank = np.where(gap, np.cumsum(gap) - 1, text + int(gap.sum()))
        order = np.argsort(rank, kind="stable")
        rank = self._numbered(rank, order)
        known = 1  # leading symbols that the ranks take into account
        while rank[order[-1]] < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - known] = rank[known:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = self._numbered(key, order)
            known *= 2
        self.last = np.where(order == 0, 0, text[order - 1])  # the symbol before each suffix
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        self.tree = WaveletMatrix(self.last, max(1, int(size).bit_length()))
        # run starts are sampled too: a walk never steps over a separator
        kept = (order % SAMPLE == 0) | (self.last == 0)
        self.kept_before = np.cumsum(kept) - kept
        self.kept = kept
        self.places = order[kept]

    @staticmethod
    def _numbered(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Ranks 0.. of keys, equal keys alike."""
        sorted_key = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        return rank

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase, by backward search."""
        low = np.zeros(len(length), np.int64)
        high = np.full(len(length), self.before[-1])
        for j in range(symbols.shape[1] - 1, -1, -1):
            live = np.flatnonzero((j < length) & (low < high))
            if len(live):
                c = symbols[live, j]
                low[live] = self.before[c] + self.tree.rank(c, low[live])
                high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        row, place, walked = row.copy(), np.full(len(row), -1, np.int64), 0
        live = np.arange(len(row))
        while len(live):
            here = self.kept[row[live]]
            at = live[here]
            place[at] = self.places[self.kept_before[row[at]]] + walked
            live = live[~here]
            c = self.last[row[live]]
            row[live] = self.before[c] + self.tree.rank(c, row[live])
            walked += 1
        return place


def occurrences(symbol: np.ndarray, first: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word index) of every occurrence in the words of a shard; symbol is 0 for words that the benchmark lacks."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(symbol)
    if n == 0 or not len(p.length):
        return none
    known = symbol > 0
    begin, end = known.copy(), known.copy()
    begin[1:] &= ~known[:-1]
    end[:-1] &= ~known[1:]
    head = first[:-1][first[:-1] < first[1:]]
    begin[head] = known[head]
    tail = first[1:][first[:-1] < first[1:]] - 1
    end[tail] = known[tail]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= p.shortest
    a, b = a[long], b[long]
    if not len(a):
        return none
    size = b - a + 1  # and a separator
    base = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(base, size)
    place = np.repeat(a, size) + inner
    gap = inner == np.repeat(b - a, size)
    text = np.where(gap, 0, symbol[np.minimum(place, n - 1)])
    index = FMIndex(text, int(p.symbols.max()))
    low, high = index.search(p.symbols, p.length)
    hit = np.flatnonzero(high > low)
    count = (high - low)[hit]
    if not len(hit):
        return none
    rows = np.repeat(low[hit], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(hit, count), place[index.locate(rows)]


def _shards(p: Phrases, batches: Iterator[pa.RecordBatch]):
    """For each shard: the batch, its word bounds, first words, hit flags, and (document, item) pairs."""
    for batch in flat.steps(batches, "text"):
        data, at = flat.buffers(batch.column(batch.schema.get_field_index("text")))
        starts, ends, first = flat.words(flat.LOWER[data], at, flat.ITEM_BYTES)
        h = flat.word_hashes(flat.LOWER[data], starts, ends)
        if len(p.vocabulary):
            k = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
            symbol = np.where(p.vocabulary[k] == h, k + 1, 0)
        else:
            symbol = np.zeros(len(h), np.int64)
        phrase, word = occurrences(symbol, first, p)
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + p.length[phrase], -1)
        hit = np.cumsum(edge)[:-1] > 0
        pairs = np.zeros((0, 2), np.int64)
        if len(word):
            doc = np.searchsorted(first, word, "right") - 1
            seen = np.unique(np.stack([doc, phrase], 1), axis=0)
            many = p.owner_at[seen[:, 1] + 1] - p.owner_at[seen[:, 1]]
            own = np.repeat(p.owner_at[seen[:, 1]], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            pairs = np.unique(np.stack([np.repeat(seen[:, 0], many), p.owner[own]], 1), axis=0)
        yield batch, data, at, starts, ends, first, hit, pairs


def _spans(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end of each run of hit words, counted over the shard."""
    if not hit.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1]
    end[:-1] &= ~hit[1:]
    some = first[:-1] < first[1:]
    begin[first[:-1][some]] = hit[first[:-1][some]]
    end[first[1:][some] - 1] = hit[first[1:][some] - 1]
    a = np.flatnonzero(begin)
    return np.searchsorted(first, a, "right") - 1, a, np.flatnonzero(end) + 1


SCAN = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def _scan(p: Phrases):
    def run(batches):
        for batch, _, _, _, _, first, hit, pairs in _shards(p, batches):
            n = batch.num_rows
            doc, a, b = _spans(hit, first)
            cut = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            pair_cut = np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)
            names = pa.array([p.items[i] for i in pairs[:, 1]], pa.string())
            struct = pa.StructArray.from_arrays([pa.array(a - first[doc]), pa.array(b - first[doc])], ["start", "stop"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                    pa.array(np.diff(first)),
                    pa.ListArray.from_arrays(pa.array(cut), struct),
                    pa.ListArray.from_arrays(pa.array(pair_cut), names),
                ],
                ["doc_id", "n_words", "spans", "items"],
            )

    return run


def _without(batch: pa.RecordBatch, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The batch with the words a..b-1 of the shard cut from the texts doc, and n_chars counted anew."""
    if not len(doc):
        return batch
    k, size = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
    text = batch.column(k).to_pylist()
    for d in np.unique(doc):
        raw, left, out = text[d].encode(), 0, []
        base = int(at[d])
        for s in np.flatnonzero(doc == d):
            out.append(raw[left : int(starts[a[s]]) - base])
            left = int(ends[b[s] - 1]) - base
        text[d] = b"".join([*out, raw[left:]]).decode()
    columns = list(batch.columns)
    columns[k] = pa.array(text, batch.schema.field(k).type)
    if size >= 0:
        columns[size] = pa.array([None if t is None else len(t) for t in text], pa.int64()).cast(batch.schema.field(size).type)
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _clean(p: Phrases):
    def run(batches):
        for batch, _, at, starts, ends, first, hit, _ in _shards(p, batches):
            yield _without(batch, at, starts, ends, *_spans(hit, first))

    return run


def _cut_spans(row: str, spans: str):
    """The rows without the spans found before, and without the columns that name them."""

    def run(batches):
        for batch in flat.steps(batches, "text"):
            data, at = flat.buffers(batch.column(batch.schema.get_field_index("text")))
            starts, ends, first = flat.words(flat.LOWER[data], at, flat.ITEM_BYTES)
            found = [(d, first[d] + s["start"], first[d] + s["stop"]) for d, own in enumerate(batch.column(batch.schema.get_field_index(spans)).to_pylist()) for s in own or ()]
            doc, a, b = np.array(found, np.int64).reshape(-1, 3).T
            yield _without(batch.drop_columns([row, spans]), at, starts, ends, doc, a, b)

    return run


def _pieces(text: str, most: int, window: int) -> Iterator[str]:
    """The text, or, if it has more bytes than most, stretches of its words that share window - 1 words, so that every window is in one."""
    if len(text) <= most and len(text.encode()) <= most:
        yield text
        return
    held: list[str] = []
    size = fresh = 0
    for m in _ITEM_WORD.finditer(text):
        held.append(m[0])
        size += len(m[0].encode()) + 1
        fresh += 1
        if size >= most and len(held) >= window:
            yield " ".join(held)
            held = held[len(held) - window + 1 :]
            size, fresh = sum(len(w.encode()) + 1 for w in held), 0
    if fresh:
        yield " ".join(held)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[Phrases] | Iterator[Phrases]:
    """The phrases of the benchmark: a list of one block, or blocks of about block_bytes of text, one at a time."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= block_bytes:
        return [phrases_of([tuple(r) for r in items.collect()], window)]

    def each() -> Iterator[Phrases]:
        held, size = [], 0
        for r in items.toLocalIterator():
            for piece in _pieces(r["text"], block_bytes, window):
                n = len(piece.encode())
                if held and size + n > block_bytes:
                    yield phrases_of(held, window)
                    held, size = [], 0
                held.append((r["item_id"], piece))
                size += n
        if held:
            yield phrases_of(held, window)

    return each()


def _merged(found: list[DataFrame], *key: str) -> DataFrame:
    """The findings of several passes by key: (key, n_words, spans, items)."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    spans = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return every.groupBy(*key).agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _passes(rows: DataFrame, row: str, blocks: Iterator[Phrases]) -> DataFrame:
    """(doc_id, n_words, spans, items) by row, of all rows: every block in a pass of its own over the unchanged texts, only hits kept of all but the first."""
    slim = rows.select(F.col(row).alias("doc_id"), "text")
    found = []
    for p in blocks:
        one = slim.mapInArrow(_scan(p), SCAN)
        found.append(cut(one.where(F.size("spans") > 0) if found else one))
    return _merged(found, "doc_id")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans of hit words, items found) for every row."""
    ship(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    blocks = _blocks(benchmark, window, block_bytes)
    if isinstance(blocks, list):
        return slim.mapInArrow(_scan(blocks[0]), SCAN)
    rows = cut(slim.withColumn("row", F.monotonically_increasing_id()))  # numbered once
    found = _passes(rows, "row", blocks).withColumnRenamed("doc_id", "row")
    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id")).join(found, "row").select("doc_id", "n_words", "spans", "items")


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit words cut from text (and n_chars, if there, counted anew)."""
    ship(docs.sparkSession)
    blocks = _blocks(benchmark, window, block_bytes)
    if isinstance(blocks, list):
        return docs.mapInArrow(_clean(blocks[0]), docs.schema)
    row, spans = unused(docs.columns, "hit_row"), unused(docs.columns, "hit_spans")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))  # numbered once
    found = _passes(rows, row, blocks).where(F.size("spans") > 0).select(F.col("doc_id").alias(row), F.col("spans").alias(spans))
    return rows.join(found, row, "left").mapInArrow(_cut_spans(row, spans), docs.schema)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    h = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return h.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
ph AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i+9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM ph),
dw AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
occ AS (SELECT win.doc_id, win.i, win.k, ph.item_id FROM win JOIN ph ON win.p = ph.p AND win.k = ph.k),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

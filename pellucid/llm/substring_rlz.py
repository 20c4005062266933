"""Removal of repeated passages by relative Lempel-Ziv parsing.

Every document is factored against all reference blocks of the corpus.  A block
is cut by content: the windows of WINDOW words whose least ANCHOR-word hash is
the same one, so equal passages are cut alike wherever they stand, and a block
of at most 2 * WINDOW - ANCHOR + 1 words stands for its windows.  The index of
blocks is hash partitioned.  Its earliest occurrence is a block's reference; a
later occurrence is copied from it, and copies that follow each other in text
and reference are one factor, extended greedily.

At a factor's boundary a block differs as a whole but may still share windows
with others.  Those blocks (an anchor that is found in unlike blocks) are
checked window by window against an index of their windows, keyed by 128 bits.

Before anything is shuffled, a task resolves the repeats among its own
documents, so that a block, anchor or window has at most one entry for each
flush of a task.  A passage in a third of all documents is therefore no hot key.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Null and empty texts have no words.
A document is a doc_id and a text: rows equal in both get the same result, rows
that share an id (or have none) but not the text are documents of their own, in
the order of a hash of their texts.  A null id comes before all others.  A text of
fewer than WINDOW words loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import cut, parts, ship, table

WINDOW = 20
ANCHOR = 8
#: Blocks that a task holds before it resolves and sends them.
FLUSH = 1_000_000
NO_ID = -(2**63)
#: What tells a document from another: its id and its text.
KEY = ["doc_key", "text_key"]

I32, I64 = np.int32, np.int64
ROW = "kind int, part int, a binary, b binary, doc binary, row binary, lo binary, n binary, ref binary, at binary"
COLUMNS = ("a", "b", "doc", "row", "lo", "n", "ref", "at")
TYPES = {"a": flat.U64, "b": flat.U64, "doc": I64, "row": I64, "lo": I32, "n": I32, "ref": I64, "at": I32}
#: Kinds of rows: entries of an index, ranges of windows still to be checked, factors.
ENTRY, OPEN, FACTOR = 0, 1, 2
#: In n of an entry: its anchor has unlike blocks.
MANY = 0


def _part_of(x: np.ndarray, n: int) -> np.ndarray:
    return (flat.mix(x.astype(flat.U64)) % flat.U64(n)).astype(I64)


def _rows(kind: int, part: np.ndarray, n: int, columns: dict[str, np.ndarray]) -> list[dict]:
    columns = {k: v.astype(TYPES[k]) for k, v in columns.items()}
    return [{"kind": kind} | r for r in flat.spread(part, n, columns)] if len(part) else []


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in COLUMNS)])
    return pa.RecordBatch.from_pylist(rows, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[str, np.ndarray]]:
    """The rows of a partition by kind, each column in one array."""
    held: dict[int, dict[str, list[bytes]]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            mine = held.setdefault(r["kind"], {c: [] for c in COLUMNS})
            for c in COLUMNS:
                mine[c].append(r[c] or b"")
    return {k: {c: np.frombuffer(b"".join(x), TYPES[c]) for c, x in m.items()} for k, m in held.items()}


def _part_of_doc(doc: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return _part_of(doc.astype(flat.U64) ^ flat.mix(row.astype(flat.U64)), n)


def _runs(doc, row, lo, n, ref=None, at=None):
    """Ranges of windows sorted and joined where one goes on from the other, in the reference too."""
    order = np.lexsort((lo, row, doc))
    doc, row, lo, n = doc[order], row[order], lo[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
    if ref is not None:
        ref, at = ref[order], at[order]
        new[1:] |= (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + n[:-1])
    first = np.flatnonzero(new)
    n = np.add.reduceat(n, first) if len(first) else n
    return (doc[first], row[first], lo[first], n) + ((ref[first], at[first]) if ref is not None else ())


def _out(doc, row, lo, n, ref, at, open_, copied, parts_: int) -> list[dict]:
    """Rows for the documents' parts: open ranges and factors."""
    rows = []
    if open_.any():
        d, k, s, m = _runs(doc[open_], row[open_], lo[open_], n[open_])
        rows += _rows(OPEN, _part_of_doc(d, k, parts_), parts_, {"doc": d, "row": k, "lo": s, "n": m})
    if copied.any():
        d, k, s, m, r, t = _runs(doc[copied], row[copied], lo[copied], n[copied], ref, at)
        rows += _rows(FACTOR, _part_of_doc(d, k, parts_), parts_, {"doc": d, "row": k, "lo": s, "n": m, "ref": r, "at": t})
    return rows


def _resolve(a, b, doc, row, lo):
    """Order by key and place; first: is it the earliest of (a, b); rep: index of that one; new_a: does a new a begin; copied: is it a later one elsewhere."""
    order = np.lexsort((lo, row, doc, b, a))
    a, b, doc, row, lo = a[order], b[order], doc[order], row[order], lo[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    first = new_a.copy()
    first[1:] |= b[1:] != b[:-1]
    rep = np.flatnonzero(first)[np.cumsum(first) - 1]
    copied = ~first & ((doc != doc[rep]) | (row != row[rep]) | (lo != lo[rep]))
    return order, first, rep, new_a, copied


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(I64) for c in KEY)


def blocks(h: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """Anchor hash, content hash, document, first window and number of windows of every block."""
    n = len(h)
    ok = flat.whole_windows(first, window, n)
    g = flat.grams(h, anchor, 1)
    least = flat.sliding_argmin(g, window - anchor + 1)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        z = np.zeros(0, I64)
        return z.astype(flat.U64), z.astype(flat.U64), z, z, z
    stop = np.append(start[1:], len(ok))
    closed = np.cumsum(ok)
    count = closed[stop - 1] - closed[start] + 1
    base = flat.powers(flat._GRAM + 4 | 1, n + 1)
    back = flat.powers(pow(flat._GRAM + 4 | 1, -1, 2**64), n + 1)
    total = np.concatenate([np.zeros(1, flat.U64), np.cumsum(h * base[:n])])
    content = (total[start + count + window - 1] - total[start]) * back[start]
    shape = (count * window + least[start] - start).astype(flat.U64)
    doc = np.searchsorted(first, start, "right") - 1
    return g[least[start]], flat.mix(content ^ flat.mix(shape + flat.U64(7))), doc, start - first[doc], count


def _index(window: int, anchor: int, parts_: int):
    def flush(held):
        a, b, doc, row, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first, rep, new_a, copied = _resolve(a, b, doc, row, lo)
        a, b, doc, row, lo, n = a[order], b[order], doc[order], row[order], lo[order], n[order]
        group = np.cumsum(new_a) - 1
        many = np.bincount(group, first)[group] > 1
        rows = _out(doc, row, lo, n, doc[rep][copied], lo[rep][copied], first & many, copied, parts_)
        sent = (first & ~many) | (new_a & many)
        n = np.where(many, MANY, n)
        rows += _rows(ENTRY, _part_of(a[sent], parts_), parts_, {"a": a[sent], "b": b[sent], "doc": doc[sent], "row": row[sent], "lo": lo[sent], "n": n[sent]})
        return _batch(rows)

    def run(batches):
        held, size = [], 0
        for batch in flat.steps(batches, "text"):
            data, at = flat.buffers(batch.column(batch.schema.get_field_index("text")))
            starts, ends, first = flat.words(data, at, flat.WORD_BYTES)
            if len(starts) < window:
                continue
            a, b, doc, lo, n = blocks(flat.word_hashes(data, starts, ends), first, window, anchor)
            if len(a):
                held.append((a, b, *(x[doc] for x in _ids(batch)), lo, n))
                size += len(a)
            if size > FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _match_blocks(parts_: int):
    """Entries of blocks against each other; rows of other kinds go on as they are."""

    def run(batches):
        kept: list[pa.RecordBatch] = []

        def entries():
            for batch in batches:
                kind = batch.column(0).to_numpy()
                on = batch.filter(pa.array(kind != ENTRY))
                if on.num_rows:
                    kept.append(on)
                yield batch.filter(pa.array(kind == ENTRY))

        held = _read(entries()).get(ENTRY)
        yield from kept
        if held is None:
            return
        order, first, rep, new_a, copied = _resolve(held["a"], np.where(held["n"] == MANY, flat.U64(0), held["b"]), held["doc"], held["row"], held["lo"])
        doc, row, lo, n = (held[c][order] for c in ("doc", "row", "lo", "n"))
        group = np.cumsum(new_a) - 1
        flag = n == MANY
        many = (np.bincount(group, first & ~flag)[group] > 1) | (np.bincount(group, flag)[group] > 0)
        copied &= ~flag
        rows = _out(doc, row, lo, n, doc[rep][copied], lo[rep][copied], first & many & ~flag, copied, parts_)
        if rows:
            yield _batch(rows)

    return run


def _match_windows(parts_: int):
    def run(batches):
        held = _read(batches)
        rows = []
        if (f := held.get(FACTOR)) is not None:
            rows += _rows(FACTOR, _part_of_doc(f["doc"], f["row"], parts_), parts_, {c: f[c] for c in ("doc", "row", "lo", "n", "ref", "at")})
        if (e := held.get(ENTRY)) is not None:
            order, _, rep, _, copied = _resolve(e["a"], e["b"], e["doc"], e["row"], e["lo"])
            doc, row, lo, n = (e[c][order] for c in ("doc", "row", "lo", "n"))
            rows += _out(doc, row, lo, n, doc[rep][copied], lo[rep][copied], np.zeros(len(doc), bool), copied, parts_)
        if rows:
            yield _batch(rows)

    return run


BY_DOC = "doc_key long, text_key long, open binary, factors binary"


def _by_doc(batches):
    """One row for each document of a partition: its open ranges (lo, n) and factors (lo, n, ref, at), as 64-bit integers."""
    held = _read(batches)
    out: dict[tuple[int, int], list[bytes | None]] = {}
    for k, kind, columns in ((0, OPEN, ("lo", "n")), (1, FACTOR, ("lo", "n", "ref", "at"))):
        if (x := held.get(kind)) is None:
            continue
        order = np.lexsort((x["lo"], x["row"], x["doc"]))
        doc, row = x["doc"][order], x["row"][order]
        table_ = np.stack([x[c][order].astype(I64) for c in columns], 1)
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
        for d, s, e in zip(zip(doc[at].tolist(), row[at].tolist(), strict=True), at, [*at[1:], len(doc)], strict=True):
            out.setdefault(d, [None, None])[k] = table_[s:e].tobytes()
    keys = list(out)
    for s in range(0, len(keys), 10_000):
        some = keys[s : s + 10_000]
        keys_ = [pa.array([d[k] for d in some], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*keys_, pa.array([out[d][0] for d in some], pa.binary()), pa.array([out[d][1] for d in some], pa.binary())], [*KEY, "open", "factors"])


def _windows(window: int, parts_: int):
    """The windows in open ranges, resolved within the task, as entries of the index of windows."""
    p1, p2 = (flat.powers(flat._GRAM + s | 1, window) for s in (8, 16))

    def flush(held):
        a, b, doc, row, lo = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first, rep, _, copied = _resolve(a, b, doc, row, lo)
        a, b, doc, row, lo = a[order], b[order], doc[order], row[order], lo[order]
        one = np.ones(len(a), I64)
        rows = _out(doc, row, lo, one, doc[rep][copied], lo[rep][copied], np.zeros(len(a), bool), copied, parts_)
        rows += _rows(ENTRY, _part_of(a[first], parts_), parts_, {"a": a[first], "b": b[first], "doc": doc[first], "row": row[first], "lo": lo[first], "n": one[first]})
        return _batch(rows)

    def run(batches):
        held, size = [], 0
        for batch in flat.steps(batches, "text"):
            data, at = flat.buffers(batch.column(batch.schema.get_field_index("text")))
            starts, ends, first = flat.words(data, at, flat.WORD_BYTES)
            h = flat.word_hashes(data, starts, ends)
            ids, places, docs = _ids(batch), [], []
            for k, raw in enumerate(batch.column(batch.schema.get_field_index("open")).to_pylist()):
                ranges = np.frombuffer(raw, I64).reshape(-1, 2)
                inner = np.concatenate([np.arange(s, s + m) for s, m in ranges])
                places.append(inner + first[k])
                docs.append(np.full(len(inner), k))
            place, doc = np.concatenate(places), np.concatenate(docs)
            place, doc = place[place + window <= len(h)], doc[place + window <= len(h)]
            for s in range(0, len(place), 200_000):
                some, own = place[s : s + 200_000], doc[s : s + 200_000]
                seen = h[some[:, None] + np.arange(window)]
                held.append((flat.mix((seen * p1).sum(1, dtype=flat.U64)), flat.mix((seen * p2).sum(1, dtype=flat.U64)), *(x[own] for x in ids), some - first[own]))
                size += len(some)
            if size > FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:long,length:long,ref_doc:long,ref_start:long>>"


def _cut_out(window: int):
    fields = ("start", "length", "ref_doc", "ref_start")

    def run(batches):
        for batch in flat.steps(batches, "text"):
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = {"doc_id": col["doc_id"], "n_words": [], "n_removed": [], "kept_text": [], "factors": []}
            for text, found in zip(col["text"], col["factors"], strict=True):
                words = (text or "").encode().split()
                ranges = np.frombuffer(b"".join(found or ()), I64).reshape(-1, 4)
                n, gone, factors = len(words), 0, []
                if len(ranges):
                    lo, m, ref, at = (c for c in ranges.T)
                    zero = np.zeros(len(lo), I64)
                    _, _, lo, m, ref, at = _runs(zero, zero, lo, m, ref, at)
                    edge = np.zeros(n + 1, I64)
                    np.add.at(edge, np.minimum(lo, n), 1)
                    np.add.at(edge, np.minimum(lo + m + window - 1, n), -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    gone = int(n - keep.sum())
                    words = [words[i] for i in np.flatnonzero(keep)]
                    factors = [dict(zip(fields, x, strict=True)) for x in zip(lo.tolist(), (m + window - 1).tolist(), ref.tolist(), at.tolist(), strict=True)]
                out["n_words"].append(n)
                out["n_removed"].append(gone)
                out["kept_text"].append(b" ".join(words).decode())
                out["factors"].append(factors)
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in fields]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string()), pa.array(out["factors"], kind)],
                list(out),
            )

    return run


def repeats_removed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, factors): every document without the words of windows that start earlier too."""
    spark = docs.sparkSession
    ship(spark)
    n = parts(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(n, F.col("part"))

    indexed = dealt(docs.select(*KEY, "text").mapInArrow(_index(window, anchor, n), ROW))
    first = cut(dealt(indexed.mapInArrow(_match_blocks(n), ROW)).mapInArrow(_by_doc, BY_DOC))
    some = docs.select(*KEY, "text").join(first.where("open is not null").select(*KEY, "open").hint("shuffle_hash"), KEY)
    checked = dealt(some.mapInArrow(_windows(window, n), ROW))
    second = cut(dealt(checked.mapInArrow(_match_windows(n), ROW)).mapInArrow(_by_doc, BY_DOC))
    factors = first.unionByName(second).where("factors is not null").groupBy(*KEY).agg(F.collect_list("factors").alias("factors"))
    every = docs.join(factors.hint("shuffle_hash"), KEY, "left").select("doc_id", "text", "factors")
    return every.mapInArrow(_cut_out(window), KEPT)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = repeats_removed(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20))),
gone AS (SELECT doc_id, list(DISTINCT x) AS x FROM (SELECT doc_id, unnest(range(i, i + 20)) AS x FROM win WHERE k > 1) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM w),
gone_word AS (SELECT doc_id, unnest(x) AS i FROM gone),
kept AS (SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone_word USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is CHUNKS * CODES codes of BITS bits, each from its own
permutation of the shingles, so two documents differ in a code with probability
1 - J.  The distance is the number of codes that differ.  With CHUNKS chunks,
two signatures at most DISTANCE = CHUNKS * (ERRORS + 1) - 1 codes apart have, by
pigeonhole, a chunk with at most ERRORS errors; every chunk is therefore indexed
under all its patterns with ERRORS codes left out, and no pair within DISTANCE is
missed.  Pairs farther apart that share a pattern go on up to reach(per_cent), so
a pair at the threshold is lost only if every chunk has two errors: with
probability 2e-8 at J = 0.85 and 1.1e-6 at J = 0.8.

1. Documents with equal shingle sets are one class; only classes go on.
2. Classes that share a pattern form a bucket.  A bucket of up to BUCKET_BLOCK is
   one cell; a larger one is cut into blocks, and its hub (one member) joins every
   block.  A cell yields a spanning forest of its pairs within the reach.  Members
   that no chain in their block ties to the hub are the rest of the bucket; only
   the rest meets the other blocks, in a second pass.  What hangs from the hub is
   one component already, so rows grow with the members, not with their pairs.
3. Connected components of these edges hold all possible links.  Each is cut the
   same way, by shingles; a cell compares full sets and yields a spanning forest
   of the true links (100 * common >= per_cent * all).
4. Connected components of the links are the groups.

Nothing is gathered on the driver; a task holds few cells at a time.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.  A text of fewer than five
words is one shingle; a null or empty one has none and links with nothing.  Rows
that share a doc_id, or have none, are judged by their own texts; a null id counts
as the smallest and stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import flat
from .common import cut, parts, ship, table

SHINGLE = 5
CHUNKS, CODES, BITS, ERRORS = 8, 4, 16, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Links need PER_CENT * union <= 100 * intersection.
PER_CENT = 85
#: The distance test may lose a pair at the threshold with this probability at most; the patterns lose more.
LOSS = 1e-9
#: Members in a block of a bucket.
BUCKET_BLOCK = 4096
#: Shingles in a block of a group.
GROUP_BLOCK = 1 << 20
#: Bytes of cells that a task compares together.
HELD_BYTES = 16 << 20
#: Up to so many cut groups (counted) are broadcast where a member looks for its group's number of blocks.
FEW = 100_000
NO_ID = -(2**63)

_rng = np.random.default_rng(31)
_XOR = _rng.integers(0, 2**63, CHUNKS * CODES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, CHUNKS * CODES, dtype=np.uint64) | flat.U64(1)
_SEED = {k: 40 + k for k in range(1, SHINGLE + 1)}
GROUPS = [f"g{c}" for c in range(CHUNKS)]
#: What tells a document from another: its id and its text.
KEY = ["doc_key", "text_key"]


def reach(per_cent: int) -> int:
    """The least number of differing codes that a pair of that similarity exceeds with probability LOSS at most."""
    n, differ = CHUNKS * CODES, 1 - per_cent / 100
    tail = 0.0
    for d in range(n, 0, -1):
        tail += comb(n, d) * differ**d * (1 - differ) ** (n - d)
        if tail > LOSS:
            return d
    return 0


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of each text, sorted, and the n+1 bounds."""
    data, at = flat.buffers(column)
    data = flat.LOWER[data]
    starts, ends, first = flat.words(data, at, flat.WORD_BYTES)
    h = flat.word_hashes(data, starts, ends)
    size = np.diff(first)
    by_length = {k: flat.grams(h, k, 40 + k) for k in range(1, shingle + 1) if k == shingle or (size == k).any()}
    sets = []
    for s, n in zip(first[:-1].tolist(), size.tolist(), strict=True):
        if n >= shingle:
            x = np.sort(by_length[shingle][s : s + n - shingle + 1])
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            sets.append(by_length[n][s : s + 1] if n else h[:0])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else h[:0], bounds


SIGNED = "doc_key long, text_key long, n_shingles long, s1 long, s2 long, " + ", ".join(f"{g} long" for g in GROUPS)


def _sums(u: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    n = np.diff(bounds)
    out = []
    for x in (u, flat.mix(u)):
        s = np.zeros(len(n), flat.U64)
        if (n > 0).any():
            s[n > 0] = np.add.reduceat(x, bounds[:-1][n > 0])
        out.append(s.view(np.int64))
    return out


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in flat.steps(batches, "text"):
            u, bounds = shingle_sets(batch.column(batch.schema.get_field_index("text")), shingle)
            n = np.diff(bounds)
            some = n > 0
            at = bounds[:-1][some]
            groups = []
            for c in range(CHUNKS):
                packed = np.zeros(len(n), flat.U64)
                for k in range(CODES):
                    j = c * CODES + k
                    if len(at):
                        least = np.minimum.reduceat((u ^ _XOR[j]) * _MUL[j], at)
                        packed[some] |= (flat.mix(least) & flat.U64((1 << BITS) - 1)) << flat.U64(BITS * k)
                groups.append(packed.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in KEY), pa.array(n), *map(pa.array, _sums(u, bounds)), *map(pa.array, groups)],
                [*KEY, "n_shingles", "s1", "s2", *GROUPS],
            )

    return run


def _patterns() -> Column:
    """The patterns of a class: every chunk with each of its codes left out."""
    every = []
    for c, g in enumerate(GROUPS):
        for k in range(CODES):
            mask = 2**64 - 1 - (((1 << BITS) - 1) << (BITS * k))
            left = F.col(g).bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask).cast("long"))
            every.append(F.xxhash64(F.lit(c * CODES + k), left))
    return F.array(*every)


def _forest(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of a graph over 0..n-1; near(i, others) says which of others are linked to i."""
    left = np.arange(n)
    edges = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            edges += [(i, int(j)) for j in found]
            queue += found.tolist()
            left = left[~hit]
    return edges


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges as stars: (least node, other node), one edge fewer than nodes."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(node))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(node)))
    return node[label[other]], node[other]


CELL = "cell long, rep long, hot long, is_hub boolean"


def _placed(members: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Members (group, rep, weight) with the number of blocks of their group and their own, from (group, size, hub)."""
    blocks = F.ceil(F.col("size") / most).cast("int").alias("blocks")
    rows = members.join(sizes.select("group", blocks, "hub"), "group")
    return rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int"))


def _first_cells(placed: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """CELL rows of the first pass: every block, and with it the hub where a group has more than one."""
    hot = F.when(F.col("blocks") > 1, F.col("group")).alias("hot")
    own = placed.select(F.xxhash64("group", "block").alias("cell"), "rep", hot, (F.col("rep") == F.col("hub")).alias("is_hub"))
    many = sizes.where(F.col("size") > most).select("group", F.ceil(F.col("size") / most).cast("int").alias("blocks"), F.col("hub").alias("rep"))
    hubs = many.select("group", "rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return own.unionByName(hubs.select(F.xxhash64("group", "block").alias("cell"), "rep", F.col("group").alias("hot"), F.lit(True).alias("is_hub")))


def _second_cells(placed: DataFrame, rest: DataFrame, most: int) -> DataFrame:
    """CELL rows of the second pass: blocks of the rest (group, rep) with all blocks of their groups."""
    mine = placed.join(rest, ["group", "rep"])
    sizes = cut(mine.groupBy("group").agg(F.ceil(F.sum("weight") / most).cast("int").alias("rests")))
    sizes = F.broadcast(sizes) if sizes.limit(FEW + 1).count() <= FEW else sizes
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = placed.join(sizes, "group").select("group", "rep", "block", to("rests").alias("other"))
    own = mine.join(sizes, "group").select("group", "rep", to("blocks").alias("block"), F.pmod(F.xxhash64("rep", F.lit(6)), F.col("rests")).cast("int").alias("other"))
    return every.unionByName(own).select(F.xxhash64("group", "block", "other").alias("cell"), "rep", F.lit(None).cast("long").alias("hot"), F.lit(False).alias("is_hub"))


def _compared(placed: DataFrame, sizes: DataFrame, most: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The edges (a, b) that compare finds in cells: in blocks with their hubs, then of the rest with all blocks.

    compare makes rows (a, b, hot) of CELL rows: edges, and with hot a member a of that group's rest.
    """
    first = cut(compare(_first_cells(placed, sizes, most)))
    edges = first.where("hot is null").select("a", "b")
    rest = first.where("hot is not null").select(F.col("hot").alias("group"), F.col("a").alias("rep")).distinct()
    if rest.isEmpty():
        return edges
    more = compare(_second_cells(placed, cut(rest), most))
    return edges.unionByName(more.select("a", "b"))


FOUND = "a long, b long, hot long"


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell, in tables of whole cells; a member that is there twice counts once."""

    def once(t: pa.Table) -> pa.Table:
        cell, rep = t["cell"].to_numpy(), t["rep"].to_numpy()
        order = np.lexsort((rep, cell))
        new = np.concatenate([[True], (cell[order][1:] != cell[order][:-1]) | (rep[order][1:] != rep[order][:-1])])
        return t.take(pa.array(order[new])).combine_chunks()

    held, size, most = [], 0, HELD_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cell = t["cell"].to_numpy()
        last = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
        if last:
            yield once(t.slice(0, last))
        t = t.slice(last)
        held, size = t.to_batches(), t.nbytes
        most = max(HELD_BYTES, 2 * size)
    if held:
        yield once(pa.Table.from_batches(held))


def _results(t: pa.Table, first: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """FOUND rows of a table of whole cells, from the edges found in them, as row numbers."""
    rep, is_hub, hot = t["rep"].to_numpy(), t["is_hub"].to_numpy(zero_copy_only=False), t["hot"].to_numpy(zero_copy_only=False)
    x, y = (np.concatenate([e[k] for e in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    cut_ = ~np.isnan(hot.astype(float))[first] if t["hot"].null_count else np.ones(len(first), bool)
    if cut_.any():
        root, node = stars(x, y) if len(x) else (x, y)
        label = np.arange(len(rep))
        label[node] = root
        raw = t["hot"].combine_chunks()
        for f, e in zip(first[cut_], np.append(first[1:], len(rep))[cut_], strict=True):
            hub = f + int(np.argmax(is_hub[f:e]))
            own = rep[f:e][label[f:e] != label[hub]]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(np.full(len(own), raw[int(f)].as_py()))], ["a", "b", "hot"])
    if len(x):
        a, b = stars(rep[x], rep[y])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "hot"])


def _firsts(t: pa.Table) -> np.ndarray:
    cell = t["cell"].to_numpy()
    return np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))


def _candidates(distance: int):
    """For every cell, a spanning forest of the pairs within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            codes = np.stack([t[g].to_numpy() for g in GROUPS], 1).view(np.uint16).reshape(t.num_rows, CHUNKS * CODES)
            first = _firsts(t)
            size = np.diff(np.append(first, t.num_rows))
            two = first[size == 2]
            ok = (codes[two] != codes[two + 1]).sum(1) <= distance
            out = [(two[ok], two[ok] + 1)]
            for f, n in zip(first[size > 2], size[size > 2], strict=True):
                mine = codes[f : f + n]
                found = _forest(int(n), lambda i, others, mine=mine: (mine[others] != mine[i]).sum(1) <= distance)
                if found:
                    e = np.array(found) + f
                    out.append((e[:, 0], e[:, 1]))
            yield from _results(t, first, out)

    return run


def _sets(shingle: int):
    """CELL rows with the shingle sets of their classes, from texts; a text of another class with the same key is left out."""

    def run(batches):
        names = [*(c.split()[0] for c in CELL.split(", ")), "shingles"]
        for batch in flat.steps(batches, "text"):
            u, bounds = shingle_sets(batch.column(batch.schema.get_field_index("text")), shingle)
            s1, s2 = _sums(u, bounds)
            same = (s1 == batch.column(batch.schema.get_field_index("s1")).to_numpy()) & (s2 == batch.column(batch.schema.get_field_index("s2")).to_numpy())
            rows = np.flatnonzero(same)
            cells = batch.column(batch.schema.get_field_index("cells")).to_pylist()
            out, held = [], 0
            for k in rows:
                x = u[bounds[k] : bounds[k + 1]].tobytes()
                for c in cells[k]:
                    out.append(c | {"shingles": x})
                    held += len(x)
                    if held > HELD_BYTES:
                        yield pa.RecordBatch.from_pylist(out, _SET_ROWS)
                        out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, _SET_ROWS).select(names)

    return run


_SET_ROWS = pa.schema([("cell", pa.int64()), ("rep", pa.int64()), ("hot", pa.int64()), ("is_hub", pa.bool_()), ("shingles", pa.binary())])


def linked_forest(sets: list[np.ndarray], per_cent: int = PER_CENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between full sets (sorted, distinct).

    A member is compared with those not reached yet, through the postings of its
    shingles or through their sets, whichever is less.
    """
    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    bounds = np.concatenate([[0], np.cumsum(size)])
    member = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    new = np.concatenate([[True], np.diff(every[order]) != 0])[: len(every)]
    term = np.empty(len(every), np.int64)
    term[order] = np.cumsum(new) - 1
    posted = member[order]
    cut_ = np.append(np.flatnonzero(new), len(every))
    mark = np.zeros(len(cut_), bool)

    def spans(at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(at - np.cumsum(count) + count, count) + np.arange(int(count.sum()))

    def near(i: int, others: np.ndarray) -> np.ndarray:
        t = term[bounds[i] : bounds[i + 1]]
        count = cut_[t + 1] - cut_[t]
        if count.sum() <= size[others].sum():
            common = np.bincount(posted[spans(cut_[t], count)], minlength=len(sets))[others]
        else:
            mark[t] = True
            there = np.concatenate([[0], np.cumsum(mark[term[spans(bounds[others], size[others])]])])
            stop = np.cumsum(size[others])
            common = there[stop] - there[stop - size[others]]
            mark[t] = False
        return 100 * common >= per_cent * (size[i] + size[others] - common)

    return _forest(len(sets), near)


def _links(per_cent: int):
    def run(batches):
        for t in _whole_cells(batches):
            first = _firsts(t)
            raw = t["shingles"].combine_chunks()
            out = []
            for f, e in zip(first, np.append(first[1:], t.num_rows), strict=True):
                found = linked_forest([np.frombuffer(raw[int(k)].as_py(), flat.U64) for k in range(f, e)], per_cent)
                if found:
                    x = np.array(found) + f
                    out.append((x[:, 0], x[:, 1]))
            yield from _results(t, first, out)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY: the id, and a hash of the text that tells apart rows with the same id."""
    return docs.withColumns({"doc_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text_key": F.xxhash64(F.coalesce("text", F.lit("")))})


def _grouped(docs: DataFrame, per_cent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (KEY, n_shingles, s1, s2) of all documents, and classes (n_shingles, s1, s2, component_key, keeper) of those with words.

    component_key is the least doc_key of the group, keeper the KEY of the document that stays.
    """
    spark = docs.sparkSession
    ship(spark)
    n = parts(spark)
    texts = _keyed(docs.select("doc_id", "text")).select(*KEY, "text")
    signed = cut(texts.mapInArrow(_sign(shingle), SIGNED))
    one = ["n_shingles", "s1", "s2"]
    classes = signed.where("n_shingles > 0").groupBy(*one).agg(F.min(F.struct(*KEY)).alias("of"), *(F.min(g).alias(g) for g in GROUPS))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))

    entries = classes.select(F.explode(_patterns()).alias("group"), "rep", F.lit(1).alias("weight"))
    buckets = cut(entries.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub")).where("size > 1"))
    distance = reach(per_cent)

    def near(cells: DataFrame) -> DataFrame:
        rows = cells.join(classes.select("rep", *GROUPS), "rep").select("cell", "rep", "hot", "is_hub", *GROUPS)
        return rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_candidates(distance), FOUND)

    label = cut(components(_compared(_placed(entries, buckets, BUCKET_BLOCK), buckets, BUCKET_BLOCK, near), one_task=0))

    members = cut(label.join(classes.select("rep", "of", "s1", "s2", F.col("n_shingles").alias("weight")), F.col("node") == F.col("rep")).select(F.col("label").alias("group"), "rep", "of", "s1", "s2", "weight"))
    sizes = cut(members.groupBy("group").agg(F.sum("weight").alias("size"), F.min("rep").alias("hub")))

    def linked(cells: DataFrame) -> DataFrame:
        mine = cells.groupBy("rep").agg(F.collect_list(F.struct("cell", "rep", "hot", "is_hub")).alias("cells")).join(members.select("rep", "of.*", "s1", "s2"), "rep").drop("rep")
        rows = texts.join(mine.hint("shuffle_hash"), KEY).select("text", "s1", "s2", "cells").mapInArrow(_sets(shingle), CELL + ", shingles binary")
        return rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_links(per_cent), FOUND)

    links = _compared(_placed(members.select("group", "rep", "weight"), sizes, GROUP_BLOCK), sizes, GROUP_BLOCK, linked)
    final = components(links, one_task=0)
    named = classes.select(*one, "of", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = cut(named.select(*one, "of", "label"))
    keepers = named.groupBy("label").agg(F.min("of").alias("keeper"))
    return signed.select(*KEY, *one), named.join(keepers, "label").select(*one, F.col("keeper.doc_key").alias("component_key"), "keeper")


def groups(docs: DataFrame, per_cent: int = PER_CENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    rows, classes = _grouped(docs, per_cent, shingle)
    one = ["n_shingles", "s1", "s2"]
    linked = rows.where("n_shingles > 0").join(classes.drop("keeper"), one).select("doc_key", "n_shingles", "component_key")
    every = linked.unionByName(rows.where("n_shingles = 0").select("doc_key", "n_shingles", F.col("doc_key").alias("component_key")))
    none = F.lit(NO_ID)
    return every.select(
        F.nullif("doc_key", none).alias("doc_id"),
        "n_shingles",
        F.nullif("component_key", none).alias("component_id"),
        (F.col("doc_key") == F.col("component_key")).alias("kept"),
    )


def kept_documents(docs: DataFrame, per_cent: int = PER_CENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay: of each group one, that of least doc_id; rows without words all stay.

    Of rows with the same id in a group, the one of least text hash stays; of rows equal in id and text, any one.
    """
    rows, classes = _grouped(docs, per_cent, shingle)
    worded = cut(classes.select("keeper.*").distinct().join(rows.where("n_shingles > 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), KEY))
    empty = rows.where("n_shingles = 0").select(*KEY).distinct()
    keyed = _keyed(docs.withColumns({f"_own_{c}": F.col(c) for c in KEY if c in docs.columns})) if set(KEY) & set(docs.columns) else _keyed(docs)
    names = [F.col(f"_own_{c}").alias(c) if c in KEY else F.col(c) for c in docs.columns]
    stay = worded.where("n = 1").select(*KEY).unionByName(empty)
    alone = keyed.join(stay, KEY, "left_semi").select(*names)
    if worded.where("n > 1").isEmpty():
        return alone
    # one of each, with partial results before the shuffle
    again = keyed.join(worded.where("n > 1").select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.first(F.struct(*names)).alias("row"))
    return alone.unionByName(again.select("row.*"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.id AS component_id, w.doc_id = c.id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS id FROM r GROUP BY a) c USING (doc_id)
"""

"""The most similar vectors of many queries at once, exact, by cells with radius bounds.

Vectors are dealt to the nearest of a bounded number of centres, and around each to rings of
doubling distance, so that a few far ones don't widen a close cell.  For a vector x of a cell
with centre c and radius R a query's product q.x is at most q.c + |q| R.  Every query first goes to the
cells of greatest bounds until these hold enough vectors; the k-th best product found there is a
floor, and in a second round the query goes to all other cells whose bound reaches it.  So
nothing is missed, and where bounds are tight most cells are never looked at.

Queries and vectors are shuffled by cell; large cells are cut into blocks on both sides, so a task
holds two blocks whatever the size of a cell.  The driver holds the centres and a row for each cell,
never queries or vectors.  Only vectors as wide as the query count.  Products are sums in one fixed order, so equal
vectors have equal products wherever they lie; equal products are in the order of paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .graph import cut

#: Vectors of a centre, about; most centres, and most numbers of all vectors tried as centres.
CELL_ROWS, MOST_CELLS, MOST_NUMBERS = 2048, 1024, 4 << 20
#: Vectors looked at for each centre, and rings of a centre: two for each doubling of the distance.
TRIED, RINGS = 8, 128
#: Vectors and queries of a block.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048
#: Relative room for rounding in bounds and in the first choice of candidates.
SLACK = 1e-6
FOUND = "query string, path string, similarity double"


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, matrix) of the vectors of each width; nulls are left out."""
    width = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for w in np.unique(width[width >= 0]).tolist():
        rows = np.flatnonzero(width == w)
        yield w, rows, np.asarray(column.take(pa.array(rows)).flatten(), np.float32).reshape(len(rows), w).astype(np.float64)


def _centres(vectors: DataFrame, n: int, cell_rows: int) -> dict[int, np.ndarray]:
    """Centres by width, each the vector farthest from those before, of a bounded set: those whose paths have the least hashes.

    So any order of rows gives the same centres.
    """
    k = max(1, min(MOST_CELLS, -(-n // cell_rows)))
    first = vectors.select("path", "embedding").orderBy(F.xxhash64("path"), "path")
    held: dict[int, list] = {}
    room, tried = MOST_NUMBERS, 0
    for r in first.limit(TRIED * k).toLocalIterator():
        room -= len(r["embedding"])
        if room < 0:
            break
        if r["embedding"]:
            held.setdefault(len(r["embedding"]), []).append(r["embedding"])
            tried += 1
    out = {}
    for w, rows in held.items():
        x = np.array(rows, np.float64)
        far, chosen = np.full(len(x), np.inf), [0]
        while len(chosen) < max(1, k * len(x) // tried):
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
            if not far.max() > 0:
                break
            chosen.append(int(far.argmax()))
        out[w] = x[chosen]
    return out


def _dealt(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(path, embedding, width, cell, far): the nearest centre of each vector and the ring around it; widths without a centre have one at zero."""

    def run(batches):
        for b in batches:
            column = b.column("embedding")
            width, cell, far = np.full(len(column), -1, np.int32), np.zeros(len(column), np.int32), np.zeros(len(column))
            for w, rows, x in _by_width(column):
                c = centres.get(w, np.zeros((1, w)))
                near = (2 * (x @ c.T) - (c * c).sum(1)).argmax(1)
                away = np.sqrt(((x - c[near]) ** 2).sum(1))
                ring = np.clip(2 * np.log2(np.maximum(away, 1e-9)) + RINGS // 2, 0, RINGS - 1).astype(np.int64)
                width[rows], cell[rows], far[rows] = w, near * RINGS + ring, away
            out = pa.RecordBatch.from_arrays([b.column("path"), column, pa.array(width), pa.array(cell), pa.array(far)], ["path", "embedding", "width", "cell", "far"])
            yield out.filter(pa.array(width >= 0))

    return vectors.select("path", "embedding").mapInArrow(run, "path string, embedding array<float>, width int, cell int, far double")


def _probes(queries: DataFrame, centres: dict[int, np.ndarray], cells: dict[int, np.ndarray], least: int) -> DataFrame:
    """(query, embedding, width, cell): the cells that each query goes to.

    cells: by width, the numbers of cells, their radii and sizes.  Without a column floor those are the cells of
    greatest bounds that hold at least so many vectors; with it, all others whose bounds reach the floor.
    """

    def run(batches):
        for b in batches:
            names = b.schema.names
            floor = b.column("floor").to_numpy(zero_copy_only=False) if "floor" in names else None
            for w, rows, q in _by_width(b.column("embedding")):
                if w not in cells:
                    continue
                number, radius, size = cells[w]
                c = centres.get(w, np.zeros((1, w)))[number.astype(np.int64) // RINGS]
                length = np.sqrt((q * q).sum(1))[:, None]
                bound = q @ c.T + length * radius
                bound += SLACK * (np.abs(bound) + length)
                order = np.argsort(-bound, 1, kind="stable")
                held = np.cumsum(size[order], 1)
                first = np.empty(order.shape, bool)
                np.put_along_axis(first, order, held - size[order] < least, 1)
                chosen = first if floor is None else ~first & (bound >= floor[rows][:, None])
                i, j = np.nonzero(chosen)
                at = pa.array(rows[i])
                yield pa.RecordBatch.from_arrays([b.column("path").take(at), b.column("embedding").take(at), pa.array(np.full(len(i), w, np.int32)), pa.array(number[j].astype(np.int32))], ["query", "embedding", "width", "cell"])

    names = ["path", "embedding", *(["floor"] if "floor" in queries.columns else [])]
    return queries.select(*names).mapInArrow(run, "query string, embedding array<float>, width int, cell int")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return np.asarray(whole.flatten(), np.float32).reshape(len(whole), -1).astype(np.float64)


def _best(limit: int, own: bool):
    """The best vectors of one block for each query of another; own: may a query find itself?"""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = {"query": [], "path": [], "similarity": []}
        if queries.num_rows and vectors.num_rows:
            q, v = _matrix(queries["embedding"]), _matrix(vectors["embedding"])
            path = np.array(vectors["path"].to_pylist(), object)
            place = np.argsort(np.argsort(path, kind="stable"), kind="stable")
            for k, name in enumerate(queries["query"].to_pylist()):
                s = v @ q[k]
                if not own:
                    s[path == name] = -np.inf
                if limit < len(s):
                    least = np.partition(s, len(s) - limit)[len(s) - limit]
                    some = np.flatnonzero(s >= least - SLACK * (abs(least) + 1)) if np.isfinite(least) else np.flatnonzero(np.isfinite(s))
                else:
                    some = np.flatnonzero(np.isfinite(s))
                exact = (v[some] * q[k]).sum(1)  # in the same order for each row
                order = np.lexsort((place[some], -exact))[:limit]
                out["query"] += [name] * len(order)
                out["path"] += path[some[order]].tolist()
                out["similarity"] += exact[order].tolist()
        return pa.table({"query": pa.array(out["query"], pa.string()), "path": pa.array(out["path"], pa.string()), "similarity": pa.array(out["similarity"], pa.float64())})

    return run


def _looked_up(probes: DataFrame, vectors: DataFrame, limit: int, own: bool) -> DataFrame:
    """FOUND of every probe in its cell, block by block."""
    asked = F.broadcast(probes.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("long").alias("asking")))  # a row for each cell
    held = F.broadcast(vectors.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("long").alias("holding")))
    blocks = lambda name, own, other: [F.pmod(F.xxhash64(name), F.col(own)).alias(own[0]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other[0])]
    left = probes.join(asked, ["width", "cell"]).join(held, ["width", "cell"]).select("query", "embedding", "width", "cell", *blocks("query", "asking", "holding"))
    right = vectors.join(asked, ["width", "cell"]).join(held, ["width", "cell"]).select("path", "embedding", "width", "cell", *blocks("path", "holding", "asking"))
    key = ["width", "cell", "a", "h"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(limit, own), FOUND)


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    """found with place, the best limit of each query; a query has at most limit rows for each block."""
    own = Window.partitionBy("query").orderBy(F.desc("similarity"), "path")
    return found.withColumn("place", F.row_number().over(own)).where(F.col("place") <= limit)


def most_similar(embeddings: DataFrame, queries: DataFrame, limit: int, own: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query, path, similarity, place): for each query (path, embedding) the limit most similar vectors (path, embedding), itself left out unless own.

    Paths are unique on either side; a query whose width no other vector has gives no row.
    """
    spark = embeddings.sparkSession
    ship(spark)
    nothing = spark.createDataFrame([], FOUND + ", place int")
    vectors = embeddings.where("embedding is not null and path is not null")
    n = vectors.count()
    if not n or limit < 1:
        return nothing
    centres = _centres(vectors, n, cell_rows)
    vectors = cut(_dealt(vectors, centres))
    cells: dict[int, list] = {}
    for r in sorted(vectors.groupBy("width", "cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()):
        cells.setdefault(r["width"], []).append((r["cell"], r["far"], r["n"]))
    cells = {w: tuple(np.array(x, np.float64) for x in zip(*own_, strict=True)) for w, own_ in cells.items()}
    asked = queries.where("embedding is not null and path is not null").select("path", F.col("embedding").cast("array<float>").alias("embedding"))
    probes = cut(_probes(asked, centres, cells, limit + (not own)))
    first = cut(_looked_up(probes, vectors, limit, own))
    floor = _ranked(first, limit).where(F.col("place") == limit).select(F.col("query").alias("path"), F.col("similarity").alias("floor"))
    more = asked.join(floor, "path", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    again = cut(_probes(more, centres, cells, limit + (not own)))
    return _ranked(first.unionByName(_looked_up(again, vectors, limit, own)), limit)

"""Packing documents into training sequences: first-fit decreasing over a tournament tree of capacities.

A document is its token ids and END.  The task that reads a document cuts off the
sequences it fills by itself and sends on what is left, fewer than LENGTH ids.  These
remainders are dealt at random to groups of about GROUP_DOCS documents, and each group is
packed by itself: the longest remainder first, each into the first sequence that has
room.  That sequence is found by descending a tournament tree whose nodes hold the
greatest free room below them, to the left wherever that is enough.  Then the
gaps are closed from the back: pieces of the last open sequence fill the first open one,
cut where they're longer than the gap.  What one sequence holds at last is laid out as
sequences of powers of two, which need no padding.  So a group has no padding, and about
as many cuts as it has gaps.

Groups follow from ids and texts and not from partitions.  Rows equal in both are told
apart by how often a task has met them, so that no group gets all copies of a row.
A group is bounded by its documents' remainders, whatever their length; a text is encoded
in pieces that end at a blank, so long texts take as many steps.

Null and empty texts are END alone.  Rows with a null id, or the same one, are packed each
by itself and carry that id.  A table without rows gives none.  Other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table
from .flat import steps

LENGTH = 1024
#: The id behind every document.
END = 0
GROUP_DOCS = 1024
#: Pieces of text whose ids a worker keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 200_000, 64
#: Rows whose repeats a task counts at a time.
COUNTED = 200_000
#: Pieces up to so many characters are merged by the fast encoder; it overflows its stack on very long runs.
FAST_CHARS = 256
#: Fixed value: how byte-level vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank behind something that isn't white space: no token of such a vocabulary goes across.
_CUT = re.compile(r"(?<!\s) ")
_RUN = re.compile(r"\s ")


class Encoder:
    """Token ids of a byte-level vocabulary of the tokenizers library, with a bounded memory of pieces.

    Marks such as the end-of-text string are ordinary text, so no document can forge one.
    Short pieces go through the same merges in tiktoken, which is faster; all else through tokenizers.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        self.whole.encode_special_tokens = True
        ids = json.loads(vocabulary)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in token): k for token, k in ids.items() if all(c in byte for c in token)}
        special = {x["content"] for x in json.loads(vocabulary)["added_tokens"]}
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks={t: k for t, k in ranks.items() if t.decode("utf-8", "replace") not in special}, special_tokens={})
        self.kind = np.dtype("<u2" if max(ids.values()) < 1 << 16 else "<u4")
        self.kept: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        got = self.kept.get(text)
        if got is None:
            ids = self.fast.encode_ordinary(text) if len(text) <= FAST_CHARS else self.whole.encode(text, add_special_tokens=False).ids
            got = np.array(ids, self.kind).tobytes()
            if len(text) <= KEPT_CHARS:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian numbers."""
        if not text:
            return b""
        first, *rest = _CUT.split(text) if _RUN.search(text) else text.split(" ")
        kept, piece = self.kept.get, self.piece
        out = [piece(first)] if first else []
        out += [kept(" " + x) or piece(" " + x) for x in rest]
        return b"".join(out)


_encoder: list = []


def _encoder_of(vocabulary) -> Encoder:
    """The worker's encoder, built once for each broadcast vocabulary."""
    if not _encoder or _encoder[0] != vocabulary.value[0]:
        _encoder[:] = [vocabulary.value[0], Encoder(vocabulary.value[1])]
    return _encoder[1]


def crc(ids: np.ndarray) -> int:
    """Of ids as little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def first_fit(sizes: list[int], length: int = LENGTH) -> tuple[list[list[int]], list[int]]:
    """Items in each sequence and its load; items are placed in the given order, each into the first sequence with room."""
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room = [length] * (2 * width)  # a node's greatest room below it; every leaf is an empty sequence at first
    bins: list[list[int]] = []
    for k, size in enumerate(sizes):
        node = 1
        while node < width:
            node *= 2
            if room[node] < size:
                node += 1
        if node - width == len(bins):
            bins.append([])
        bins[node - width].append(k)
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, [length - room[width + b] for b in range(len(bins))]


def packed(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold every item once: each full or as long as a power of two."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    bins, load = first_fit([sizes[k] for k in order], length)
    held = [[(order[k], 0, sizes[order[k]]) for k in own] for own in bins]
    open_ = [b for b in range(len(bins)) if load[b] < length]
    i, j = 0, len(open_) - 1
    while i < j:
        to, source = open_[i], open_[j]
        gap = length - load[to]
        if gap:
            item, start, n = held[source].pop()
            take = min(gap, n)
            held[to].append((item, start, take))
            if take < n:
                held[source].append((item, start + take, n - take))
            load[to] += take
            load[source] -= take
        if load[to] == length:
            i += 1
        if not load[source]:
            j -= 1
    out = [held[b] for b in range(len(bins)) if load[b] == length]
    for b in range(len(bins)):
        if 0 < load[b] < length:
            left = load[b]
            pieces = held[b][::-1]
            while left:
                size = 1 << (left.bit_length() - 1)
                left -= size
                own = []
                while size:
                    item, start, n = pieces.pop()
                    take = min(size, n)
                    own.append((item, start, take))
                    if take < n:
                        pieces.append((item, start + take, n - take))
                    size -= take
                out.append(own)
    return out


def _encoded(vocabulary, groups: int, length: int):
    """A row for each document: its group, how long it is, the checksums of the sequences it fills, and its other ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of(vocabulary)
        met: dict[int, int] = {}
        for batch in steps(batches, "text"):
            out: dict[str, list] = {"group": [], "doc_tokens": [], "full": [], "rest": []}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(np.frombuffer(encoder.encode(text or ""), encoder.kind), encoder.kind.type(END))
                n = len(ids) // length
                own = zlib.crc32(ids.tobytes(), zlib.crc32(f"{doc_id}:".encode()))
                key = own << 32 | len(ids) & 0xFFFFFFFF
                if len(met) >= COUNTED:
                    met.clear()
                met[key] = again = met.get(key, -1) + 1
                out["group"].append(zlib.crc32(f"{own}:{len(ids)}:{again}".encode()) % groups)
                out["doc_tokens"].append(len(ids))
                out["full"].append(np.array([crc(ids[k * length : (k + 1) * length]) for k in range(n)], "<u4").tobytes())
                out["rest"].append(ids[n * length :].tobytes())
            kinds = {"group": pa.int64(), "doc_tokens": pa.int64(), "full": pa.binary(), "rest": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], t) for k, t in kinds.items())], ["doc_id", *kinds])

    return run


def _laid_out(kind: np.dtype, length: int, columns: list[str]):
    """The pieces of one group of documents."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        full = [np.frombuffer(x, "<u4") for x in group["full"].to_pylist()]
        rest = [np.frombuffer(x, kind) for x in group["rest"].to_pylist()]
        total, number, name = group["doc_tokens"].to_pylist(), group["group"][0].as_py() << 32, group["doc_id"].to_pylist()
        # rows come in any order
        order = sorted(range(len(rest)), key=lambda k: (total[k], str(name[k]), full[k].tobytes(), rest[k].tobytes()))
        doc, rows, sequence = [], [], 0
        for k in order:
            for j, own in enumerate(full[k].tolist()):
                doc.append(k)
                rows.append((j * length, length, own, total[k], number + sequence, 0))
                sequence += 1
        some = [k for k in order if len(rest[k])]
        for own in packed([len(rest[k]) for k in some], length):
            at = 0
            for item, start, n in own:
                k = some[item]
                doc.append(k)
                rows.append((len(full[k]) * length + start, n, crc(rest[k][start : start + n]), total[k], number + sequence, at))
                at += n
            sequence += 1
        kept = group["doc_id"].take(pa.array(doc, pa.int64()))
        return pa.table([kept, *(pa.array([r[c] for r in rows], pa.int64()) for c in range(6))], columns)

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of each document (doc_id, text).

    vocabulary: a byte-level vocabulary of the tokenizers library, as JSON text; it is sent to every worker (2 MB).
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text")
    groups = max(1, -(-rows.count() // group_docs))
    sent = spark.sparkContext.broadcast((zlib.crc32(vocabulary.encode()), vocabulary))
    kind = np.dtype("<u2" if max(json.loads(vocabulary)["model"]["vocab"].values()) < 1 << 16 else "<u4")
    own = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    schema = T.StructType([own, *(T.StructField(c, t) for c, t in (("group", T.LongType()), ("doc_tokens", T.LongType()), ("full", T.BinaryType()), ("rest", T.BinaryType())))])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = T.StructType([own, *(T.StructField(c, T.LongType()) for c in names[1:])])
    return rows.mapInArrow(_encoded(sent, groups, length), schema).groupBy("group").applyInArrow(_laid_out(kind, length, names), out)


def vocabulary_at(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op13_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; vocabulary is the path of another tokenizer file."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), vocabulary_at(vocabulary))

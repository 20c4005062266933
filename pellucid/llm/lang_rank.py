"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (one to three
letters of lower-cased words, a space at either end) in order of frequency.  A
document is compared to every language by the out-of-place distance: the sum,
over the document's profile, of how far an n-gram stands from its rank in the
language's profile, or the profile's length where the language lacks it.

Profiles are learned from all training documents: tasks count n-grams for each
language, Spark adds the counts up, and only the first PROFILE n-grams of each
language come to the driver.  What is broadcast is bounded by PROFILE times the
number of languages.

A null or empty text, or one without a letter, is `und` with score 0.  Ties go
to the language first by code point; n-grams of equal frequency are ranked by
code point.  Without training documents every text is `und`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .common import cut, ship, table

ORDERS = 3
PROFILE = 400
#: A letter's code point takes so many bits of an n-gram.
BITS = 21
#: Counts that a task holds before it sends them on.
HELD = 1_000_000
#: Bytes of text that are counted at once; three n-grams for each letter take more memory than words do.
STEP_BYTES = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower case, 0 if it's no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if unicodedata.category(s)[0] == "L":
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and the n+1 offsets of the texts; nulls are empty."""
    texts = [t or "" for t in texts]
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), at


def counted(texts: list[str | None], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count) sorted by group and n-gram; the group of a text is its number, or as given, -1 to leave it out.

    An n-gram is packed from the left, BITS for each code point, 0 behind a shorter one.
    Texts with too many letters and groups for one key are counted in halves; a group may then come twice.
    """
    raw, at = code_points(texts)
    letter = letters()[raw]
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    # runs of others become one space, and so do the bounds of texts
    word = letter > 0
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    head = at[:-1][at[:-1] < at[1:]]
    begin[head] = word[head]
    if group is not None:
        keep = (group >= 0)[owner]
        word, begin = word & keep, begin & keep
        owner = group[owner]
    where = np.flatnonzero(word)
    if not len(where):
        z = np.zeros(0, np.int64)
        return z, z, z
    starts = begin[where]
    # each word gets a space before it, and one more after the last
    slot = np.arange(len(where)) + np.cumsum(starts)
    n = int(slot[-1]) + 2
    chars = np.full(n, 0x20, np.uint32)
    chars[slot] = letter[where]
    # a word's leading space belongs to its text; the space after it is the next word's and closes this one
    own = np.zeros(n, np.int64)
    own[slot] = owner[where]
    own[slot[starts] - 1] = owner[where][starts]
    own[-1] = own[-2]
    # dense letters keep the order of code points and leave room for the group
    there = np.zeros(0x110000, bool)
    there[chars] = True
    alphabet = np.flatnonzero(there)
    dense = np.cumsum(there)[chars].astype(np.int64)
    bits = int(len(alphabet)).bit_length()
    sums = []
    some, own = np.unique(own, return_inverse=True)
    if ORDERS * bits + len(some).bit_length() > 62 and len(texts) > 1:
        half = len(texts) // 2
        low, high = (counted(texts[a:b], None if group is None else group[a:b]) for a, b in ((0, half), (half, len(texts))))
        return np.concatenate([low[0], high[0] + (half if group is None else 0)]), np.concatenate([low[1], high[1]]), np.concatenate([low[2], high[2]])
    space = chars == 0x20
    a = own << (ORDERS * bits)
    one = a | (dense << (2 * bits))
    sums.append(one[~space])
    two = one[:-1] | (dense[1:] << bits)
    # n-grams lie in one word with its spaces: a space only at the ends
    sums.append(two[~(space[:-1] & space[1:])])
    three = two[:-1] | dense[2:]
    sums.append(three[~space[1:-1]])
    keys = np.sort(np.concatenate(sums))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    mask = (1 << bits) - 1
    back = np.concatenate([[0], alphabet]).astype(np.int64)
    gram = (back[(keys >> (2 * bits)) & mask] << (2 * BITS)) | (back[(keys >> bits) & mask] << BITS) | back[keys & mask]
    return some[keys >> (ORDERS * bits)], gram, count


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted union of all profiles
    ranks: np.ndarray  # language x n-gram, PROFILE where it's missing
    size: int

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The nearest language and 1 - distance / greatest distance, for each text."""
        doc, gram, count = counted(texts)
        n = len(texts)
        if not len(doc) or not self.languages:
            return ["und"] * n, np.zeros(n)
        order = np.argsort((doc << 31) + ((1 << 31) - 1 - np.minimum(count, (1 << 31) - 1)), kind="stable")
        doc, gram = doc[order], gram[order]
        first = np.searchsorted(doc, np.arange(n + 1))
        rank = np.arange(len(doc)) - first[doc]
        top = rank < self.size
        doc, gram, rank = doc[top], gram[top], rank[top]
        k = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        there = self.grams[k] == gram
        far = np.empty((len(self.languages), n))
        for i, ranks in enumerate(self.ranks):
            away = np.where(there, np.where(ranks[k] < self.size, np.abs(ranks[k] - rank), self.size), self.size)
            far[i] = np.bincount(doc, away, minlength=n)
        best = far.argmin(0)
        used = np.bincount(doc, minlength=n)
        score = np.where(used > 0, 1 - far[best, np.arange(n)] / np.maximum(used * self.size, 1), 0.0)
        return [self.languages[b] if u else "und" for b, u in zip(best, used, strict=True)], np.clip(score, 0, 1)


COUNTS = "lang string, gram long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        g, x, c = (np.concatenate(y) for y in zip(*held, strict=True))
        order = np.lexsort((x, g))
        g, x, c = g[order], x[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])]))
        return g[first], x[first], np.add.reduceat(c, first)

    def rows():
        g, x, c = merged()
        known = np.array(list(names), object)
        for s in range(0, len(g), 100_000):
            part = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(known[g[part]], pa.string()), pa.array(x[part]), pa.array(c[part])], ["lang", "gram", "n"])

    for batch in flat.steps(batches, "text", STEP_BYTES):
        lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        group = np.array([-1 if x is None else names.setdefault(x, len(names)) for x in lang], np.int64)
        some = counted(batch.column(batch.schema.get_field_index("text")).to_pylist(), group)
        if len(some[0]):
            held.append(some)
        if sum(len(x[0]) for x in held) > HELD:
            held = [merged()]
            if len(held[0][0]) > HELD // 2:
                yield from rows()
                held = []
    if held:
        yield from rows()


def learn(training: DataFrame, profile: int = PROFILE) -> Model:
    """Profiles from the (lang, text) rows of training, whole texts; rows without lang teach nothing."""
    ship(training.sparkSession)
    rows = training.select("lang", "text").where("lang is not null and text is not null")
    sums = cut(rows.mapInArrow(_count, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # tasks keep the first of each language before anything is sent
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    first = sums.withColumn("place", place).where(F.col("place") <= profile).collect()
    languages = sorted({r["lang"] for r in first})
    tops = [[r["gram"] for r in sorted((r for r in first if r["lang"] == x), key=lambda r: r["place"])] for x in languages]
    grams = np.unique(np.array([g for t in tops for g in t], np.int64))
    ranks = np.full((len(languages), len(grams)), profile, np.int64)
    for i, t in enumerate(tops):
        ranks[i, np.searchsorted(grams, np.array(t, np.int64))] = np.arange(len(t))
    return Model(languages, grams, ranks, profile)


def judged(docs: DataFrame, model: Model, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the language and score found, in columns of these names (replaced if there, whatever case)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(lang_name, score_name)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in flat.steps(batches, "text", STEP_BYTES):
            lang, score = sent.value.judge(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, lang_name, score_name])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) % 3 == 1
    model = learn(docs.where(~held_out).select("lang", "text"))
    return judged(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")

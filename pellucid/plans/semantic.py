"""Embedding providers, and search, clusters and label checks over one collection."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cache, vectors
from ..operators.findings import representatives, usable
from ..operators.graph import cut
from ..runtime import ship
from ..sources.pixels import Preprocessing, pixel_rows


#: Files embedded between two appends to the cache.
ROUND = 100_000


class EmbeddingProvider(ABC):
    """Makes vectors of files; instances are sent to tasks."""

    identifier: str
    batch_size = 32

    def is_available(self) -> bool:
        return True

    def prepare(self) -> None:
        """Load what embed needs; called once in each task."""

    @abstractmethod
    def embed(self, urls: list[str]) -> list[list[float] | None]:
        """A vector for each url; None where a file can't be embedded."""

    def embed_text(self, text: str) -> list[float]:
        raise NotImplementedError

    def embed_query(self, text: str) -> list[float]:
        return self.embed_text(f"a photo of {text}")


class PixelProvider(EmbeddingProvider):
    """Makes vectors of pixels that other tasks decoded and scaled, so a model sees whole batches of pictures."""

    preprocessing = Preprocessing()

    @abstractmethod
    def embed_pixels(self, pixels: np.ndarray) -> np.ndarray:
        """A row for each picture of a batch, n x size x size x 3."""

    def embed(self, urls):
        raise NotImplementedError("this provider takes pixels")


class HashProvider(EmbeddingProvider):
    """Deterministic unit vectors of names, for tests and demonstrations."""

    identifier = "hash-64"

    def _vector(self, key: str) -> list[float]:
        raw = np.frombuffer(hashlib.shake_256(key.encode()).digest(256), "<u4").astype(np.float64) / 2**31 - 1
        return (raw / np.linalg.norm(raw)).astype(np.float32).tolist()

    def embed(self, urls):
        return [self._vector(u) for u in urls]

    def embed_text(self, text):
        return self._vector(text)


def embedded(records: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """(content_hash, embedding) of records, in the provider's batches; files that fail are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.prepare()
        for pdf in batches:
            for s in range(0, len(pdf), provider.batch_size):
                part = pdf.iloc[s : s + provider.batch_size]
                urls = part["url"].tolist()
                try:
                    got = provider.embed(urls)
                except Exception:  # one bad file must not cost its batch
                    got = []
                    for u in urls:
                        try:
                            got += provider.embed([u])
                        except Exception:
                            got.append(None)
                out = pd.DataFrame({"content_hash": part["content_hash"].tolist(), "embedding": got})
                yield out[out["embedding"].notna()]

    ship(records.sparkSession)
    return records.select("url", "content_hash").mapInPandas(run, "content_hash string, embedding array<float>")


def embedded_pixels(records: DataFrame, images: DataFrame, provider: PixelProvider) -> DataFrame:
    """(content_hash, embedding) of the records of one round (some 100,000 names) whose pictures are in images, in the provider's batches.

    A batch that fails is tried one by one.
    """
    size = provider.preprocessing.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider.prepare()
        keys: list[str] = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            x = np.stack(held).reshape(-1, size, size, 3)
            try:
                got = list(zip(keys, provider.embed_pixels(x), strict=True))
            except Exception:  # one bad picture must not cost its batch
                got = []
                for k, one in zip(keys, x, strict=True):
                    try:
                        got.append((k, provider.embed_pixels(one[None])[0]))
                    except Exception:
                        continue
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([np.asarray(v, np.float32) for _, v in got], pa.list_(pa.float32()))], ["content_hash", "embedding"])

        for b in batches:
            for k in range(b.num_rows):
                keys.append(b.column("content_hash")[k].as_py())
                held.append(b.column("pixels").slice(k, 1).flatten().to_numpy(zero_copy_only=False))
                if len(held) == provider.batch_size:
                    yield out()
        if held:
            yield out()

    ship(records.sparkSession)
    # the names of a round are sent to the pictures, so neither those nor their pixels are shuffled
    named = images.join(F.broadcast(records.select("url", "content_hash")), "url").select("content_hash", "height", "width", "channels", "data")
    return pixel_rows(named, provider.preprocessing, "content_hash").mapInArrow(run, "content_hash string, embedding array<float>")


class SemanticSession:
    """Vectors of a collection's representatives through the cache, and what they are good for; a PixelProvider needs the pictures (images())."""

    def __init__(self, records: DataFrame, provider: EmbeddingProvider, store: cache.EmbeddingStore, round_: int = ROUND, images: DataFrame | None = None):
        if not provider.is_available() or isinstance(provider, PixelProvider) and images is None:
            raise ValueError(f"{provider.identifier} can't make vectors here")
        self.records, self.provider, self.store, self.round, self.images = records, provider, store, round_, images
        self.chosen = representatives(usable(records)).where("content_hash is not null")

    def build(self) -> DataFrame:
        """Embed what the cache lacks, and give (path, embedding) of all representatives.

        What is pending goes in rounds of about ROUND files, each appended when it's done, so that a crash loses one round.
        """
        pending = cut(cache.pending(self.chosen, self.store.rows(), self.provider.identifier))
        rounds = -(-pending.count() // self.round)
        for k in range(rounds):
            some = pending.where(F.pmod(F.xxhash64("content_hash"), F.lit(rounds)) == k)
            made = embedded_pixels(some, self.images, self.provider) if isinstance(self.provider, PixelProvider) else embedded(some, self.provider)
            self.store.append(cut(made), self.provider.identifier)
        return self.embeddings()

    def embeddings(self) -> DataFrame:
        return cache.hits(self.chosen, self.store.rows(), self.provider.identifier).withColumnRenamed("url", "path")

    def search(self, text: str, limit: int = vectors.SEARCH_LIMIT) -> DataFrame:
        wanted = text.strip()
        return vectors.nearest(self.embeddings(), self.provider.embed_query(wanted) if wanted else [], limit)

    def find_similar(self, url: str, limit: int = vectors.SEARCH_LIMIT) -> DataFrame:
        """Like url; a copy that has no vector of its own is found through its content."""
        own = self.records.where(F.col("url") == url).select("content_hash")
        twin = self.chosen.join(own, "content_hash", "left_semi").select("url").first()
        return vectors.similar_to(self.embeddings(), twin[0] if twin else url, limit)

    def clusters(self, into: int | None = None) -> DataFrame:
        return vectors.cluster(self.embeddings(), into)

    def label_suggestions(self, margin: float = vectors.MARGIN) -> DataFrame:
        return vectors.label_suggestions(self.embeddings(), self.records.select(F.col("url").alias("path"), "label"), margin)

"""Token ids of search texts, with a vocabulary file given by its path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 77
START, END = "<|startoftext|>", "<|endoftext|>"


class Encoder:
    """Lower-cased byte-pair ids between a start and an end; a long text is cut, its end stays."""

    def __init__(self, path: str, length: int = LENGTH):
        from tokenizers import Tokenizer  # only where texts are encoded

        self.tokenizer, self.length = Tokenizer.from_file(path), length
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.start, self.end = self.tokenizer.token_to_id(START), self.tokenizer.token_to_id(END)

    def encode(self, texts: list[str]) -> list[list[int]]:
        clean = [" ".join((t or "").lower().split()) for t in texts]
        out = self.tokenizer.encode_batch(clean, add_special_tokens=False)
        return [[self.start, *x.ids[: self.length - 2], self.end] for x in out]


def token_ids(text: Column, path: str, length: int = LENGTH) -> Column:
    """ARRAY<INT> of ids; the vocabulary at path must be there on every executor."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path, length)
        for s in batches:
            yield pd.Series(encoder.encode(s.tolist()))

    return run(text)

"""Pixels as vision models take them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship
from .folder import area_means, rgb_of

#: Channel means and deviations of the usual preprocessing.
MEAN = (0.48145466, 0.4578275, 0.40821073)
DEVIATION = (0.26862954, 0.26130258, 0.27577711)
SIZE = 224


@dataclass(frozen=True)
class Preprocessing:
    size: int = SIZE
    mean: tuple[float, ...] = MEAN
    deviation: tuple[float, ...] = DEVIATION

    @staticmethod
    def read(text: str | None) -> Preprocessing:
        """From a preprocessor's JSON; what it lacks, or can't be read, is as usual."""
        try:
            c = json.loads(text) if text else {}
        except ValueError:
            c = {}
        size = c.get("crop_size", c.get("size", SIZE))
        if isinstance(size, dict):
            size = size.get("height") or size.get("shortest_edge") or SIZE
        return Preprocessing(int(size), tuple(c.get("image_mean", MEAN)), tuple(c.get("image_std", DEVIATION)))


def model_pixels(rgb: np.ndarray, p: Preprocessing = Preprocessing()) -> np.ndarray:
    """height x width x 3 bytes to size x size x 3 floats: the short side is scaled to size, the middle cut out, channels normalised."""
    h, w, _ = rgb.shape
    scale = p.size / min(h, w)
    rows, columns = max(p.size, round(h * scale)), max(p.size, round(w * scale))
    x = area_means(rgb, rows, columns)
    top, left = (rows - p.size) // 2, (columns - p.size) // 2
    x = x[top : top + p.size, left : left + p.size] / 255
    return ((x - np.array(p.mean)) / np.array(p.deviation)).astype(np.float32)


def pixel_rows(images: DataFrame, p: Preprocessing = Preprocessing(), key: str = "url") -> DataFrame:
    """(key, pixels): size x size x 3 floats of every picture of images(), row by row, named by a text column; pictures that can't be decoded have no row.

    A task holds one picture and its floats at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                rgb = rgb_of(row)
                if rgb is not None:
                    x = model_pixels(rgb, p).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([row[key]], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float32()))], [key, "pixels"])

    ship(images.sparkSession)
    return images.mapInArrow(run, f"{key} string, pixels array<float>")

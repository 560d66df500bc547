"""Frame embeddings through an encoder that a task loads once; the encoder itself is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Side of the encoder's input, mean and deviation of its channels, frames a call.
SIDE, MEAN, DEVIATION, BATCH = 224, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 16


def prepared(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """An image (h, w, 3) of bytes as (3, side, side) floats: nearest pixels, channels standardised."""
    y, x = ((np.arange(side) * n / side).astype(int) for n in image.shape[:2])
    return ((image[np.ix_(y, x)] / 255 - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32)


def embed_frames(frames: DataFrame, encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = BATCH) -> DataFrame:
    """frames (path, t, h, w, pixels) -> path, t, emb (unit length). encoder() is called once a task and gives a function
    from (n, 3, SIDE, SIDE) floats to (n, d) vectors; a zero vector stays zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                path, t, h, w, pixels = (c.to_pylist() for c in b.slice(at, batch).columns)
                v = np.asarray(model(np.stack([prepared(np.frombuffer(p, np.uint8).reshape(i, j, 3)) for p, i, j in zip(pixels, h, w)])), float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pa.record_batch([pa.array(path), pa.array(t, pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64()))], ["path", "t", "emb"])

    return frames.select("path", "t", "h", "w", "pixels").mapInArrow(run, "path string, t int, emb array<double>")

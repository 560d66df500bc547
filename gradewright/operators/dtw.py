"""Dynamic time warping against demo tracks: a cost matrix is filled by its antidiagonals, batch by batch in Arrow."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.errors import SpecError
from gradewright.operators.episode import score

#: Fixed value: the scale of the score.
SCALE = 0.25
#: Demos that every rollout is held against travel with the plan; more are an error.
MAX_DEMOS = 256


def normalised(points: np.ndarray) -> np.ndarray | None:
    """Observed points from the first one on, over their greatest coordinate; None below two."""
    seen = points[np.isfinite(points).all(axis=1)]
    if len(seen) < 2:
        return None
    seen = seen - seen[0]
    return seen / max(np.abs(seen).max(), 1e-6)


def cost(a: np.ndarray, b: np.ndarray) -> float:
    """Total cost of the best path over n + m. Cells of an antidiagonal depend on the two before it alone."""
    n, m = len(a), len(b)
    last, before = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # by row, of the diagonals i + j = s - 1 and s - 2
    before[0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        now = np.full(n + 1, np.inf)
        step = np.hypot(*(a[i - 1] - b[s - i - 1]).T)
        now[i] = step + np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1])
        last, before = now, last
    return float(last[n] / (n + m))


def _points(c: pa.Array) -> Iterator[np.ndarray]:
    flat = np.column_stack([c.flatten().field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")])  # null lists hold nothing
    ends = np.cumsum([0, *(len(x) if x.is_valid else 0 for x in c)])
    return (flat[i:j] for i, j in zip(ends, ends[1:]))


def demo_scores(tracks: DataFrame, demos: Sequence[Sequence[tuple]], key: str = "rollout_id", scale: float = SCALE) -> DataFrame:
    """tracks (key, points array<struct<x, y>>, null coordinates unobserved) and demo tracks -> key, score of
    trajectory.dtw_demo: exp(-least distance to any demo / scale), confidence the share of observed points."""
    if len(demos) > MAX_DEMOS:
        raise SpecError(f"{len(demos)} demo tracks; at most {MAX_DEMOS} are compared")
    bank = [normalised(np.array([[np.nan if v is None else v for v in p] for p in d], float).reshape(-1, 2)) for d in demos]
    usable = bool(bank) and all(b is not None for b in bank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, share, short = [], [], []
            for p in _points(b.column(1)):
                q = normalised(p)
                short.append(q is None)
                share.append(float(np.isfinite(p).all(axis=1).mean()) if len(p) else 0.0)
                least.append(min(cost(q, d) for d in bank) if usable and q is not None else None)
            yield pa.record_batch([b.column(0), pa.array(least, pa.float64()), pa.array(share, pa.float64()), pa.array(short)], ["key", "d", "share", "short"])

    kind = tracks.schema[key].dataType.simpleString()
    points = tracks.select(F.col(key).alias("key"), F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("points"))
    d = points.mapInArrow(run, f"key {kind}, d double, share double, short boolean")
    why = F.when(F.lit(not bank), "no demo tracks").when(F.lit(not usable), "a demo track has too few observed points").when(F.col("short"), "too few observed points")
    detail = F.create_map(F.lit("min_dtw"), F.round(F.col("d") + 1e-9, 4), F.lit("n_refs"), F.lit(float(len(bank))))
    return d.select(F.col("key").alias(key), score("trajectory.dtw_demo", F.col("d").isNotNull(), F.exp(-F.col("d") / scale), F.col("share"), why, detail).alias("score"))

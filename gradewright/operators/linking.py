"""Greedy linking of detections to one track a role: state runs from frame to frame, so a role is one ordered group.

Groups spread over (rollout_id, role) and come sorted; the fold keeps a role's last box and one frame, never the group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Threshold of scores, weight of overlap, leash as a share of the diagonal, misses after which a track is lost.
THRESHOLD, OVERLAP, LEASH, LOST = 0.3, 0.3, 0.35, 6
#: Rows of a batch of chosen boxes.
ROWS = 10_000
SCHEMA = "rollout_id long, role string, t int, x0 double, y0 double, x1 double, y1 double, score double"


def overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes (x0, y0, x1, y1); zero without common area."""
    common = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    if common <= 0:
        return 0.0
    return common / (sum(max(0.0, q[2] - q[0]) * max(0.0, q[3] - q[1]) for q in (a, b)) - common)


class Linker:
    """One role's state: the last confirmed box (or none) and the misses since."""

    def __init__(self, diagonal: float, box: tuple | None = None, misses: int = 0) -> None:
        self.diagonal, self.box, self.misses = diagonal, box, misses

    def step(self, found: Iterable[tuple]) -> tuple | None:
        """The detection (x0, y0, x1, y1, score) that goes on, or None. The leash grows with misses; a lost track may start anywhere."""
        held = self.box if self.misses < LOST else None
        reach = LEASH * self.diagonal * (1 + 0.5 * self.misses)
        best, top = None, float("-inf")
        for d in found:
            if not d[4] >= THRESHOLD:
                continue
            rank = d[4]
            if held is not None:
                gap = ((d[0] + d[2] - held[0] - held[2]) ** 2 + (d[1] + d[3] - held[1] - held[3]) ** 2) ** 0.5 / 2
                if gap > reach:
                    continue
                rank += OVERLAP * overlap(d[:4], held)
            if rank > top:
                best, top = d, rank
        if best is None:
            self.misses += 1
        else:
            self.box, self.misses = tuple(best[:4]), 0
        return best


def followed(linker: Linker, rows: Iterable[tuple]) -> Iterator[tuple]:
    """(t, x0, y0, x1, y1, score) of a role in order -> the row that goes on, of each frame that has one."""
    for t, frame in groupby(rows, itemgetter(0)):
        hit = linker.step([r[1:6] for r in frame])
        if hit is not None:
            yield int(t), *hit


def linked_rows(linker: Linker, frames: pd.DataFrame) -> list[tuple]:
    """frames: one role's detections, any order; a frame without any has one row with a null score. Ties take the least box order `k`."""
    d = frames.dropna(subset="t").sort_values(["t", "k"])
    return list(followed(linker, zip(d["t"].tolist(), *(d[c].astype(float).tolist() for c in ("x0", "y0", "x1", "y1", "score")))))


def _columns(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch: rollout_id, role and t as they are, then numbers, NaN for null."""
    return zip(*(c.to_pylist() for c in b.columns[:3]), *(c.to_numpy(zero_copy_only=False).tolist() for c in b.columns[3:]))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (rollout_id, role, t, boxes, diagonal), a role on end, cut into batches anywhere."""
    first = next(batches, None)
    if first is None:
        return
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [first.schema.field(0).type, first.schema.field(1).type, pa.int32(), *[pa.float64()] * 5]

    def hits() -> Iterator[tuple]:
        for key, rows in groupby(chain.from_iterable(map(_columns, chain([first], batches))), itemgetter(0, 1)):
            start = next(rows)
            for hit in followed(Linker(start[8]), (r[2:8] for r in chain([start], rows))):
                yield *key, *hit

    found = hits()
    while out := list(islice(found, ROWS)):
        yield pa.record_batch([pa.array(c, k, from_pandas=True) for c, k in zip(zip(*out), kinds)], names)


def link(detections: DataFrame, diagonal: float) -> DataFrame:
    """detections (rollout_id, role, t, k, x0, y0, x1, y1, score) -> the chosen box of each frame that has one."""
    return link_each(detections.withColumns({"rollout_id": F.col("rollout_id").cast("long"), "diagonal": F.lit(diagonal)}))


def link_each(detections: DataFrame) -> DataFrame:
    """The same where each row brings the diagonal of its rollout; rollout ids are of any type."""
    kind = detections.schema["rollout_id"].dataType.simpleString()
    rows = detections.filter("t is not null").repartition("rollout_id", "role").sortWithinPartitions("rollout_id", "role", "t", F.col("k").asc_nulls_last())
    rows = rows.select("rollout_id", "role", "t", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "score", "diagonal")])
    return rows.mapInArrow(_linked, SCHEMA.replace("rollout_id long", f"rollout_id {kind}"))


#: A role that brings nothing for so long is closed: its last frame is linked and its state dropped.
IDLE = "1 hour"
_KEPT = "x0 double, y0 double, x1 double, y1 double, misses int, held string"
_BOX = ["t", "k", "x0", "y0", "x1", "y1", "score"]


def link_stream(detections: DataFrame, diagonal: float, idle: str = IDLE) -> DataFrame:
    """The same over a stream that brings a role's frames in order. A frame may be split over micro-batches: the latest
    one is held back until a later frame comes, or nothing for `idle`. Box, misses and that one frame are all that is kept."""
    import json

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    length = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    count, unit = idle.split()
    wait = int(count) * length[unit.rstrip("s")] * 1000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (None, None, None, None, 0, "[]")
        linker = Linker(diagonal, None if kept[0] is None else tuple(kept[:4]), int(kept[4]))
        rows = pd.DataFrame(json.loads(kept[5]), columns=_BOX)
        if state.hasTimedOut:
            state.remove()
            ready = rows
        else:
            rows = pd.concat([rows, *(p[_BOX] for p in parts)], ignore_index=True)
            rows = rows.astype({"t": int, "k": int} | dict.fromkeys(_BOX[2:], float))
            latest = rows["t"].max()
            ready, held = rows[rows["t"] < latest], rows[rows["t"] == latest]
        out = linked_rows(linker, ready) if len(ready) else []
        if not state.hasTimedOut:
            state.update((*(linker.box or (None,) * 4), linker.misses, held.to_json(orient="values")))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame([(*key, *r) for r in out], columns=["rollout_id", "role", "t", "x0", "y0", "x1", "y1", "score"])

    return detections.groupBy("rollout_id", "role").applyInPandasWithState(run, SCHEMA, _KEPT, "append", GroupStateTimeout.ProcessingTimeTimeout)

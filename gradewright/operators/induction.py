"""Entities from pixels alone, and roles from how the entities move and end.

Clustering needs a rollout's frames together (a bounded group), so it is a grouped map over frame rows. All that
follows, from statistics to roles and bindings, is a plan over the entities' tracks, at most K a rollout.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clusters, rounds, draws of the weighted sample, stride of the pixels that it sees.
K, ROUNDS, DRAWS, STRIDE = 5, 12, 6000, 4
#: Least pixels of a centre, greatest share of the frame, least RGB distance from the background.
LEAST, WIDEST, APART = 12, 0.25, 30.0
#: Share of the diagonal that makes a mover, start of the settled end, separation below which two movers are ambiguous.
MOVING, SETTLED, SEPARATE = 0.08, 0.8, 16.0
ENTITY = "path string, entity int, t int, x double, y double, area long, diagonal double, r double, g double, b double, h int, w int, mask binary"


def _nearest(px: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((px[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def weighted_sample(px: np.ndarray, ground: np.ndarray, seed: int, draws: int = DRAWS) -> np.ndarray:
    """Pixels drawn with replacement in proportion to their distance from the background colour."""
    weight = np.cumsum(np.linalg.norm(px - ground, axis=1) + 1e-3)
    at = np.searchsorted(weight, np.random.default_rng(seed).random(min(len(px), draws)) * weight[-1], "right")
    return px[np.minimum(at, len(px) - 1)]


def clusters(px: np.ndarray, k: int = K) -> np.ndarray:
    """k centres; each starts at the pixel furthest from the median, or from the centres so far, so small colours get their own."""
    far = ((px - np.median(px, axis=0)) ** 2).sum(axis=1)
    start = []
    for _ in range(k):
        start.append(px[far.argmax()])
        new = ((px - start[-1]) ** 2).sum(axis=1)
        far = new if len(start) == 1 else np.minimum(far, new)
    centres = np.array(start, float)
    for _ in range(ROUNDS):
        own = _nearest(px, centres)
        size = np.bincount(own, minlength=k)
        mean = np.stack([np.bincount(own, px[:, c], k) for c in range(px.shape[1])], axis=1)
        centres[size > 0] = mean[size > 0] / size[size > 0, None]
    return centres


def entities(frames: DataFrame, k: int = K, seed: int = 0) -> DataFrame:
    """frames (path, t, h, w, pixels) -> the track of every entity, a row a frame; centres are null below LEAST pixels.

    Clusters that fill the frame, have no centre or look like the background are left out. The seed of a rollout is
    seed + CRC-32 of its path, so neither order nor partition matters. r, g, b is an entity's colour; its first row holds
    its mask, a bit a pixel, set where it ever was.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        h, w = int(rows["h"].iloc[0]), int(rows["w"].iloc[0])
        video = np.stack([np.frombuffer(p, np.uint8).reshape(h, w, 3) for p in rows["pixels"]])
        px = video[:: max(1, len(video) // 12), ::STRIDE, ::STRIDE].reshape(-1, 3).astype(float)
        ground = np.median(px, axis=0)
        centres = clusters(weighted_sample(px, ground, seed + zlib.crc32(key[0].encode())), k)
        yy, xx = (a.ravel() for a in np.mgrid[:h, :w])
        area, cx, cy = (np.zeros((len(video), k)) for _ in range(3))
        ever = np.zeros((k, h * w), bool)
        for i, frame in enumerate(video):
            own = _nearest(frame.reshape(-1, 3).astype(float), centres)
            area[i], cx[i], cy[i] = (np.bincount(own, v, k) for v in (None, xx, yy))
            ever[own, np.arange(h * w)] = True
        seen = area >= LEAST
        keep = (area.mean(axis=0) <= WIDEST * h * w) & seen.any(axis=0) & (np.linalg.norm(centres - ground, axis=1) >= APART)
        out = []
        for j in np.flatnonzero(keep):
            size = np.where(seen[:, j], area[:, j], np.nan)
            out.append(pd.DataFrame({"path": key[0], "entity": int(j), "t": rows["t"].to_numpy(), "x": cx[:, j] / size, "y": cy[:, j] / size, "area": area[:, j].astype(int), "diagonal": float(np.hypot(h, w)),
                                     "r": centres[j, 0], "g": centres[j, 1], "b": centres[j, 2], "h": h, "w": w, "mask": [np.packbits(ever[j]).tobytes()] + [None] * (len(video) - 1)}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in ENTITY.split(", ")})

    found = frames.groupBy("path").applyInPandas(run, ENTITY)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def roles(tracks: DataFrame, keys: list[str], diagonal: float | DataFrame, moving: float = MOVING) -> DataFrame:
    """tracks (keys, entity, t, x, y; a row a frame) -> carried, receptacle, effector and ambiguous, a row a rollout.

    Carried and receptacle are the mover and the static entity whose ends are closest; the effector is the other mover,
    of several the one whose velocity goes most with the carried one's. Ties take the least entity; a slot may be null.
    diagonal: of all frames, or a table (keys, diagonal).
    """
    point = F.struct("t", "x", "y")
    e = tracks.groupBy(*keys, "entity").agg(F.array_sort(F.collect_list(point)).alias("p"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("range"), F.count("x").alias("seen"))
    e = e.join(diagonal, keys) if isinstance(diagonal, DataFrame) else e.withColumn("diagonal", F.lit(diagonal))
    e = e.filter("seen > 0").withColumn("start", F.floor(F.size("p") * SETTLED))
    observed = F.filter("p", lambda s: s["x"].isNotNull())
    late = F.filter("p", lambda s: s["x"].isNotNull() & (s["t"] >= F.col("start")))
    mean = lambda a, c: F.aggregate(a, F.lit(0.0), lambda s, v: s + v[c]) / F.size(a)
    e = e.withColumn("end", F.when(F.size(late) > 0, late).otherwise(observed)).withColumn("late", F.size(late) > 0)
    steps = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.coalesce(F.get("p", i)[c], F.lit(0.0)) - F.coalesce(F.get("p", i - 1)[c], F.lit(0.0)))
    row = F.struct("entity", mean(F.col("end"), "x").alias("x"), mean(F.col("end"), "y").alias("y"), "late", (F.col("range") >= moving * F.col("diagonal")).alias("mover"), F.concat(steps("x"), steps("y")).alias("v"))
    g = e.select(*keys, row.alias("e")).groupBy(*keys).agg(F.array_sort(F.collect_list("e"), lambda a, b: a["entity"] - b["entity"]).alias("all"))
    g = g.withColumn("movers", F.filter("all", lambda a: a["mover"])).withColumn("statics", F.filter("all", lambda a: ~a["mover"]))
    gap = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    # entities number K at most, so these are K * K / 4 distances
    near = F.array_min(F.flatten(F.transform("movers", lambda m: F.transform("statics", lambda s: F.struct(gap(m, s).alias("d"), m["entity"].alias("m"), s["entity"].alias("s"))))))
    g = g.withColumn("best", near).withColumn("mine", F.get(F.filter("movers", lambda m: m["entity"] == F.col("best.m")), F.lit(0)))
    size = lambda a: F.sqrt(_dot(a, a))
    alike = lambda m: F.when(size(m["v"]) * size(F.col("mine.v")) > 1e-9, _dot(m["v"], F.col("mine.v")) / (size(m["v"]) * size(F.col("mine.v")))).otherwise(0.0)
    others = F.filter("movers", lambda m: m["entity"] != F.col("best.m"))
    pick = F.array_min(F.transform(others, lambda m: F.struct((-alike(m)).alias("c"), m["entity"].alias("e"))))["e"]
    g = g.withColumn("effector", F.when(F.col("best").isNotNull(), pick))
    hand = F.get(F.filter("movers", lambda m: m["entity"] == F.col("effector")), F.lit(0))
    g = g.withColumn("hand", hand)
    close = F.coalesce(F.col("hand.late") & F.col("mine.late") & (gap(F.col("hand"), F.col("mine")) < SEPARATE), F.lit(False))
    return g.select(*keys, F.col("best.m").alias("carried"), F.col("best.s").alias("receptacle"), "effector", close.alias("ambiguous"))

"""Operators on pixel rows (rollout_id, t, x, y, r, g, b): one row a pixel, so plans stay relational at any frame size.

A frame is never gathered: masks are sets of (rollout_id, x, y), and aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the drift signal: its scale in gray levels, frames needed, least share of background, frames looked at, margin in pixels.
SCALE, LEAST_FRAMES, LEAST_BACKGROUND, SAMPLES, MARGIN = 12.0, 4, 0.2, 24, 6


def _signal(df: DataFrame, name: str, value: Column, ok: Column) -> DataFrame:
    ok = F.coalesce(ok, F.lit(False))
    return df.select("rollout_id", F.lit(name).alias("signal"), F.when(ok, "ok").otherwise("evidence_missing").alias("status"), F.when(ok, value).alias("value"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0)


def centroids(masks: DataFrame, least: int = 1) -> DataFrame:
    """masks (rollout_id, role, t, x, y) -> area and centre of each role and frame; the centre is null below `least` pixels."""
    big = F.col("area") >= least
    g = masks.groupBy("rollout_id", "role", "t").agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return g.select("rollout_id", "role", "t", "area", F.when(big, F.col("cx")).alias("cx"), F.when(big, F.col("cy")).alias("cy"))


def colour_bindings(areas: DataFrame, frames: DataFrame) -> DataFrame:
    """centroids and frames (rollout_id, n) -> a row a role: bound if seen in the first max(3, n div 20) frames, quality the share of frames seen."""
    g = areas.filter("area > 0").groupBy("rollout_id", "role").agg(F.min("t").alias("first"), F.countDistinct("t").alias("seen"))
    j = g.join(frames, "rollout_id")
    return j.select("rollout_id", "role", (F.col("first") < F.greatest(F.lit(3), F.expr("n div 20"))).alias("bound"), (F.col("seen") / F.col("n")).alias("quality"))


def colour_visibility(areas: DataFrame) -> DataFrame:
    """Area over the greatest area of the role."""
    w = Window.partitionBy("rollout_id", "role")
    return areas.select("rollout_id", "role", "t", F.coalesce(F.try_divide(F.col("area").cast("double"), F.max("area").over(w)), F.lit(0.0)).alias("visibility"))


def foreground(masks: DataFrame, sizes: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Union of all masks over roles and time, each pixel also put at eight offsets of `margin`, held inside the frame.

    sizes: rollout_id, w, h. Returns distinct (rollout_id, x, y).
    """
    near = F.explode(F.array(*map(F.lit, sorted({-margin, 0, margin}))))
    union = masks.select("rollout_id", "x", "y").distinct().join(sizes, "rollout_id")
    moved = union.withColumn("dx", near).withColumn("dy", near)
    held = lambda c, d, n: F.least(F.greatest(F.col(c) + F.col(d), F.lit(0)), F.col(n) - 1)
    return moved.select("rollout_id", held("x", "dx", "w").alias("x"), held("y", "dy", "h").alias("y")).distinct()


def sampled_times(n: Column, samples: int = SAMPLES) -> Column:
    """Distinct whole frames of an even grid of at most `samples` points over 1 .. n - 1; n is 2 or more."""
    k = F.least(F.lit(samples), n - 1)
    step = F.when(k > 1, (n - 2) / (k - 1)).otherwise(0.0)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when((i == k - 1) & (k > 1), n - 1).otherwise(F.floor(1 + i * step)).cast("int")))


def anchor_deviation(pixels: DataFrame, fg: DataFrame) -> DataFrame:
    """Mean absolute gray deviation of each later frame from frame 0 over the background: rollout_id, t, dev, background (pixels)."""
    bg = pixels.join(fg, ["rollout_id", "x", "y"], "left_anti").select("rollout_id", "t", "x", "y", gray(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    first = bg.filter("t = 0").select("rollout_id", "x", "y", F.col("v").alias("v0"))
    j = bg.filter("t > 0").join(first, ["rollout_id", "x", "y"])
    return j.groupBy("rollout_id", "t").agg(F.avg(F.abs(F.col("v") - F.col("v0"))).alias("dev"), F.count("*").alias("background"))


def background_drift(pixels: DataFrame, masks: DataFrame, sizes: DataFrame, margin: int = MARGIN) -> DataFrame:
    """exp(-mean deviation of the late half of the sampled frames / SCALE); missing for short rollouts or little background.

    sizes: rollout_id, w, h, n (frames).
    """
    dev = anchor_deviation(pixels, foreground(masks, sizes.select("rollout_id", "w", "h"), margin))
    times = sizes.filter("n >= 2").select("rollout_id", F.posexplode(F.array_sort(sampled_times(F.col("n")))).alias("k", "t"))
    times = times.withColumn("of", F.count("*").over(Window.partitionBy("rollout_id"))).filter("k >= of div 2")
    late = times.join(dev, ["rollout_id", "t"]).groupBy("rollout_id").agg(F.avg("dev").alias("late"), F.max("background").alias("background"))
    j = sizes.join(late, "rollout_id", "left")
    ok = (F.col("n") >= LEAST_FRAMES) & (F.col("background") >= LEAST_BACKGROUND * F.col("w") * F.col("h"))
    return _signal(j, "background_drift", F.exp(-F.col("late") / SCALE), ok)

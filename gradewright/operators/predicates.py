"""Predicates over a window of frames: (status, holds, margin). Missing evidence is a value, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.errors import SpecError
from gradewright.sources.domain import hyp

MISSING = "evidence_missing"
BINARY = ("contained", "co_located", "separated", "approaching")
#: The scale of the logistic squash of margins, by kind.
TAU = {"contained": 3.0, "co_located": 3.0, "separated": 3.0, "approaching": 0.5, "stationary": 0.5, "present": 0.15}
#: Default parameters.
TOL_STATIONARY, TOL_NEAR, ERODE, ERODE_TOP, PRESENT = 1.5, 12.0, 5.0, 0.0, 0.5


def measure(window: DataFrame, keys: list[str], region: DataFrame | None = None, params: dict | None = None) -> DataFrame:
    """What every predicate needs of a window of frames (sx, sy, sv, ox, oy, ...), in one aggregation over keys.

    The step from frame to frame is taken inside the window, so it is one row shorter than the window.
    """
    p = params or {}
    w = Window.partitionBy(*keys).orderBy("t")
    step = hyp(F.col("sx") - F.lag("sx").over(w), F.col("sy") - F.lag("sy").over(w))
    d = window.withColumn("step", step).withColumn("dist", hyp(F.col("sx") - F.col("ox"), F.col("sy") - F.col("oy")))
    inside = F.lit(None).cast("double")
    if region is not None:
        d = d.join(region, "rollout_id", "left")
        e, top = p.get("erode_px", ERODE), p.get("erode_top_px", ERODE_TOP)
        inside = F.when(F.col("sx").isNotNull(), F.least(F.col("sx") - (F.col("x0") + e), F.col("x1") - e - F.col("sx"),
                                                         F.col("sy") - (F.col("y0") + top), F.col("y1") - e - F.col("sy")))
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("sx").alias("s_seen"), F.count("ox").alias("o_seen"), F.max("step").alias("max_step"),
        F.max("dist").alias("max_dist"), F.min("dist").alias("min_dist"), F.regr_slope("dist", "t").alias("slope"), F.count("dist").alias("n_dist"),
        F.avg(F.when(F.col("sv") > 0, 1.0).otherwise(0.0)).alias("seen_share"), F.min(inside).alias("inside"),
        *([F.max("area").alias("area")] if region is not None else []))


def tolerance(params: dict, area: Column) -> Column:
    """tol_rel times the root of the object's area where both are there, else tol or its default."""
    tol = F.lit(float(params.get("tol", TOL_NEAR)))
    if params.get("tol_rel"):
        return F.coalesce(F.lit(float(params["tol_rel"])) * F.sqrt(F.when(area > 0, area)), tol)
    return tol


def evaluate(kind: str, params: dict | None = None) -> Column:
    """struct(status, holds, margin) of one predicate over the columns of `measure`."""
    p = params or {}
    n, full = F.col("n"), (F.col("n") > 0) & (F.col("s_seen") == F.col("n"))
    both = full & (F.col("o_seen") == n)
    if kind == "present":
        ok, margin = n > 0, F.col("seen_share") - PRESENT
        holds = margin >= 0
    elif kind == "stationary":
        tol = F.lit(float(p.get("tol", TOL_STATIONARY)))
        ok, margin = full, F.coalesce(tol - F.col("max_step"), tol)
        holds = margin >= 0
    elif kind == "contained":
        ok, margin = full & F.col("inside").isNotNull(), F.col("inside")
        holds = margin > 0
    elif kind == "co_located":
        ok, margin = both, tolerance(p, F.col("area") if p.get("tol_rel") else F.lit(None)) - F.col("max_dist")
        holds = margin > 0
    elif kind == "separated":
        ok, margin = both, F.col("min_dist") - tolerance(p, F.col("area") if p.get("tol_rel") else F.lit(None))
        holds = margin > 0
    elif kind == "approaching":
        ok, margin = both & (n >= 3), -F.col("slope")
        holds = margin > 0
    else:
        raise SpecError(f"unknown predicate kind {kind!r}")
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, "ok").otherwise(MISSING).alias("status"), F.coalesce(ok & holds, F.lit(False)).alias("holds"),
                    F.when(ok, margin).otherwise(0.0).alias("margin"))


def squash(margin: Column, kind: str) -> Column:
    return 1 / (1 + F.exp(-margin / TAU[kind]))


def conjunction(results: list[Column]) -> Column:
    """struct(status, value, margin): any missing conjunct makes the whole missing; it beats a failed one."""
    parts = F.array(*results)
    missing = F.exists(parts, lambda r: r["status"] != "ok")
    low = F.array_min(F.transform(parts, lambda r: r["margin"]))
    value = F.forall(parts, lambda r: r["holds"]).cast("double")
    return F.struct(F.when(missing, MISSING).otherwise("ok").alias("status"), F.when(~missing, value).alias("value"), F.when(~missing, low).alias("margin"))

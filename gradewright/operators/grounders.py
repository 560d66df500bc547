"""Grounders: from frames or detections to tracks, bindings, regions and masks of a specification's roles.

Each returns a Grounded: tracks (rollout_id, policy, role, t, x, y, vis), bindings (rollout_id, policy, role, bound,
quality, reason), regions (rollout_id, policy, role, x0, y0, x1, y1, area) and masks (rollout_id, role, h, w, mask: a
bit a pixel, set where the role ever was). Frames are (path, t, h, w, pixels); a path is a rollout_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.operators import induction, linking
from gradewright.operators.episode import episodes
from gradewright.spec import Role, TaskSpec

#: Words of the colour range that a role's candidates name, in the order in which they are tried.
RANGES = {"red": ((150, 0, 0), (255, 90, 90)), "green": ((0, 120, 0), (90, 230, 110)), "blue": ((0, 0, 150), (90, 110, 255))}
#: Quality of a role that could be another, and the factor of one that moves against its signature.
AMBIGUOUS, INCONSISTENT = 0.5, 0.25
#: Least range of a moving role and greatest of a static one, as shares of the diagonal; stride of detection.
MOVING, STATIC, STRIDE = 0.03, 0.25, 8
#: The entity that stands for a role of this name.
SLOTS = {"carried_object": "carried", "receptacle": "receptacle", "gripper": "effector"}


@dataclass(frozen=True)
class Grounded:
    spec: TaskSpec
    tracks: DataFrame
    bindings: DataFrame
    regions: DataFrame | None = None
    masks: DataFrame | None = None
    frames: DataFrame | None = None
    actions: DataFrame | None = None
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give up what the grounder keeps in memory; a later run over changed files would else find it again."""
        for d in self.held:
            d.unpersist()

    def episodes(self) -> DataFrame:
        """A row a rollout, also for one whose roles are all unbound."""
        keys = ["rollout_id", "policy"]
        found = episodes(self.tracks, self.spec, keys, self.bindings, self.regions, self.actions)
        out = self.bindings.select(*keys).distinct().join(found, keys, "left")
        empty = F.expr("cast(map() as map<string,array<struct<x:double,y:double,vis:double>>>)")
        none = F.array(*[F.struct(F.lit(r.name).alias("role"), F.lit(False).alias("bound"), F.lit(r.required).alias("required"), F.lit(0.0).alias("quality"), F.lit("").alias("reason")) for r in self.spec.roles])
        blank = {"tracks": F.coalesce("tracks", empty), "n": F.coalesce("n", F.lit(0)), "bindings": F.coalesce("bindings", none)}
        return out.withColumns(blank).select(*found.columns)

    def with_tables(self, **tables) -> Grounded:
        return replace(self, **tables)


def colour_of(role: Role) -> tuple | None:
    """The range of the first candidate that holds a colour word."""
    return next((RANGES[k] for c in role.candidates for k in RANGES if k in c.lower()), None)


_SEEN = "path string, role string, t int, h int, w int, area long, cx double, cy double, mask binary"


def _merged_masks(seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a packed mask a frame -> one mask a role, the union over time, with its box and area.

    A rollout's masks meet in one task a role: H * W / 8 bytes a frame.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["h"].iloc[0]), int(rows["w"].iloc[0])
        union = np.bitwise_or.reduce(np.stack([np.frombuffer(m, np.uint8) for m in rows["mask"]]), axis=0)
        ys, xs = np.nonzero(np.unpackbits(union, count=h * w).reshape(h, w))
        box = (float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1)) if len(xs) else (None,) * 4
        return pd.DataFrame([(*key, h, w, union.tobytes(), *box, float(len(xs)))], columns=[*keys, "h", "w", "mask", "x0", "y0", "x1", "y1", "area"])

    schema = "rollout_id string, role string, h int, w int, mask binary, x0 double, y0 double, x1 double, y1 double, area double"
    return seen.groupBy(*keys).applyInPandas(run, schema)


def _policies(policies: DataFrame | None, d: DataFrame) -> DataFrame:
    return d.join(policies, "rollout_id", "left") if policies is not None else d.withColumn("policy", F.lit(""))


def colour(frames: DataFrame, spec: TaskSpec, policies: DataFrame | None = None) -> Grounded:
    """blob.color: a role is where pixels lie in the colour range that its candidates name.

    It is bound if it was seen in the first max(3, n div 20) frames, with the share of frames in which it was seen as
    quality; visibility is its area over its greatest area. policies: rollout_id, policy.
    """
    ranges = {r.name: colour_of(r) for r in spec.roles}
    looked = {k: v for k, v in ranges.items() if v}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, t, h, w, pixels in zip(*(c.to_pylist() for c in b.columns)):
                image = np.frombuffer(pixels, np.uint8).reshape(h, w, 3)
                for role, (low, high) in looked.items():
                    mask = ((image >= low) & (image <= high)).all(axis=-1)
                    ys, xs = np.nonzero(mask)
                    out.append((path, role, t, h, w, len(xs), *((xs.mean(), ys.mean()) if len(xs) else (None, None)), np.packbits(mask).tobytes()))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
            names = [x.split()[0] for x in _SEEN.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 9, kinds)], names)

    seen = frames.select("path", "t", "h", "w", "pixels").mapInArrow(run, _SEEN).withColumnRenamed("path", "rollout_id").persist()
    w = Window.partitionBy("rollout_id", "role")
    t = seen.withColumn("most", F.max("area").over(w))
    tracks = t.select("rollout_id", "role", "t", F.col("cx").alias("x"), F.col("cy").alias("y"), F.when(F.col("most") > 0, F.col("area") / F.col("most")).otherwise(0.0).alias("vis"))
    g = seen.groupBy("rollout_id", "role").agg(F.count("*").alias("n"), F.count_if(F.col("area") > 0).alias("k"), F.min(F.when(F.col("area") > 0, F.col("t"))).alias("first"))
    early = F.coalesce(F.col("first") < F.greatest(F.lit(3), F.expr("n div 20")), F.lit(False))
    found = g.select("rollout_id", "role", early.alias("bound"), F.when(early, F.col("k") / F.col("n")).otherwise(0.0).alias("quality"), F.when(early, "").otherwise("never visible near the start").alias("reason"))
    blank = [(k, "no colour word among the candidates") for k, v in ranges.items() if not v]
    if blank:
        none = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.lit(why).alias("reason")) for k, why in blank]))
        found = found.unionByName(frames.select(F.col("path").alias("rollout_id")).distinct().select("rollout_id", none.alias("r")).select("rollout_id", "r.role", F.lit(False).alias("bound"), F.lit(0.0).alias("quality"), "r.reason"))
    return _grounded(frames, spec, policies, tracks, found, _merged_masks(seen, ["rollout_id", "role"]), seen)


def _grounded(frames: DataFrame | None, spec: TaskSpec, policies: DataFrame | None, tracks: DataFrame, found: DataFrame, masks: DataFrame | None, *held: DataFrame) -> Grounded:
    """The artifacts of bound roles alone, with policies."""
    bound = found.filter("bound").select("rollout_id", "role")
    tracks = tracks.join(bound, ["rollout_id", "role"], "left_semi")
    regions = None
    if masks is not None:
        masks = masks.join(bound, ["rollout_id", "role"], "left_semi").persist()
        held = (*held, masks)
        regions = _policies(policies, masks.filter("area > 0").select("rollout_id", "role", "x0", "y0", "x1", "y1", "area"))
        masks = masks.select("rollout_id", "role", "h", "w", "mask")
    return Grounded(spec, _policies(policies, tracks), _policies(policies, found), regions, masks, frames, held=held)


def passthrough(frames: DataFrame, spec: TaskSpec, policies: DataFrame | None = None) -> Grounded:
    """frames.passthrough: every role of the specification is unbound, in every rollout; for judges that need no objects."""
    roles = F.explode(F.array(*[F.lit(r.name) for r in spec.roles]))
    found = frames.select(F.col("path").alias("rollout_id")).distinct().select("rollout_id", roles.alias("role"), F.lit(False).alias("bound"), F.lit(0.0).alias("quality"), F.lit("objects are not grounded").alias("reason"))
    spark = frames.sparkSession
    tracks = spark.createDataFrame([], "rollout_id string, role string, t int, x double, y double, vis double")
    return _grounded(frames, spec, policies, tracks, found, None)


def relational(frames: DataFrame, spec: TaskSpec, policies: DataFrame | None = None, k: int = induction.K, seed: int = 0, moving: float = induction.MOVING) -> Grounded:
    """relational.motion: roles by how entities move and end, whatever they look like.

    Quality is the share of frames in which the entity was seen, and AMBIGUOUS at most for hand and block that never part.
    """
    found = induction.entities(frames, k, seed).persist()
    wide = found.groupBy("path").agg(F.max("diagonal").alias("diagonal"))
    who = induction.roles(found.select("path", "entity", "t", "x", "y"), ["path"], wide, moving).persist()
    slots = F.explode(F.array(*[F.struct(F.lit(r.name).alias("role"), F.col(SLOTS[r.name]).alias("entity"), (F.col("ambiguous") & F.lit(SLOTS[r.name] != "receptacle")).alias("doubt")) for r in spec.roles if r.name in SLOTS]))
    named = who.select("path", slots.alias("s")).select("path", "s.role", "s.entity", "s.doubt")
    rows = found.join(named.filter("entity is not null"), ["path", "entity"])
    w = Window.partitionBy("path", "role")
    t = rows.withColumn("most", F.greatest(F.max("area").over(w), F.lit(1)))
    tracks = t.select(F.col("path").alias("rollout_id"), "role", "t", "x", "y", (F.col("area") / F.col("most")).alias("vis"))
    q = rows.groupBy("path", "role").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("seen"))
    all_roles = frames.select("path").distinct().select("path", F.explode(F.array(*[F.lit(r.name) for r in spec.roles])).alias("role"))
    b = all_roles.join(named, ["path", "role"], "left").join(q, ["path", "role"], "left")
    bound = F.col("seen").isNotNull()
    doubt = F.coalesce("doubt", F.lit(False)) & bound
    quality = F.when(doubt, F.least(F.col("seen"), F.lit(AMBIGUOUS))).otherwise(F.coalesce("seen", F.lit(0.0)))
    why = F.when(~bound, "no entity moves like this role").when(doubt, "ambiguous: two movers never part").otherwise("")
    found_roles = b.select(F.col("path").alias("rollout_id"), "role", bound.alias("bound"), quality.alias("quality"), why.alias("reason"))
    masks = rows.filter("mask is not null").select(F.col("path").alias("rollout_id"), "role", "h", "w", "mask")
    return _grounded(frames, spec, policies, tracks, found_roles, _merged_masks(masks, ["rollout_id", "role"]), found, who)


def phrases(role: Role) -> list[str]:
    """What a detector is asked for: the candidates, else the role's own name."""
    return [c.lower() for c in role.candidates] or [role.name.replace("_", " ").lower()]


def open_vocabulary(detections: DataFrame, samples: DataFrame, spec: TaskSpec, policies: DataFrame | None = None) -> Grounded:
    """openvocab: a detector's boxes, linked to one track a role, made dense and checked against how the role should move.

    detections: rollout_id, t, k, label, x0, y0, x1, y1, score on the sampled frames; samples: rollout_id, t (every sampled
    frame, also those without a box), n (frames of the rollout), diagonal. A label belongs to a role if one holds the
    other. Between observed samples a track is linear and outside them unknown; a sample's score holds until the next one.
    A track whose range is against its role's motion keeps a quarter of its quality.
    """
    wanted = F.array(*[F.struct(F.lit(r.name).alias("role"), F.lit(r.motion).alias("motion"), F.array(*map(F.lit, phrases(r))).alias("phrases")) for r in spec.roles])
    match = lambda r: F.exists(r["phrases"], lambda p: F.contains(F.lower("label"), p) | F.contains(p, F.lower("label")))
    d = detections.withColumn("r", F.explode(F.filter(wanted, match))).withColumn("role", F.col("r.role"))
    d = d.join(samples.select("rollout_id", "diagonal").distinct(), "rollout_id")
    grid = samples.select("rollout_id", "t", "n", "diagonal").withColumn("r", F.explode(wanted)).select("rollout_id", "t", "n", "diagonal", F.col("r.role").alias("role"), F.col("r.motion").alias("motion"))
    # a sample without a box counts as a miss: one row without a score
    missed = grid.join(d.select("rollout_id", "role", "t").distinct(), ["rollout_id", "role", "t"], "left_anti")
    box = ("x0", "y0", "x1", "y1", "score")
    rows = d.select("rollout_id", "role", "t", "k", *box, "diagonal").unionByName(missed.select("rollout_id", "role", "t", F.lit(0).cast("long").alias("k"), *[F.lit(None).cast("double").alias(c) for c in box], "diagonal"))
    linked = linking.link_each(rows)
    s = grid.join(linked, ["rollout_id", "role", "t"], "left").withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    w = Window.partitionBy("rollout_id", "role").orderBy("t")
    s = s.withColumn("until", F.coalesce(F.lead("t").over(w), F.col("n")))
    observed = F.when(F.col("x").isNotNull(), F.struct("t", "x", "y"))
    s = s.withColumn("a", F.last(observed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(observed, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    dense = s.select("rollout_id", "role", "a", "b", F.coalesce("score", F.lit(0.0)).alias("vis"), F.explode(F.sequence(F.col("t"), (F.col("until") - 1).cast("int"))).alias("t"))

    def between(c: str) -> Column:
        share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
        return F.when(F.col("t") == F.col("a.t"), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share)

    tracks = dense.select("rollout_id", "role", "t", between("x").alias("x"), between("y").alias("y"), "vis")
    g = s.groupBy("rollout_id", "role").agg(F.count("*").alias("s"), F.count("x").alias("k"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("range"), F.first("motion").alias("motion"), F.first("diagonal").alias("diagonal"))
    fits = F.when(F.col("k") < 2, True).when(F.col("motion").isin("co_moves_with_effector", "actuated"), F.col("range") >= MOVING * F.col("diagonal")).when(F.col("motion") == "static", F.col("range") <= STATIC * F.col("diagonal")).otherwise(True)
    share = F.col("k") / F.col("s")
    why = F.when(F.col("k") == 0, "nothing detected").when(~fits, F.concat(F.lit("moves against its signature "), "motion")).otherwise("")
    found = g.select("rollout_id", "role", (F.col("k") > 0).alias("bound"), F.when(fits, share).otherwise(share * INCONSISTENT).alias("quality"), why.alias("reason"))
    return _grounded(None, spec, policies, tracks, found, None)

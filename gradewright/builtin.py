"""The components of the engine under their names. Importing this module registers them.

grounder: ground(frames, spec, policies) -> Grounded, and `params`, which are part of a cache key. gate_signal: either
column(spec) over an episode row, or table(grounded) -> rollout_id, s. channel: the same, with `caps`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.components import register
from gradewright.operators import appearance, dtw, grounders, induction, replies
from gradewright.operators import episode as E
from gradewright.operators.grounders import Grounded
from gradewright.spec import TaskSpec


@dataclass(frozen=True)
class Caps:
    """What a channel needs and may do; only an eligible one takes part in the verdict."""

    eligible: bool = False
    reference_free: bool = True
    value_range: tuple[float, float] = (0.0, 1.0)


@register("grounder", "blob.color")
class ColourGrounder:
    name, version = "blob.color", "0.1.0"
    params: dict = {}

    def ground(self, frames: DataFrame, spec: TaskSpec, policies: DataFrame | None = None) -> Grounded:
        return grounders.colour(frames, spec, policies)


@register("grounder", "relational.motion")
class RelationalGrounder:
    name, version = "relational.motion", "0.1.0"

    def __init__(self, k: int = induction.K, seed: int = 0, moving_frac: float = induction.MOVING) -> None:
        self.params = {"k": k, "seed": seed, "moving_frac": moving_frac}

    def ground(self, frames: DataFrame, spec: TaskSpec, policies: DataFrame | None = None) -> Grounded:
        return grounders.relational(frames, spec, policies, self.params["k"], self.params["seed"], self.params["moving_frac"])


@register("grounder", "frames.passthrough")
class PassthroughGrounder:
    name, version = "frames.passthrough", "0.1.0"
    params: dict = {}

    def ground(self, frames: DataFrame, spec: TaskSpec, policies: DataFrame | None = None) -> Grounded:
        return grounders.passthrough(frames, spec, policies)


@register("grounder", "openvocab.gdino_sam")
class OpenVocabularyGrounder:
    """detect(frames, phrases) -> detections and samples (see `grounders.open_vocabulary`); the detector is the caller's."""

    name, version = "openvocab.gdino_sam", "0.1.0"

    def __init__(self, detect: Callable[[DataFrame, dict[str, list[str]]], tuple[DataFrame, DataFrame]] | None = None, stride: int = grounders.STRIDE) -> None:
        self.detect, self.params = detect, {"stride": stride}

    def ground(self, frames: DataFrame, spec: TaskSpec, policies: DataFrame | None = None) -> Grounded:
        if self.detect is None:
            from gradewright.errors import MissingDependency

            raise MissingDependency("a detector", "openvocab")
        detections, samples = self.detect(frames.filter(F.col("t") % self.params["stride"] == 0), {r.name: grounders.phrases(r) for r in spec.roles})
        return grounders.open_vocabulary(detections, samples, spec, policies).with_tables(frames=frames)


def _column_signal(key: str, build: Callable[[], Column]) -> type:
    return register("gate_signal", key)(type(key.title().replace("_", ""), (), {"name": key, "version": "0.1.0", "column": lambda self, spec: build()}))


BindingHealth = _column_signal("binding_health", E.binding_health)
Permanence = _column_signal("permanence", E.permanence)
MotionSanity = _column_signal("motion_sanity", E.motion_sanity)


def _nothing(g: Grounded, name: str, why: str) -> DataFrame:
    return g.bindings.select("rollout_id").distinct().select("rollout_id", E.signal(name, F.lit(False), F.lit(None), F.lit(why)).alias("s"))


@register("gate_signal", "track_continuity")
class TrackContinuity:
    name, version = "track_continuity", "0.1.0"

    def table(self, g: Grounded) -> DataFrame:
        """The diagonal is that of the masks, else of the frames."""
        if g.masks is None and g.frames is None:
            return _nothing(g, self.name, "no observed track")
        sized = (g.masks.select("rollout_id", "h", "w") if g.masks is not None else g.frames.select(F.col("path").alias("rollout_id"), "h", "w")).groupBy("rollout_id").agg(F.hypot(F.max("h"), F.max("w")).alias("diagonal"))
        e = g.episodes().join(sized, "rollout_id", "left").withColumn("diagonal", F.coalesce("diagonal", F.lit(1.0)))
        return e.select("rollout_id", E.track_continuity(F.col("diagonal")).alias("s"))


@register("gate_signal", "action_video_consistency")
class ActionVideoConsistency:
    name, version = "action_video_consistency", "0.1.0"

    def __init__(self, effector_roles: Sequence[str] = ("gripper",), chunk: int = E.CHUNK) -> None:
        self.effectors, self.chunk = tuple(effector_roles), chunk

    def table(self, g: Grounded) -> DataFrame:
        e = g.episodes()
        if "actions" not in e.columns:
            e = e.withColumn("actions", F.lit(None).cast("array<struct<ax:double,ay:double>>"))
        return e.select("rollout_id", E.action_consistency(self.effectors, self.chunk).alias("s"))


@register("gate_signal", "background_drift")
class BackgroundDrift:
    name, version = "background_drift", "0.1.0"

    def table(self, g: Grounded) -> DataFrame:
        return _nothing(g, self.name, "no frames") if g.frames is None else appearance.drift(g.frames, g.masks, g.bindings)


@register("gate_signal", "appearance_consistency")
class AppearanceConsistency:
    name, version = "appearance_consistency", "0.1.0"

    def table(self, g: Grounded) -> DataFrame:
        return _nothing(g, self.name, "no frames") if g.frames is None else appearance.appearance(g.frames, g.tracks, g.bindings)


@register("channel", "success.predicates")
class PredicateSuccess:
    name, version, caps = "success.predicates", "0.1.0", Caps(eligible=True)

    def column(self, spec: TaskSpec) -> Column:
        return E.success(spec)


@register("channel", "success.tl_dtmc")
class Sustained:
    name, version, caps = "success.tl_dtmc", "0.1.0", Caps()

    def __init__(self, tau: float = 1.0, stride: int = 1) -> None:
        self.tau, self.stride = tau, stride

    def column(self, spec: TaskSpec) -> Column:
        return E.sustained(spec, self.stride, self.tau)


@register("channel", "phase.ordered_coverage")
class PhaseCoverage:
    name, version, caps = "phase.ordered_coverage", "0.1.0", Caps()

    def __init__(self, window: int = E.PHASE_WIDTH, stride: int = E.PHASE_STRIDE) -> None:
        self.window, self.stride = window, stride

    def column(self, spec: TaskSpec) -> Column:
        return E.phase_coverage(spec, self.window, self.stride)


@register("channel", "progress.goal_distance")
class GoalDistance:
    name, version, caps = "progress.goal_distance", "0.1.0", Caps()

    def __init__(self, subject: str = "carried_object", target: str = "receptacle") -> None:
        self.subject, self.target = subject, target

    def column(self, spec: TaskSpec) -> Column:
        return E.goal_distance(self.subject, self.target)


def _no_score(g: Grounded, name: str, why: str) -> DataFrame:
    return g.bindings.select("rollout_id").distinct().select("rollout_id", E.score(name, F.lit(False), F.lit(None), F.lit(0.0), F.lit(why)).alias("s"))


@register("channel", "trajectory.dtw_demo")
class TrajectoryToDemos:
    name, version, caps = "trajectory.dtw_demo", "0.1.0", Caps(reference_free=False)

    def __init__(self, demo_tracks: Sequence[Sequence[tuple]] = (), role: str = "carried_object", scale: float = dtw.SCALE) -> None:
        self.demos, self.role, self.scale = list(demo_tracks), role, scale

    def table(self, g: Grounded) -> DataFrame:
        if not self.demos:
            return _no_score(g, self.name, "no demo tracks")
        return dtw.demo_scores(g.episodes().select("rollout_id", E.track(self.role).alias("points")), self.demos, scale=self.scale).withColumnRenamed("score", "s")


@register("channel", "progress.gvl")
class JudgedProgress:
    name, version, caps = "progress.gvl", "0.1.0", Caps()

    def __init__(self, backend: Callable | None = None, n_frames: int = 12, n_shuffles: int = 2, seed: int = 0) -> None:
        self.backend, self.n_frames, self.runs, self.seed = backend, n_frames, n_shuffles, seed

    def table(self, g: Grounded) -> DataFrame:
        if self.backend is None or g.frames is None:
            return _no_score(g, self.name, "no judge" if self.backend is None else "no frames")
        from gradewright.judges import ask

        found = replies.progress(ask(g.frames, self.backend, g.spec.prompt, self.n_frames, self.runs, self.seed), ["rollout_id"])
        return found.select("rollout_id", F.col("score").alias("s"))


@register("channel", "success.demo_match")
class DemoMatch:
    """prototypes: (of successes, of failures), each a list of unit vectors; embeddings: rollout_id, v (a unit vector a rollout)."""

    name, version, caps = "success.demo_match", "0.1.0", Caps(eligible=True, reference_free=False)
    #: Fixed value: the temperature of the margin.
    TEMPERATURE = 0.05

    def __init__(self, prototypes: tuple[Sequence, Sequence] = ((), ()), embeddings: DataFrame | None = None) -> None:
        self.prototypes, self.embeddings = prototypes, embeddings

    def table(self, g: Grounded) -> DataFrame:
        good, bad = self.prototypes
        if not len(good) or not len(bad) or self.embeddings is None:
            return _no_score(g, self.name, "no prototypes of both outcomes" if self.embeddings is not None else "no embedded frames")
        weights = [sum(x) / len(good) - sum(y) / len(bad) for x, y in zip(zip(*good), zip(*bad))]
        margin = F.aggregate(F.zip_with("v", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        d = g.bindings.select("rollout_id").distinct().join(self.embeddings, "rollout_id", "left").withColumn("margin", margin)
        sure = F.least(F.lit(1.0), F.abs("margin") / self.TEMPERATURE / 4)
        why = F.when(F.col("margin").isNull(), "no embedded frames")
        return d.select("rollout_id", E.score(self.name, F.col("margin").isNotNull(), 1 / (1 + F.exp(-F.col("margin") / self.TEMPERATURE)), sure, why, F.create_map(F.lit("margin"), F.col("margin"))).alias("s"))

"""Grading as a run: ground, measure, score, fold to cards, write them, and account for what failed."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright import VERSION, builtin, components  # noqa: F401 - builtin registers the engine's own components
from gradewright.errors import PluginError, StoreError
from gradewright.operators import episode as E
from gradewright.operators.grounders import Grounded
from gradewright.sources import files
from gradewright.sources.store import Store, key
from gradewright.spec import TaskSpec

#: Failed rollouts that an error names; all of them are in the table `failures`.
NAMED = 20


@dataclass(frozen=True)
class Config:
    """What a run is made of, by the components' names; params by name. It is never changed: `replace` makes another."""

    grounder: str = "blob.color"
    signals: tuple[str, ...] = ("permanence", "binding_health", "motion_sanity")
    channels: tuple[str, ...] = ("success.predicates", "progress.goal_distance")
    policy: tuple[tuple, ...] = E.POLICY
    threshold: float = 0.5
    params: dict[str, dict] = field(default_factory=dict)

    def component(self, kind: str, name: str):
        return components.find(kind, name)(**self.params.get(name, {}))

    def with_changes(self, **changes) -> Config:
        return replace(self, **({"params": {k: dict(v) for k, v in self.params.items()}} | changes))


def refuse_duplicates(rollouts: DataFrame, column: str = "id") -> None:
    """Ids must be unique, also after their names are made safe for files: cards are keyed by them."""
    name = F.regexp_replace(column, "[^A-Za-z0-9._-]+", "_")
    twice = rollouts.groupBy(name.alias("file")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).filter("n > 1").orderBy("file").limit(5).collect()
    if twice:
        raise PluginError("; ".join(f"rollout id {r.a!r} occurs {r.n} times" if r.a == r.b else f"rollout ids {r.a!r} and {r.b!r} share the file name {r.file!r}" for r in twice))


def cards(grounded: Grounded, config: Config) -> DataFrame:
    """Grade cards of all rollouts. Signals and channels that are columns are fused over one row a rollout; the others are joined."""
    d = grounded.episodes()

    def columns(kind: str, names: Sequence[str], prefix: str) -> list:
        nonlocal d
        out = []
        for i, name in enumerate(names):
            c = config.component(kind, name)
            if hasattr(c, "column"):
                out.append(c.column(grounded.spec))
            else:
                d = d.join(c.table(grounded).select("rollout_id", F.col("s").alias(f"__{prefix}{i}")), "rollout_id", "left")
                missing = E.signal(name, F.lit(False), F.lit(None), F.lit("not measured")) if kind == "gate_signal" else E.score(name, F.lit(False), F.lit(None), F.lit(0.0), F.lit("not measured"))
                out.append(F.coalesce(f"__{prefix}{i}", missing))
        return out

    signals = columns("gate_signal", config.signals, "signal")
    channels = columns("channel", config.channels, "channel")
    return E.cards(d, grounded.spec, signals, channels, policy=config.policy, threshold=config.threshold)


def frames_digest(frames: DataFrame) -> str:
    """Of all frames of all rollouts, in whatever order: sums of parts of each frame's SHA-256. No frame is an error: a blank
    digest would give every empty input one cache entry."""
    sha = F.sha2(F.concat_ws(":", F.col("path"), F.col("t").cast("string"), F.sha2("pixels", 256)), 256)
    parts = [F.sum(F.conv(F.substring(sha, 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    row = frames.agg(F.count("*").alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
    if not row.n:
        raise StoreError("there are no frames to digest")
    return hashlib.sha256(":".join(map(str, row)).encode()).hexdigest()


def cached_ground(store: Store, grounder, frames: DataFrame, spec: TaskSpec, policies: DataFrame | None = None) -> tuple[Grounded, bool]:
    """(what the grounder finds, whether it was found before): keyed by the frames, the specification, and the grounder's
    name, version and parameters."""
    k = key("ground", grounder.name, grounder.version, {"frames": frames_digest(frames), "spec": spec.content_hash()}, dict(grounder.params))
    names = ("tracks", "bindings", "regions", "masks")
    fresh: list[Grounded] = []

    def table(name: str):
        def build() -> DataFrame:
            if not fresh:
                fresh.append(grounder.ground(frames, spec, policies))
            found = getattr(fresh[0], name)
            return found if found is not None else frames.sparkSession.createDataFrame([], "absent boolean")

        return store.get_or_create(f"{k}-{name}", build)

    found = {n: table(n) for n in names}
    for g in fresh:
        g.release()
    tables = {n: None if d.columns == ["absent"] else d for n, (d, _) in found.items()}
    return Grounded(spec, frames=frames, **tables), all(hit for _, hit in found.values())


def grade(spark: SparkSession, root: str, spec: TaskSpec, out: str, config: Config | None = None, store: str | None = None) -> DataFrame:
    """Grade every rollout below root (rollout.json beside frames.npz); cards go to out/cards, what failed to out/failures,
    and a manifest to out/manifest also when the run fails. A rollout that can't be read fails alone: the others are
    graded, and the run ends with an error that names it."""
    config = config or Config()
    held: list[DataFrame] = []
    try:
        with files.manifest(spark, f"{out}/manifest", version=VERSION, spec=spec.name, spec_hash=spec.content_hash(), grounder=config.grounder, signals=list(config.signals), channels=list(config.channels)) as record:
            def kept(d: DataFrame) -> DataFrame:
                held.append(d.persist())
                return held[-1]

            rollouts = kept(files.rollouts(spark, root).select("id", "policy", "dir"))
            if rollouts.isEmpty():
                raise PluginError(f"there are no rollouts below {root}")
            refuse_duplicates(rollouts)
            raw = files.frames_or_errors(spark, root).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
            raw = kept(raw.join(rollouts.select("dir", "id"), "dir"))
            lost = rollouts.join(raw.select("dir").distinct(), "dir", "left_anti").select("id", F.lit("no frames.npz").alias("error"))
            failures = kept(raw.filter("error is not null").select("id", "error").unionByName(lost))
            good = raw.join(failures.select("id"), "id", "left_anti").select(F.col("id").alias("path"), "t", "h", "w", "pixels")
            policies = rollouts.select(F.col("id").alias("rollout_id"), "policy")
            failures.write.parquet(f"{out}/failures")
            n_failed, n = failures.count(), rollouts.count()
            if n_failed < n:
                grounder = config.component("grounder", config.grounder)
                grounded, record["cache_hit"] = cached_ground(Store(spark, store or f"{out}/store"), grounder, good, spec, policies)
                found = cards(grounded, config)
                found.withColumn("file", F.concat(F.regexp_replace("rollout_id", "[^A-Za-z0-9._-]+", "_"), F.lit(".json"))).write.parquet(f"{out}/cards")
            record |= {"rollouts": n, "failed": n_failed}
            if n_failed:
                named = "; ".join(f"{r.id}: {r.error}" for r in failures.orderBy("id").limit(NAMED).collect())
                raise PluginError(f"{n_failed} of {n} rollouts failed (the others' cards are in {out}/cards): {named}")
    finally:
        for d in held:  # a later run over changed files would else find them again
            d.unpersist()
    return spark.read.parquet(f"{out}/cards")

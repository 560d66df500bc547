"""A specification from demos: entities and roles by their motion, tolerances from how the demos end, and a self-test on
negatives minted from them. What can't tell its own demos from the negatives is refused."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright import VERSION
from gradewright.errors import SpecError
from gradewright.operators import episode as E
from gradewright.operators import grounders, induction
from gradewright.operators.columns import let, mean, steps_to
from gradewright.operators.cumulative import percentiles
from gradewright.spec import Origin, Predicate, Role, SelfTest, TaskSpec, transport_phases

#: Multiples of the fitted tolerance that a self-test tries, in order.
GRID = (0.6, 0.8, 1.0, 1.3, 1.7, 2.2)
#: Where a demo's end begins, factors of the fitted distance and speed, least and usual speed tolerance.
END, FAR, FAST, LEAST_SPEED, USUAL_SPEED = 0.85, 1.5, 2.0, 1.0, 1.5
#: Kinds of negative and the share of the demo at which each one turns wrong.
MINTS = {"reversed": 1.0, "frozen": 0.35, "truncated": 0.45, "stalled": 0.15}
BLOCK, CUP, HAND = "carried_object", "receptacle", "gripper"


def source_frame(kind: str, t: Column, n: Column) -> Column:
    """Which frame of a demo a negative shows at t: the demo run backwards; held from 35 % on; cut at 45 % and held there;
    its first 15 % over and over. All are as long as the demo."""
    at = F.greatest(F.lit(2), F.floor(n * MINTS[kind]).cast("int"))
    return {"reversed": n - 1 - t, "frozen": F.least(t, at), "truncated": F.least(t, at), "stalled": t % at}[kind]


def minted(rows: DataFrame, key: str = "path", kinds: tuple[str, ...] = tuple(MINTS)) -> DataFrame:
    """Rows of frames (key, t, anything) -> the same columns and `kind` of every negative, under keys of their own."""
    n = rows.groupBy(key).agg((F.max("t") + 1).alias("__n"))
    d = rows.select(key, "t").join(n, key)
    shown = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.least(source_frame(k, F.col("t"), F.col("__n")), F.col("__n") - 1).cast("int").alias("src")) for k in kinds]))
    d = d.select(key, "t", shown.alias("m")).select(key, F.col("t").alias("__t"), "m.kind", F.col("m.src").alias("t"))
    out = d.join(rows, [key, "t"]).withColumn("t", F.col("__t")).withColumn(key, F.concat(F.col(key).cast("string"), F.lit("#neg_"), "kind"))
    return out.select(*rows.columns, "kind")


def final_relations(episodes: DataFrame, subject: str, target: str) -> DataFrame:
    """One row a demo: rel, the distance of the subject's mean end place from the target's mean place over the root of the
    target's area (1 at least); speed, the greatest step of the subject in its end (null below two observations)."""
    s, o = E.track(subject), E.track(target)
    start = F.floor(F.size(s) * END)
    seen = lambda a: F.filter(a, lambda p: p["x"].isNotNull())
    end = F.filter(F.transform(s, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.alias("i"))), lambda p: p["x"].isNotNull() & (p["i"] >= start))

    def relation(w: Column) -> Column:
        e, r = w["e"], w["o"]
        at = lambda a, c: mean(F.transform(a, lambda p: p[c]))
        gap = F.sqrt((at(e, "x") - at(r, "x")) ** 2 + (at(e, "y") - at(r, "y")) ** 2)
        steps = steps_to(F.size(e), lambda i: E._gap(F.get(e, i), F.get(e, i - 1)), 1)
        return F.struct((gap / F.sqrt(F.greatest(F.coalesce(E.region(target)["area"], F.lit(1.0)), F.lit(1.0)))).alias("rel"), F.array_max(steps).alias("speed"))

    d = episodes.select("rollout_id", let(F.struct(end.alias("e"), seen(o).alias("o")), relation).alias("r"))
    return d.select("rollout_id", "r.rel", "r.speed").filter("rel is not null")


def tolerances(relations: DataFrame) -> DataFrame:
    """One row: tol_rel, 1.5 times the 95th percentile of rel; tol, twice that of speed (1 at least, 1.5 where there is none)."""
    p = percentiles(relations, "rel", {"rel": 0.95}).withColumn("j", F.lit(1)).join(percentiles(relations, "speed", {"speed": 0.95}).withColumn("j", F.lit(1)), "j")  # one row by one row
    return p.select((FAR * F.col("rel")).alias("tol_rel"), F.coalesce(F.greatest(FAST * F.col("speed"), F.lit(LEAST_SPEED)), F.lit(USUAL_SPEED)).alias("tol"))


@dataclass(frozen=True)
class Outcome:
    spec: TaskSpec
    accepted: bool
    factor: float
    demos_passed: int
    negatives_failed: int
    demos: int
    negatives: int

    @property
    def notes(self) -> str:
        where = f"tol_rel x{self.factor}"
        return f"separated at {where}" if self.accepted else f"best at {where}: {self.demos_passed} demos passed, {self.negatives_failed} negatives failed"


def grid_counts(verdicts: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """verdicts (is_demo, passed array<boolean>: one a multiple) -> place, factor, demos_passed, negatives_failed, demos,
    negatives, best (the multiple that is taken), accepted. What can't be evaluated has not passed.

    The first multiple at which all demos pass and all negatives fail is accepted; else the one with most demos, then
    negatives, then first in the grid.
    """
    d = verdicts.select("is_demo", F.posexplode("passed").alias("place", "ok")).groupBy("place").agg(
        F.count_if(F.col("is_demo") & F.coalesce("ok", F.lit(False))).alias("demos_passed"), F.count_if(~F.col("is_demo") & ~F.coalesce("ok", F.lit(False))).alias("negatives_failed"),
        F.count_if("is_demo").alias("demos"), F.count_if(~F.col("is_demo")).alias("negatives"))
    d = d.withColumn("factor", F.get(F.array(*map(F.lit, grid)), F.col("place"))).withColumn("all", (F.col("demos_passed") == F.col("demos")) & (F.col("negatives_failed") == F.col("negatives")))
    w = Window.partitionBy(F.lit(0))  # a row a multiple
    best = F.coalesce(F.min(F.when(F.col("all"), F.col("place"))).over(w), F.max_by("place", F.struct("demos_passed", "negatives_failed", (-F.col("place")).alias("p"))).over(w))
    return d.select(F.col("place").cast("long").alias("place"), "factor", "demos_passed", "negatives_failed", "demos", "negatives", (F.col("place") == best).alias("best"), F.max("all").over(w).alias("accepted"))


def selftest(spec: TaskSpec, demos: DataFrame, negatives: DataFrame, grounder, max_rounds: int = len(GRID)) -> Outcome:
    """Frames of demos and negatives, all under paths of their own, are grounded once; every multiple is judged in one pass."""
    fitted = any(p.kind == "co_located" and "tol_rel" in p.params for p in spec.success)
    grid = GRID[:max_rounds] if fitted else (1.0,)
    both = demos.select("path", "t", "h", "w", "pixels").unionByName(negatives.select("path", "t", "h", "w", "pixels"))
    grounded = grounder.ground(both, spec)
    episodes = grounded.episodes()
    tried = F.array(*[(E.success(spec.with_tolerance(m))["value"] >= 0.5) for m in grid])
    rows = grid_counts(episodes.select((~F.contains("rollout_id", F.lit("#neg_"))).alias("is_demo"), tried.alias("passed")), grid).collect()  # a row a multiple
    grounded.release()
    r = next(r for r in rows if r.best)
    return Outcome(spec.with_tolerance(r.factor) if r.accepted else spec, r.accepted, r.factor, r.demos_passed, r.negatives_failed, r.demos, r.negatives)


def compile_spec(demos: DataFrame, prompt: str, name: str = "compiled-task", grounder: str = "relational.motion", seed: int = 0, max_rounds: int = len(GRID)) -> TaskSpec:
    """demos: frames (path, t, h, w, pixels) of successes. Raises SpecError with REFUSE where roles can't be found in enough
    demos, or where no tolerance tells the demos from the negatives minted from the first two of them."""
    from gradewright import builtin, components  # noqa: F401 - builtin registers the grounders
    from gradewright.grading import frames_digest
    from gradewright.plans.tables import nearest_colour

    paths = [r[0] for r in demos.select("path").distinct().orderBy("path").collect()]  # demos are few
    if len(paths) < 2:
        raise SpecError(f"at least 2 demos are needed, there are {len(paths)}")
    found = induction.entities(demos, seed=seed).persist()
    wide = found.groupBy("path").agg(F.max("diagonal").alias("diagonal"))
    who = induction.roles(found.select("path", "entity", "t", "x", "y"), ["path"], wide).persist()
    ok = who.filter("carried is not null and receptacle is not null").count()
    if ok < max(2, len(paths) // 2):
        raise SpecError(f"REFUSE: in {ok} of {len(paths)} demos something moves and settles at something that stands still; the task can't be recovered")
    named = who.select("path", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("entity")) for r, c in grounders.SLOTS.items()])).alias("s")).select("path", "s.role", "s.entity").filter("entity is not null")
    rows = found.join(named, ["path", "entity"])
    hints = rows.filter("mask is not null").groupBy("role", nearest_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour")).count()
    best = {r.role: r.colour for r in hints.groupBy("role").agg(F.min_by("colour", F.struct((-F.col("count")).alias("k"), "colour")).alias("colour")).collect()}  # a row a role
    hint = lambda role: (f"{best[role]} object",) if role in best else ()
    spec = TaskSpec(name=name, prompt=prompt, success_sustain_frames=5, phases=transport_phases(), roles=(
        Role(BLOCK, "the mover that ends at rest at what stands still", "co_moves_with_effector", hint(BLOCK)), Role(CUP, "what stands still where the mover ends", "static", hint(CUP)),
        Role(HAND, "the other mover, which brings it and leaves", "actuated", hint(HAND), False)))
    area = rows.groupBy("path", "role").agg(F.avg("area").alias("area"))
    regions = area.select(F.col("path").alias("rollout_id"), "role", *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")], "area")
    tracks = rows.select(F.col("path").alias("rollout_id"), "role", "t", "x", "y", F.lit(1.0).alias("vis"))
    fit = tolerances(final_relations(E.episodes(tracks, spec, ("rollout_id",), regions=regions), BLOCK, CUP)).first()
    if fit.tol_rel is None:
        raise SpecError("REFUSE: no demo ends with both roles in sight")
    spec = replace(spec, success=(Predicate("co_located", BLOCK, CUP, {"tol_rel": fit.tol_rel}), Predicate("stationary", BLOCK, None, {"tol": fit.tol})))
    negatives = minted(demos.filter(F.col("path").isin(paths[:2])).select("path", "t", "h", "w", "pixels"))
    outcome = selftest(spec, demos, negatives, components.find("grounder", grounder)(**({"seed": seed} if grounder == "relational.motion" else {})), max_rounds)
    report = SelfTest(True, outcome.demos_passed, outcome.demos, outcome.negatives_failed, outcome.negatives, outcome.accepted, outcome.notes)
    if not outcome.accepted:
        raise SpecError(f"REFUSE: the specification can't tell demos from negatives: {outcome.notes}")
    digests = tuple(frames_digest(demos.filter(F.col("path") == p)) for p in paths)
    return replace(outcome.spec, spec_provenance=Origin(digests, f"gradewright {VERSION}", report))

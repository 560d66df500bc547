"""A rollout as one row, and everything that is asked of it as Column expressions over that row.

`episodes` gathers the tracks of a rollout once, so bindings, signals, gate, channels and verdict of any specification
come from a single exchange and are fused into one projection. A row is as long as its rollout; rollouts spread freely.

Points of a track are struct(x, y, vis), one a frame from frame 0 on; x is null where the role is unobserved. The
columns of an episode are: the keys, tracks map<role, points>, n (frames of the longest track), bindings
array<struct<role, bound, required, quality, reason>> in the order of the specification's roles, regions map<role,
struct<x0, y0, x1, y1, area>> and, where given, actions array<struct<ax, ay>>.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.operators.columns import let, mean, percentile, steps_to, total
from gradewright.operators.predicates import ERODE, ERODE_TOP, MISSING, PRESENT, TAU, TOL_NEAR, TOL_STATIONARY
from gradewright.sources.domain import hyp
from gradewright.spec import Predicate, TaskSpec

#: A step that counts as motion, and the scale of steps as a share of the diagonal.
MOVES, SPREAD = 0.2, 0.06
#: Scale of the confidence of a conjunction, width and stride of the phases' windows, least first distance.
CONFIDENCE, PHASE_WIDTH, PHASE_STRIDE, LEAST_DISTANCE = 3.0, 5, 2, 1e-6
#: Frames a chunk of actions, least command and displacement, least chunks.
CHUNK, LEAST_COMMAND, LEAST_SHIFT, LEAST_CHUNKS = 8, 1e-3, 1e-6, 3

REGION = "struct<x0:double,y0:double,x1:double,y1:double,area:double>"


_built: dict[tuple, Column] = {}


def compiled(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the Columns that a function makes of a specification: an expression is some thousand calls to the JVM, and the
    same one serves every plan of the session. Arguments are specifications, numbers and texts."""

    @wraps(build)
    def kept(*args, **kwargs) -> Column:
        plain = [a.content_hash() if isinstance(a, TaskSpec) else a for a in args]
        key = (build.__name__, id(SparkContext._gateway), repr(plain), repr(sorted(kwargs.items())))
        if key not in _built:
            _built[key] = build(*args, **kwargs)
        return _built[key]

    return kept


def episodes(tracks: DataFrame, spec: TaskSpec, keys: Sequence[str] = ("rollout_id", "policy"), bindings: DataFrame | None = None,
             regions: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """tracks (keys, role, t, x, y, vis) -> a row a rollout.

    bindings (keys, role, bound, quality, reason) are the grounder's; without them a role is bound if it was observed,
    with the share of observed frames as quality. regions: keys, role, x0, y0, x1, y1, area. actions: keys, t, ax, ay.
    A null or NaN coordinate is unobserved. All are grouped by the same keys.
    """
    keys = list(keys)
    seen = F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y")
    point = F.struct("t", F.when(seen, F.col("x").cast("double")).alias("x"), F.when(seen, F.col("y").cast("double")).alias("y"), F.col("vis").cast("double").alias("vis"))
    roles = tracks.groupBy(*keys, "role").agg(F.array_sort(F.collect_list(point)).alias("p"))
    roles = roles.withColumn("p", F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["vis"].alias("vis"))))
    out = roles.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("role", "p"))).alias("tracks"), F.max(F.size("p")).alias("n"))
    if bindings is not None:
        b = F.struct("role", "bound", F.col("quality").cast("double").alias("quality"), F.coalesce("reason", F.lit("")).alias("reason"))
        out = out.join(bindings.groupBy(*keys).agg(F.collect_list(b).alias("found")), keys, "left")
        given = lambda r: F.get(F.filter("found", lambda x: x["role"] == r), F.lit(0))
    each = []
    for r in spec.roles:
        points = track(r.name)
        if bindings is None:
            share = F.coalesce(F.size(F.filter(points, lambda p: p["x"].isNotNull())) / F.size(points), F.lit(0.0))
            bound, quality, reason = share > 0, share, F.lit("")
        else:
            bound, quality, reason = F.coalesce(given(r.name)["bound"], F.lit(False)), F.coalesce(given(r.name)["quality"], F.lit(0.0)), F.coalesce(given(r.name)["reason"], F.lit(""))
        each.append(F.struct(F.lit(r.name).alias("role"), bound.alias("bound"), F.lit(r.required).alias("required"), quality.alias("quality"), reason.alias("reason")))
    out = out.withColumn("bindings", F.array(*each)).drop("found")
    if regions is None:
        out = out.withColumn("regions", F.lit(None).cast(f"map<string,{REGION}>"))
    else:
        box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "area")])
        out = out.join(regions.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("role", box))).alias("regions")), keys, "left")
    if actions is not None:
        move = F.transform(F.array_sort(F.collect_list(F.struct("t", "ax", "ay"))), lambda a: F.struct(a["ax"].alias("ax"), a["ay"].alias("ay")))
        out = out.join(actions.groupBy(*keys).agg(move.alias("actions")), keys, "left")
    return out


def track(role: str) -> Column:
    return F.try_element_at(F.col("tracks"), F.lit(role))


def region(role: str | None) -> Column:
    return F.try_element_at(F.col("regions"), F.lit(role)) if role else F.lit(None).cast(REGION)


def _gap(a: Column, b: Column) -> Column:
    return hyp(a["x"] - b["x"], a["y"] - b["y"])


def _line(d: Column) -> Column:
    """Slope of the least squares line through (0, d0), (1, d1), ..."""
    n = F.size(d)
    centre = (n - 1) / 2.0
    return total(F.transform(d, lambda v, i: (i - centre) * v)) / total(F.transform(d, lambda v, i: (i - centre) * (i - centre)))


# ---------------------------------------------------------------- predicates


def evaluate(p: Predicate, start: Column, width: Column) -> Column:
    """struct(name, status, holds, margin, reason) of a predicate over the frames start .. start + width - 1 that there are."""

    def row(status: str, holds: Column, margin: Column, reason: str) -> Column:
        return F.struct(F.lit(p.describe()).alias("name"), F.lit(status).alias("status"), F.coalesce(holds, F.lit(False)).alias("holds"), margin.cast("double").alias("margin"), F.lit(reason).alias("reason"))

    def lacks(reason: str) -> Column:
        return row(MISSING, F.lit(False), F.lit(0.0), reason)

    def found(holds: Column, margin: Column) -> Column:
        return row("ok", holds, margin, "")

    part = lambda role: F.slice(track(role), start + 1, width) if role else F.lit(None).cast("array<struct<x:double,y:double,vis:double>>")
    unseen = lambda a: F.exists(a, lambda q: q["x"].isNull())

    def judged(w: Column) -> Column:
        s, o, box = w["s"], w["o"], w["box"]
        out = F.when(s.isNull(), lacks(f"no track of '{p.subject}'")).when(F.size(s) == 0, lacks("no frame in the window"))
        if p.kind == "present":
            margin = F.size(F.filter(s, lambda q: q["vis"] > 0)) / F.size(s) - PRESENT
            return out.otherwise(found(margin >= 0, margin))
        out = out.when(unseen(s), lacks(f"'{p.subject}' unobserved in the window"))
        if p.kind == "stationary":
            tol = F.lit(float(p.params.get("tol", TOL_STATIONARY)))
            margin = tol - F.coalesce(F.array_max(steps_to(F.size(s), lambda i: _gap(F.get(s, i), F.get(s, i - 1)), 1)), F.lit(0.0))
            return out.otherwise(found(margin >= 0, margin))
        if p.kind == "contained":
            e, top = float(p.params.get("erode_px", ERODE)), float(p.params.get("erode_top_px", ERODE_TOP))
            sides = F.transform(s, lambda q: F.least(q["x"] - (box["x0"] + e), box["x1"] - e - q["x"], q["y"] - (box["y0"] + top), box["y1"] - e - q["y"]))
            return out.when(box["x0"].isNull(), lacks(f"no region of '{p.object}'")).otherwise(let(F.array_min(sides), lambda m: found(m > 0, m)))
        out = out.when(o.isNull(), lacks(f"no track of '{p.object}'")).when(unseen(o) | (F.size(o) != F.size(s)), lacks(f"'{p.object}' unobserved in the window"))
        d = F.zip_with(s, o, _gap)
        if p.kind == "approaching":
            return out.when(F.size(s) < 3, lacks("window too short for an approach")).otherwise(let(_line(d), lambda m: found(m < 0, -m)))
        tol = F.lit(float(p.params.get("tol", TOL_NEAR)))
        if "tol_rel" in p.params:
            tol = F.when(box["area"] > 0, F.lit(float(p.params["tol_rel"])) * F.sqrt(box["area"])).otherwise(tol)
        margin = tol - F.array_max(d) if p.kind == "co_located" else F.array_min(d) - tol
        return out.otherwise(let(margin, lambda m: found(m > 0, m)))

    return let(F.struct(part(p.subject).alias("s"), part(p.object).alias("o"), region(p.object).alias("box")), judged)


def conjunction(predicates: Sequence[Predicate], start: Column, width: Column) -> Column:
    return F.array(*[evaluate(p, start, width) for p in predicates])


def _lacking(results: Column) -> Column:
    return F.filter(results, lambda r: r["status"] != "ok")


def first_seen(texts: Column) -> Column:
    """Distinct texts but empty ones, joined in the order in which they came first."""
    return F.array_join(F.array_distinct(F.filter(texts, lambda t: t != "")), "; ")


# ---------------------------------------------------------------- channels

DETAILS = "map<string,double>"
#: The channels whose value may decide a verdict.
ELIGIBLE = ("success.predicates", "success.demo_match")


def score(channel: str, ok: Column, value: Column, confidence: Column, reason: Column, details: Column | None = None) -> Column:
    """struct(channel, eligible, status, value, confidence, reason, details); what is not ok has no value and tells why."""
    ok = F.coalesce(ok, F.lit(False))
    none = F.lit(None).cast(DETAILS)
    return F.struct(F.lit(channel).alias("channel"), F.lit(channel in ELIGIBLE).alias("eligible"), F.when(ok, "ok").otherwise(MISSING).alias("status"), F.when(ok, value).cast("double").alias("value"),
                    F.when(ok, confidence).otherwise(0.0).alias("confidence"), F.coalesce(reason, F.lit("")).alias("reason"), (F.when(ok, details) if details is not None else none).cast(DETAILS).alias("details"))


@compiled
def success(spec: TaskSpec) -> Column:
    """success.predicates: the conjunction over the last frames of the longest track. A missing conjunct beats a failed one."""
    k = max(1, spec.success_sustain_frames)
    name = "success.predicates"
    if not spec.success:
        return score(name, F.lit(False), F.lit(None), F.lit(0.0), F.lit("the specification has no success predicates"))
    start = F.greatest(F.col("n") - k, F.lit(0))

    def judged(r: Column) -> Column:
        lacking = _lacking(r)
        low = F.array_min(F.transform(r, lambda x: x["margin"]))
        keys = {p.describe(): i for i, p in enumerate(spec.success)}  # of two predicates with one name the last counts
        entries = []
        for prefix, of in (("pred:", lambda x: x["holds"].cast("double")), ("margin:", lambda x: F.round(x["margin"] + 1e-9, 3))):
            for text, i in keys.items():
                entries += [F.lit(prefix + text), of(F.get(r, F.lit(i)))]
        why = F.when(F.size(lacking) > 0, first_seen(F.transform(lacking, lambda x: x["reason"])))
        return score(name, F.size(lacking) == 0, F.forall(r, lambda x: x["holds"]).cast("double"), 1 / (1 + F.exp(-low / CONFIDENCE)), why, F.create_map(*entries))

    return let(conjunction(spec.success, start, F.lit(k)), judged)


@compiled
def goal_distance(subject: str, target: str) -> Column:
    """progress.goal_distance: the share of the first distance to the target's mean place that is gone at the last observed frame."""
    name = "progress.goal_distance"
    s, o = track(subject), track(target)
    there = lambda a: F.filter(a, lambda p: p["x"].isNotNull())

    def judged(w: Column) -> Column:
        cx, cy = mean(F.transform(w["o"], lambda p: p["x"])), mean(F.transform(w["o"], lambda p: p["y"]))
        d = F.transform(w["s"], lambda p: hyp(p["x"] - cx, p["y"] - cy))

        def gone(d: Column) -> Column:
            first, last = F.greatest(F.get(d, F.lit(0)), F.lit(LEAST_DISTANCE)), F.get(d, F.size(d) - 1)
            ok = (F.size(d) > 0) & (F.size(w["o"]) > 0)
            value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - last / first))
            why = F.when(s.isNull() | o.isNull(), "no track of subject or target").when(~ok, "subject or target never observed")
            return score(name, ok, value, F.size(d) / F.size(s), why, F.create_map(F.lit("final_distance_px"), F.round(last, 2)))

        return let(d, gone)

    blank = F.expr("cast(array() as array<struct<x:double,y:double,vis:double>>)")
    return let(F.struct(F.coalesce(there(s), blank).alias("s"), F.coalesce(there(o), blank).alias("o")), judged)


def goal_curve(subject: str, target: str) -> Column:
    """The series behind goal_distance: a value in [0, 1] for every frame in which the subject is observed."""
    there = lambda a: F.filter(a, lambda p: p["x"].isNotNull())

    def curve(w: Column) -> Column:
        cx, cy = mean(F.transform(w["o"], lambda p: p["x"])), mean(F.transform(w["o"], lambda p: p["y"]))
        return let(F.transform(w["s"], lambda p: hyp(p["x"] - cx, p["y"] - cy)), lambda d: F.transform(
            d, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - v / F.greatest(F.get(d, F.lit(0)), F.lit(LEAST_DISTANCE))))))

    return let(F.struct(there(track(subject)).alias("s"), there(track(target)).alias("o")), curve)


@compiled
def phase_coverage(spec: TaskSpec, width: int = PHASE_WIDTH, stride: int = PHASE_STRIDE) -> Column:
    """phase.ordered_coverage: the share of phases that are met in order.

    A phase is looked for from the window in which its predecessor was met, every stride-th window on; one that is not
    met leaves that cursor where it was, so later phases can still count.
    """
    name = "phase.ordered_coverage"
    phases = spec.ordered_phases()
    if not phases:
        return score(name, F.lit(False), F.lit(None), F.lit(0.0), F.lit("the specification has no phases"))

    def tried(predicates: Sequence[Predicate], cursor: Column) -> Column:
        """struct(met: first window that holds or null, any: whether one could be evaluated) of the windows from cursor on."""
        if not predicates:
            return F.struct(F.lit(None).cast("int").alias("met"), F.lit(False).alias("any"))
        starts = F.sequence(cursor, F.greatest(cursor, F.col("n") - width - 1), F.lit(stride))
        each = F.transform(starts, lambda t: let(conjunction(predicates, t, F.lit(width)), lambda r: F.struct(
            t.alias("t"), (F.size(_lacking(r)) == 0).alias("whole"), F.forall(r, lambda x: x["holds"] & (x["status"] == "ok")).alias("holds"))))
        return let(each, lambda e: F.struct(F.array_min(F.transform(F.filter(e, lambda x: x["holds"]), lambda x: x["t"])).alias("met"), F.exists(e, lambda x: x["whole"]).alias("any")))

    def chained(i: int, cursor: Column, before: list[Column]) -> Column:
        if i < len(phases):
            return let(tried(phases[i].active, cursor), lambda f: chained(i + 1, F.coalesce(f["met"], cursor), [*before, f]))
        met = F.array(*[f["met"] for f in before])
        share = F.size(F.filter(met, lambda m: m.isNotNull())) / F.lit(float(len(phases)))
        some = before[0]["any"]
        for f in before[1:]:
            some = some | f["any"]
        entries = [c for p, f in zip(phases, before) for c in (F.lit(f"t_first:{p.name}"), F.coalesce(f["met"].cast("double"), F.lit(-1.0)))]
        unmet = F.array_join(F.filter(F.array(*[F.when(f["met"].isNull(), F.lit(p.name)) for p, f in zip(phases, before)]), lambda x: x.isNotNull()), ", ")
        why = F.when(~some, "no phase could be evaluated in any window").when(unmet != "", F.concat(F.lit("never met in order: "), unmet))
        return score(name, some, share, share, why, F.create_map(*entries))

    return chained(0, F.lit(0), [])


def chain_probability(q: Column, k: int) -> Column:
    """P(k successes in a row at some time) for independent successes with the probabilities q: a chain over the states
    0 .. k (length of the run so far; k absorbs), folded in order."""
    start = F.array(F.lit(1.0), *[F.lit(0.0)] * k)

    def step(s: Column, p: Column) -> Column:
        alive = total(F.slice(s, 1, F.lit(k)))
        onward = F.transform(F.slice(s, 1, F.lit(k)), lambda x: x * p)
        return F.concat(F.array(alive * (1 - p)), F.slice(onward, 1, F.lit(k - 1)), F.array(F.get(s, F.lit(k)) + F.get(onward, F.lit(k - 1)))) if k > 1 else F.array(alive * (1 - p), F.get(s, F.lit(1)) + F.get(onward, F.lit(0)))

    return F.get(F.aggregate(F.transform(q, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))), start, step), F.lit(k))


@compiled
def sustained(spec: TaskSpec, stride: int = 1, tau: float = 1.0) -> Column:
    """success.tl_dtmc: the chance that the conjunction was sustained at some time, from margins of two-frame windows."""
    name = "success.tl_dtmc"
    if not spec.success:
        return score(name, F.lit(False), F.lit(None), F.lit(0.0), F.lit("the specification has no success predicates"))
    k = max(1, spec.success_sustain_frames // stride)

    def chance(t: Column) -> Column:
        def product(r: Column) -> Column:
            p = F.lit(1.0)
            for i, x in enumerate(spec.success):
                p = p * (1 / (1 + F.exp(-F.get(r, F.lit(i))["margin"] / (TAU[x.kind] * tau))))
            return F.when(F.size(_lacking(r)) == 0, p)

        return let(conjunction(spec.success, t, F.lit(2)), product)

    def judged(q: Column) -> Column:
        ok = F.size(F.filter(q, lambda x: x.isNotNull()))
        share = F.coalesce(F.try_divide(ok.cast("double"), F.size(q).cast("double")), F.lit(0.0))
        value = chain_probability(F.transform(q, lambda x: F.coalesce(x, F.lit(0.0))), k)
        details = F.create_map(F.lit("k_sustain"), F.lit(float(k)), F.lit("frac_frames_evaluable"), F.round(share, 4), F.lit("max_frame_prob"), F.round(F.coalesce(F.array_max(q), F.lit(0.0)), 4), F.lit("assumes"), F.lit(1.0))
        return score(name, ok > 0, value, share, F.when(ok == 0, "the conjunction could not be evaluated in any frame"), details)

    windows = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 2, F.lit(0)), F.lit(stride)), lambda t: t < F.col("n") - 1)
    return let(F.transform(windows, chance), judged)


# ---------------------------------------------------------------- gate signals


def signal(name: str, ok: Column, value: Column, reason: Column) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.lit(name).alias("signal"), F.when(ok, "ok").otherwise(MISSING).alias("status"), F.when(ok, value).cast("double").alias("value"), F.coalesce(reason, F.lit("")).alias("reason"))


def _names(bindings: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(bindings, lambda b: b["role"])), ", ")


@compiled
def binding_health() -> Column:
    required = F.filter("bindings", lambda b: b["required"])

    def judged(r: Column) -> Column:
        unbound = F.filter(r, lambda b: ~b["bound"])
        why = F.when(F.size(r) == 0, "no role is required").when(F.size(unbound) > 0, F.concat(F.lit("required roles unbound: "), _names(unbound)))
        return signal("binding_health", (F.size(r) > 0) & (F.size(unbound) == 0), F.array_min(F.transform(r, lambda b: b["quality"])), why)

    return let(required, judged)


def _bound(of) -> Column:
    """of(track, role) of the bound roles in order, nulls left out."""
    each = F.transform(F.filter("bindings", lambda b: b["bound"]), lambda b: of(F.try_element_at(F.col("tracks"), b["role"]), b["role"]))
    return F.filter(each, lambda x: x.isNotNull())


@compiled
def permanence() -> Column:
    """The least running mean of a bound role's visibility over its early level: of the worst role, 1 without decline."""

    def ratio(points: Column, role: Column) -> Column:
        def of(v: Column) -> Column:
            n = F.size(v)
            k = F.greatest(F.lit(2), F.floor(n / 10).cast("int"))
            sums = F.aggregate(v, F.array(F.lit(0.0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

            def least(s: Column) -> Column:
                runs = steps_to(n - k + 1, lambda i: (F.get(s, i + k) - F.get(s, i)) / k)
                early = F.get(s, k) / k
                r = F.when(early <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.array_min(runs) / early)))
                return F.struct(r.alias("ratio"), role.alias("role"))

            return F.when(n >= 4, let(sums, least))

        return let(F.transform(points, lambda p: p["vis"]), of)

    def judged(r: Column) -> Column:
        low = F.array_min(F.transform(r, lambda x: x["ratio"]))
        worst = F.get(F.filter(r, lambda x: x["ratio"] == low), F.lit(0))
        why = F.when(F.size(r) == 0, "no bound role has a visibility series").when(low < 0.5, F.concat(F.lit("visibility of '"), worst["role"], F.lit("' fell to "), F.round(low + 1e-9, 2).cast("string"), F.lit(" of its early level")))
        return signal("permanence", F.size(r) > 0, F.least(F.lit(1.0), low), why)

    return let(_bound(ratio), judged)


@compiled
def motion_sanity() -> Column:
    """Twice the share of frames in which any role moves, 1 at most."""
    paths = F.map_values("tracks")
    moves = lambda a, i: F.coalesce(_gap(F.get(a, i), F.get(a, i - 1)) > MOVES, F.lit(False))
    frames = steps_to(F.col("n"), lambda i: F.exists(paths, lambda a: moves(a, i)).cast("double"), 1)
    return signal("motion_sanity", F.size("tracks") > 0, F.least(F.lit(1.0), 2 * F.coalesce(mean(frames), F.lit(0.0))), F.when(F.size("tracks") == 0, "no tracks"))


def track_continuity(diagonal: float | Column) -> Column:
    """exp(-p99 of the steps over observed points / scale) of the worst bound role; gaps collapse."""

    def value(points: Column, role: Column) -> Column:
        seen = F.filter(points, lambda p: p["x"].isNotNull())
        return let(seen, lambda o: F.when(F.size(o) >= 4, F.struct(F.exp(-percentile(steps_to(F.size(o), lambda i: _gap(F.get(o, i), F.get(o, i - 1)), 1), 0.99) / (SPREAD * F.lit(diagonal))).alias("value"), role.alias("role"))))

    def judged(r: Column) -> Column:
        low = F.array_min(F.transform(r, lambda x: x["value"]))
        worst = F.get(F.filter(r, lambda x: x["value"] == low), F.lit(0))
        why = F.when(F.size(r) == 0, "no observed track").when(low <= 0.5, F.concat(F.lit("the track of '"), worst["role"], F.lit("' jumps")))
        return signal("track_continuity", F.size(r) > 0, low, why)

    return let(_bound(value), judged)


def action_consistency(effectors: Sequence[str] = ("gripper",), chunk: int = CHUNK) -> Column:
    """Median cosine of commanded and observed motion over chunks, as (c + 1) / 2.

    Fixed rules: the last full chunk is left out, and a chunk's displacement spans chunk - 1 steps.
    """
    name = "action_video_consistency"
    usable = F.array(*[F.struct(F.size(F.filter(track(r), lambda p: p["x"].isNotNull())).alias("seen"), track(r).alias("p")) for r in effectors])
    chosen = F.get(F.filter(usable, lambda u: u["seen"] > 4), F.lit(0))["p"]

    def judged(p: Column) -> Column:
        n = F.least(F.size("actions"), F.size(p))

        def cosine(c: Column) -> Column:
            a = F.slice("actions", c + 1, F.lit(chunk))
            move = F.struct(total(F.transform(a, lambda m: m["ax"])).alias("cx"), total(F.transform(a, lambda m: m["ay"])).alias("cy"),
                            (F.get(p, c + chunk - 1)["x"] - F.get(p, c)["x"]).alias("dx"), (F.get(p, c + chunk - 1)["y"] - F.get(p, c)["y"]).alias("dy"))
            size = lambda m, x, y: hyp(m[x], m[y])
            return let(move, lambda m: F.when((size(m, "cx", "cy") >= LEAST_COMMAND) & (size(m, "dx", "dy") >= LEAST_SHIFT), (m["cx"] * m["dx"] + m["cy"] * m["dy"]) / (size(m, "cx", "cy") * size(m, "dx", "dy"))))

        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - chunk, F.lit(0)), F.lit(chunk)), lambda c: c < n - chunk)

        def value(c: Column) -> Column:
            v = (percentile(c, 0.5) + 1) / 2
            why = F.when(F.col("actions").isNull(), "no actions").when(p.isNull(), f"no usable track of {', '.join(effectors)}").when(F.size(c) < LEAST_CHUNKS, "too few chunks with commanded and observed motion").when(v <= 0.5, "the video moves against the commands")
            return signal(name, F.col("actions").isNotNull() & p.isNotNull() & (F.size(c) >= LEAST_CHUNKS), v, why)

        none = F.expr("cast(array() as array<double>)")
        return let(F.coalesce(F.filter(F.transform(starts, cosine), lambda c: c.isNotNull()), none), value)

    return let(chosen, judged)


# ---------------------------------------------------------------- gate, verdict, card

#: Fixed values: (signal, ungradeable below, degraded below, required) of the default policy.
POLICY = (("permanence", 0.5, 0.8, True), ("binding_health", 0.2, 0.5, True), ("motion_sanity", None, 0.2, False))
LEVELS = ("gradeable", "degraded", "ungradeable")


def _shown(x: Column) -> Column:
    return F.round(x + 1e-9, 3).cast("string")


def gate(signals: Column, policy: Sequence[tuple] = POLICY, need_bindings: bool = True) -> Column:
    """struct(verdict, reasons): the greatest severity, and why in the order of roles, then signals."""
    low = {name: (a, b) for name, a, b, _ in policy}
    needed = [name for name, _, _, r in policy if r]

    def finding(s: Column) -> Column:
        floor = F.lit(None).cast("double")
        mid = F.lit(None).cast("double")
        for name, (a, b) in low.items():
            floor = F.when(s["signal"] == name, F.lit(a).cast("double")).otherwise(floor)
            mid = F.when(s["signal"] == name, F.lit(b).cast("double")).otherwise(mid)
        needs = s["signal"].isin(needed) if needed else F.lit(False)

        def put(level: Column, text: Column) -> Column:
            return F.struct(level.cast("int").alias("level"), text.alias("text"))

        below = lambda limit: F.concat(s["signal"], F.lit(" "), _shown(s["value"]), F.lit(" below "), limit.cast("string"))
        told = F.when(s["reason"] != "", F.concat(F.lit(" ("), s["reason"], F.lit(")"))).otherwise(F.lit(""))
        return (F.when(s["status"] != "ok", put(F.when(needs, 2).otherwise(1), F.concat(F.lit("no evidence for "), s["signal"], F.lit(": "), s["reason"])))
                .when(s["value"] < floor, put(F.lit(2), F.concat(below(floor), told)))
                .when(s["value"] < mid, put(F.lit(1), below(mid))))

    found = F.filter(F.transform(signals, finding), lambda f: f.isNotNull())
    if need_bindings:
        def roles(required: bool, level: int, text: str) -> Column:
            lacking = F.filter("bindings", lambda b: ~b["bound"] & (b["required"] == required))
            row = F.array(F.struct(F.lit(level).alias("level"), F.concat(F.lit(text), _names(lacking)).alias("text")))
            return F.when(F.size(lacking) > 0, row).otherwise(F.expr("cast(array() as array<struct<level:int,text:string>>)"))

        found = F.concat(roles(True, 2, "required roles unbound: "), roles(False, 0, "optional roles unbound, without effect: "), found)
    level = lambda f: F.coalesce(F.array_max(F.transform(f, lambda x: x["level"])), F.lit(0))
    return let(found, lambda f: F.struct(F.get(F.array(*map(F.lit, LEVELS)), level(f)).alias("verdict"), F.transform(f, lambda x: x["text"]).alias("reasons")))


def _usable(c: Column) -> Column:
    v = c["value"]
    return (c["status"] == "ok") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def fold(channels: Column, threshold: float = 0.5) -> Column:
    """struct(verdict, satisfied, violated, reasons) of the eligible channels: those without evidence are dropped, none
    left or a conflict is an abstention."""

    def judged(e: Column) -> Column:
        voters, dropped = F.filter(e, _usable), F.filter(e, lambda c: ~_usable(c))
        details = F.flatten(F.transform(voters, lambda c: F.map_entries(F.coalesce(c["details"], F.expr(f"cast(map() as {DETAILS})")))))
        named = lambda keep: F.transform(F.filter(details, lambda d: d["key"].startswith("pred:") & keep(d["value"])), lambda d: F.substring(d["key"], F.lit(6), F.length(d["key"])))
        yes, no = F.filter(voters, lambda c: c["value"] >= threshold), F.filter(voters, lambda c: c["value"] < threshold)
        list_of = lambda a: F.array_join(F.transform(a, lambda c: c["channel"]), ", ")
        why = F.transform(dropped, lambda c: F.concat(c["channel"], F.lit(": "), c["status"], F.lit(" ("), F.when(c["reason"] == "", "no usable value").otherwise(c["reason"]), F.lit(")")))
        texts = F.expr("cast(array() as array<string>)")
        none = F.when(F.size(e) == 0, F.array(F.lit("no channel may decide"))).otherwise(why)
        dropped_text = F.when(F.size(why) > 0, F.array(F.concat(F.lit("dropped without evidence: "), F.array_join(why, "; ")))).otherwise(texts)
        conflict = F.when((F.size(yes) > 0) & (F.size(no) > 0), F.array(F.concat(F.lit("channels conflict: pass "), list_of(yes), F.lit("; fail "), list_of(no)))).otherwise(texts)
        verdict = F.when((F.size(yes) > 0) & (F.size(no) == 0), "pass").when((F.size(no) > 0) & (F.size(yes) == 0), "fail").otherwise("abstain")
        return F.struct(verdict.alias("verdict"), named(lambda v: v >= 0.5).alias("satisfied"), named(lambda v: v < 0.5).alias("violated"),
                        F.when(F.size(voters) == 0, none).otherwise(F.concat(dropped_text, conflict)).alias("reasons"))

    return let(F.filter(channels, lambda c: c["eligible"]), judged)


@compiled
def _gate_of_signals(policy: Sequence[tuple]) -> Column:
    return gate(F.col("signals"), policy)


@compiled
def _fold_of_channels(threshold: float) -> Column:
    return fold(F.col("channels"), threshold)


def first_channel(channels: Column, name: str) -> Column:
    """The first channel of that name on a card, or null."""
    return F.get(F.filter(channels, lambda c: c["channel"] == name), F.lit(0))


def cards(episodes: DataFrame, spec: TaskSpec, signals: Sequence[Column], channels: Sequence[Column], keys: Sequence[str] = ("rollout_id", "policy"),
          policy: Sequence[tuple] = POLICY, threshold: float = 0.5) -> DataFrame:
    """Grade cards: keys, spec_name, spec_version, spec_hash, signals, gate, channels, success. The channels of an
    ungradeable rollout are skipped, and it is an abstention for the gate's reasons."""
    d = episodes.withColumn("signals", F.array(*signals))
    d = d.withColumn("gate", _gate_of_signals(policy)).withColumn("channels", F.array(*channels))
    stop = F.col("gate.verdict") == "ungradeable"
    skipped = F.transform("channels", lambda c: F.struct(c["channel"].alias("channel"), c["eligible"].alias("eligible"), F.lit("skipped").alias("status"), F.lit(None).cast("double").alias("value"),
                                                         F.lit(0.0).alias("confidence"), F.lit("the gate holds the rollout ungradeable").alias("reason"), F.lit(None).cast(DETAILS).alias("details")))
    texts = F.expr("cast(array() as array<string>)")
    held = F.struct(F.lit("abstain").alias("verdict"), texts.alias("satisfied"), texts.alias("violated"), F.transform("gate.reasons", lambda r: F.concat(F.lit("gate: "), r)).alias("reasons"))
    d = d.withColumn("channels", F.when(stop, skipped).otherwise(F.col("channels")))
    d = d.withColumn("success", F.when(stop, held).otherwise(_fold_of_channels(threshold)))
    return d.select(*keys, F.lit(spec.name).alias("spec_name"), F.lit(spec.version).alias("spec_version"), F.lit(spec.content_hash()).alias("spec_hash"), "signals", "gate", "channels", "success")

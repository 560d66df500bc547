"""Sequence, grounding and compiler operators over tracks as queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradewright import compiler
from gradewright.operators import dtw
from gradewright.operators import episode as E
from gradewright.sources import domain as D


def _role():
    return Window.partitionBy("rollout_id", "role")


def _by_t():
    return _role().orderBy("t")



def steps(t):
    return t.withColumn("step", D.hyp(F.col("x") - F.lag("x").over(_by_t()), F.col("y") - F.lag("y").over(_by_t())))


def running_mean(t, k=3):
    m = F.avg("vis").over(_by_t().rowsBetween(-(k - 1), 0))
    return t.select("rollout_id", "role", "t", m.alias("m"), F.row_number().over(_by_t()).alias("r")).filter(F.col("r") >= k).drop("r")


def interpolated(t):
    """Linear between observed samples, null outside the observed span."""
    before, after = _by_t().rowsBetween(Window.unboundedPreceding, 0), _by_t().rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("x").isNotNull(), F.struct("t", "x"))
    d = t.withColumn("p", F.last(seen, ignorenulls=True).over(before)).withColumn("n", F.first(seen, ignorenulls=True).over(after))
    x = F.when(F.col("p.t") == F.col("n.t"), F.col("p.x")).otherwise(F.col("p.x") + (F.col("n.x") - F.col("p.x")) * (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t")))
    return d.select("rollout_id", "role", "t", x.alias("x"))


def held(t, stride=3):
    """Each sample (every stride-th frame) holds until the next one."""
    s = t.filter(F.col("t") % stride == 0).select("rollout_id", "role", "t", "vis")
    n = t.groupBy("rollout_id", "role").agg(F.count("*").alias("n"))
    s = s.withColumn("next", F.lead("t").over(_by_t())).join(n, ["rollout_id", "role"])
    return s.select("rollout_id", "role", "vis", F.explode(F.sequence("t", F.coalesce("next", F.col("n").cast("int")) - 1)).alias("t"))


def motion_check(t, diagonal=1000.0):
    g = t.groupBy("rollout_id", "role").agg(F.count("x").alias("n"), D.hyp(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("range"))
    kind = F.when(F.col("role") == "view", "static").when(F.col("role").isin("click", "purchase"), "moving").otherwise("free")
    ok = F.when(F.col("n") < 2, True).when(kind == "moving", F.col("range") >= 0.03 * diagonal).when(kind == "static", F.col("range") <= 0.25 * diagonal).otherwise(True)
    return g.select("rollout_id", "role", "range", ok.alias("consistent"))


def settle(t):
    n = F.count("*").over(_role())
    late = F.col("t") >= F.floor(F.col("n") * 0.8)
    g = t.withColumn("n", n).groupBy("rollout_id", "role").agg(*[F.coalesce(F.avg(F.when(late, F.col(c))), F.avg(c)).alias(c) for c in ("x", "y")])
    return g


def nearest_static(t):
    """Each mover's nearest other entity by final position; the first by name on a tie."""
    s = settle(t).filter("x is not null")
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("a.rollout_id") == F.col("b.rollout_id")) & (F.col("a.role") != F.col("b.role")))
    d = D.hyp(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return j.groupBy(F.col("a.rollout_id").alias("rollout_id"), F.col("a.role").alias("role")).agg(
        F.min_by(F.col("b.role"), F.struct(F.round(d, 9).alias("d"), F.col("b.role").alias("r"))).alias("nearest"), F.min(d).alias("dist"))


def velocity_correlation(spark, sf):
    f = D.frames(D.tracks(spark, sf))
    w = Window.partitionBy("rollout_id").orderBy("t")
    v = f.select("rollout_id", *[F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)).alias(c) for c in ("sx", "sy", "gx", "gy")])
    g = v.groupBy("rollout_id").agg(F.sum(F.col("sx") * F.col("gx") + F.col("sy") * F.col("gy")).alias("d"), F.sum(F.col("sx") ** 2 + F.col("sy") ** 2).alias("a"), F.sum(F.col("gx") ** 2 + F.col("gy") ** 2).alias("b"))
    return g.select("rollout_id", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("d") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0).alias("corr"))


def normalised(t):
    """Unobserved points dropped, first point subtracted, divided by the greatest coordinate; nothing for under two points."""
    o = t.filter("x is not null")
    o = o.withColumn("x0", F.first("x").over(_by_t())).withColumn("y0", F.first("y").over(_by_t())).withColumn("n", F.count("*").over(_role()))
    o = o.withColumn("x", F.col("x") - F.col("x0")).withColumn("y", F.col("y") - F.col("y0"))
    top = F.greatest(F.lit(1e-6), F.max(F.greatest(F.abs("x"), F.abs("y"))).over(_role()))
    return o.filter("n >= 2").select("rollout_id", "role", "t", (F.col("x") / top).alias("x"), (F.col("y") / top).alias("y"))


def negatives(spark, sf):
    """Negatives of each subject's track: rollout_id (with the kind in it), t, x."""
    t = D.tracks(spark, sf).filter(F.col("role") == D.SUBJECT).select("rollout_id", "t", "x")
    return compiler.minted(t, "rollout_id")


def _with_regions(spark, sf, spec):
    t = D.tracks(spark, sf)
    boxes = D.regions(t).withColumn("role", F.lit(D.OBJECT))
    return E.episodes(t, spec, ("rollout_id",), regions=boxes)


def fit_tolerances(spark, sf):
    from .evaluation import SPEC

    return compiler.tolerances(compiler.final_relations(_with_regions(spark, sf, SPEC), D.SUBJECT, D.OBJECT))


#: The fitted tolerance that the self-test starts from, ours.
BASE = 3.0


def selftest(spark, sf):
    """Rollouts with a gold are the demos (successes) and negatives; every multiple of the tolerance is judged in one pass."""
    from .evaluation import SPEC

    near, still = SPEC.success
    spec = replace(SPEC, success=(replace(near, params={"tol_rel": BASE}), still))
    e = _with_regions(spark, sf, spec).join(D.golds(spark, sf), "rollout_id")
    tried = F.array(*[E.success(spec.with_tolerance(m))["value"] >= 0.5 for m in compiler.GRID])
    return compiler.grid_counts(e.select(F.col("success").alias("is_demo"), tried.alias("passed")))


#: Demos that every rollout is held against, ours: the first successes by id.
DEMOS = 3


def dtw_demo(spark, sf):
    from .evaluation import SPEC

    e = E.episodes(D.tracks(spark, sf), SPEC, ("rollout_id",)).select("rollout_id", F.transform(E.track(D.SUBJECT), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    bank = e.join(D.golds(spark, sf).filter("success"), "rollout_id", "left_semi").orderBy("rollout_id").limit(DEMOS).collect()  # as many tracks as demos
    return dtw.demo_scores(e, [[(p.x, p.y) for p in r.points] for r in bank]).select("rollout_id", "score.status", "score.value", "score.confidence")


def _t(fn, *a, **k):
    return lambda spark, sf: fn(D.tracks(spark, sf), *a, **k)


def early_late(t):
    """Bind rate, and mean visibility of the windows [0, 5 %), [30, 50 %) and [80, 100 %], a policy and role, with the early to
    late drop. Sums are exact decimals, so no order of summation shows in the means."""
    d = t.withColumn("u", F.col("t") / F.count("*").over(_role()))
    exact = F.col("vis").cast("decimal(20,12)")
    mean = lambda when: F.try_divide(F.sum(F.when(when, exact)).cast("double"), F.count_if(when).cast("double"))
    u = F.col("u")
    r = d.groupBy("policy", "rollout_id", "role").agg((F.count("x") / F.count("*")).alias("rate"), mean(u < 0.05).alias("e"), mean((u >= 0.3) & (u < 0.5)).alias("m"), mean(u >= 0.8).alias("l"))
    return r.groupBy("policy", "role").agg(F.avg("rate").alias("rate"), F.avg("e").alias("early"), F.avg("m").alias("mid"), F.avg("l").alias("late"), F.avg(F.col("e") - F.col("l")).alias("drop_"))


QUERIES = {
    "w1_steps": lambda s, d: steps(D.tracks(s, d)).select("rollout_id", "role", "t", "step"),
    "w1b_observed_steps": lambda s, d: steps(D.tracks(s, d).filter("x is not null")).select("rollout_id", "role", "t", "step"),
    "w3_running_mean": _t(running_mean),
    "w6_first_last_observed": lambda s, d: D.tracks(s, d).groupBy("rollout_id", "role").agg(*[f(F.when(F.col("x").isNotNull(), F.col("t"))).alias(n) for f, n in ((F.min, "first_t"), (F.max, "last_t"))]),
    "w8_sample_indices": lambda s, d: D.tracks(s, d).groupBy("rollout_id").agg((F.max("t") + 1).alias("n")).select("rollout_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (F.col("n") - 1) / 4.0).cast("int")))).alias("i")),
    "w9_interpolation": _t(interpolated),
    "j13_hold_samples": lambda s, d: held(D.tracks(s, d)).select("rollout_id", "role", "t", "vis"),
    "p16_motion_signature": _t(motion_check),
    "w13_settle": _t(settle),
    "j8_nearest_entity": _t(nearest_static),
    "w15_velocity_correlation": velocity_correlation,
    "f20_normalised_track": _t(normalised),
    "f21_c6_dtw": dtw_demo,
    "f18_r9_negatives": negatives,
    "r7_fit_tolerances": fit_tolerances,
    "r10_selftest_grid": selftest,
    "a6_worst_role": lambda s, d: D.bindings(D.tracks(s, d)).groupBy("rollout_id").agg(F.min("quality").alias("q"), F.min_by("role", F.struct("quality", "role")).alias("role")),
    "a10_bind_rate": lambda s, d: D.bindings(D.tracks(s, d)).select("rollout_id", "role", "bound", "quality", "required"),
    "a12_policy_role_windows": _t(early_late),
    "s9_role_data": lambda s, d: (lambda t: D.bindings(t).join(D.regions(t), "rollout_id", "left").select("rollout_id", "role", "bound", F.when(F.col("role") == "view", F.col("area")).alias("area")))(D.tracks(s, d)),
    "p17_box_iou": lambda s, d: D.frames(D.tracks(s, d)).select("rollout_id", "t", (lambda i: i / (200 - i))(F.greatest(F.lit(0.0), 10 - F.abs(F.col("sx") - F.col("ox"))) * F.greatest(F.lit(0.0), 10 - F.abs(F.col("sy") - F.col("oy")))).alias("iou")),
}

_W = "WINDOW w AS (PARTITION BY rollout_id, role ORDER BY t)"
_STEP = "sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2))"
_SET = "st AS (SELECT rollout_id, role, coalesce(avg(x) FILTER (t >= floor(n * 0.8::DOUBLE)), avg(x)) AS x, coalesce(avg(y) FILTER (t >= floor(n * 0.8::DOUBLE)), avg(y)) AS y FROM (SELECT *, count(*) OVER (PARTITION BY rollout_id, role) AS n FROM tracks) GROUP BY ALL)"
_NORM = """o AS (SELECT rollout_id, role, t, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y, count(*) OVER (PARTITION BY rollout_id, role) AS n FROM tracks WHERE x IS NOT NULL WINDOW w AS (PARTITION BY rollout_id, role ORDER BY t)),
nm AS (SELECT rollout_id, role, t, x / m AS x, y / m AS y FROM (SELECT *, greatest(1e-6, max(greatest(abs(x), abs(y))) OVER (PARTITION BY rollout_id, role)) AS m FROM o WHERE n >= 2))"""

ORACLES = {
    "w1_steps": ("step", f"SELECT rollout_id, role, t::INT AS t, {_STEP} AS step FROM tracks {_W}"),
    "w1b_observed_steps": ("step", f"SELECT rollout_id, role, t::INT AS t, {_STEP} AS step FROM tracks WHERE x IS NOT NULL {_W}"),
    "w3_running_mean": ("m", f"SELECT rollout_id, role, t::INT AS t, avg(vis) OVER (w ROWS 2 PRECEDING) AS m FROM tracks {_W} QUALIFY row_number() OVER w >= 3"),
    "w6_first_last_observed": ("", "SELECT rollout_id, role, (min(t) FILTER (x IS NOT NULL))::INT AS first_t, (max(t) FILTER (x IS NOT NULL))::INT AS last_t FROM tracks GROUP BY ALL"),
    "w8_sample_indices": ("", "SELECT DISTINCT rollout_id, floor(i * n / 4.0::DOUBLE)::INT AS i FROM (SELECT rollout_id, max(t) AS n FROM tracks GROUP BY 1), range(0, 5) u(i)"),
    "w9_interpolation": ("x", """WITH b AS (SELECT rollout_id, role, t, max(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY rollout_id, role ORDER BY t ROWS UNBOUNDED PRECEDING) AS p, min(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY rollout_id, role ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM tracks)
SELECT b.rollout_id, b.role, b.t::INT AS t, CASE WHEN p = n THEN q.x ELSE q.x + (r.x - q.x) * (b.t - p) / nullif(n - p, 0) END AS x FROM b LEFT JOIN tracks q ON q.rollout_id = b.rollout_id AND q.role = b.role AND q.t = p LEFT JOIN tracks r ON r.rollout_id = b.rollout_id AND r.role = b.role AND r.t = n"""),
    "j13_hold_samples": ("vis", "SELECT a.rollout_id, a.role, a.t::INT AS t, b.vis FROM tracks a JOIN tracks b ON a.rollout_id = b.rollout_id AND a.role = b.role AND b.t = a.t - a.t % 3"),
    "p16_motion_signature": ("range", "SELECT rollout_id, role, range, CASE WHEN n < 2 THEN true WHEN role IN ('click', 'purchase') THEN range >= 30 WHEN role = 'view' THEN range <= 250 ELSE true END AS consistent FROM (SELECT rollout_id, role, count(x) AS n, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS range FROM tracks GROUP BY ALL)"),
    "w13_settle": ("x y", f"WITH {_SET} SELECT * FROM st"),
    "j8_nearest_entity": ("dist", f"WITH {_SET}, d AS (SELECT a.rollout_id, a.role, b.role AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM st a JOIN st b ON a.rollout_id = b.rollout_id AND a.role <> b.role WHERE a.x IS NOT NULL AND b.x IS NOT NULL) SELECT rollout_id, role, arg_min(other, (round(d, 9), other)) AS nearest, min(d) AS dist FROM d GROUP BY ALL"),
    "w15_velocity_correlation": ("corr", """WITH v AS (SELECT rollout_id, coalesce(sx - lag(sx) OVER w, 0) AS a, coalesce(sy - lag(sy) OVER w, 0) AS b, coalesce(gx - lag(gx) OVER w, 0) AS c, coalesce(gy - lag(gy) OVER w, 0) AS d FROM frames WINDOW w AS (PARTITION BY rollout_id ORDER BY t))
SELECT rollout_id, CASE WHEN sum(a*a + b*b) > 0 AND sum(c*c + d*d) > 0 THEN sum(a*c + b*d) / sqrt(sum(a*a + b*b) * sum(c*c + d*d)) ELSE 0 END AS corr FROM v GROUP BY 1"""),
    "f20_normalised_track": ("x y", f"WITH {_NORM} SELECT rollout_id, role, t::INT AS t, x, y FROM nm"),
    "f21_c6_dtw": ("value confidence", f"""WITH RECURSIVE {_NORM}, bk AS (SELECT rollout_id AS demo FROM golds WHERE success AND rollout_id IN (SELECT rollout_id FROM tracks) ORDER BY 1 LIMIT {DEMOS}),
ls AS (SELECT rollout_id, list({{'x': x, 'y': y}} ORDER BY t) AS a FROM nm WHERE role = 'click' GROUP BY 1), ab AS (SELECT p.rollout_id * 1000000 + demo AS pair, p.a, q.a AS b FROM ls p, bk JOIN ls q ON q.rollout_id = demo),
g AS (SELECT pair, len(a) AS n, len(b) AS m, i, j, sqrt(pow(a[i].x - b[j].x, 2) + pow(a[i].y - b[j].y, 2)) AS c FROM ab, range(1, 200) u(i), range(1, 200) v(j) WHERE i <= len(a) AND j <= len(b)),
k AS (SELECT pair, n, m, 2 AS s, [struct_pack(i := 1, v := c)] AS prev, CAST([] AS STRUCT(i BIGINT, v DOUBLE)[]) AS prev2 FROM (SELECT pair, n, m, c FROM g WHERE i = 1 AND j = 1)
 UNION ALL SELECT k.pair, any_value(k.n), any_value(k.m), k.s + 1, list(struct_pack(i := g.i, v := g.c + least(
   coalesce(list_filter(k.prev, lambda z: z.i = g.i - 1)[1].v, 'inf'::DOUBLE), coalesce(list_filter(k.prev, lambda z: z.i = g.i)[1].v, 'inf'::DOUBLE), coalesce(list_filter(k.prev2, lambda z: z.i = g.i - 1)[1].v, 'inf'::DOUBLE)))), any_value(k.prev)
  FROM k JOIN g ON g.pair = k.pair AND g.i + g.j = k.s + 1 WHERE k.s < k.n + k.m GROUP BY k.pair, k.s),
ds AS (SELECT pair // 1000000 AS rollout_id, min(prev[1].v / s) AS d FROM k WHERE s = n + m GROUP BY 1), sh AS (SELECT rollout_id, count(x)::DOUBLE / count(*) AS share FROM tracks WHERE role = 'click' GROUP BY 1)
SELECT rollout_id, CASE WHEN d IS NULL THEN 'evidence_missing' ELSE 'ok' END AS status, exp(-d / 0.25) AS value, CASE WHEN d IS NULL THEN 0 ELSE share END AS confidence FROM sh LEFT JOIN ds USING (rollout_id)"""),
    "f18_r9_negatives": ("x", """WITH d AS (SELECT rollout_id, t, x, count(*) OVER (PARTITION BY rollout_id) AS n FROM tracks WHERE role = 'click'),
m AS (SELECT 'reversed' AS kind, rollout_id, t, n - 1 - t AS src, n FROM d UNION ALL SELECT 'frozen', rollout_id, t, least(t, greatest(2, floor(n * 0.35::DOUBLE)::BIGINT)), n FROM d UNION ALL SELECT 'truncated', rollout_id, t, least(t, greatest(2, floor(n * 0.45::DOUBLE)::BIGINT)), n FROM d
 UNION ALL SELECT 'stalled', rollout_id, t, t % greatest(2, floor(n * 0.15::DOUBLE)::BIGINT), n FROM d)
SELECT m.kind, m.rollout_id || '#neg_' || m.kind AS rollout_id, m.t::INT AS t, d.x FROM m JOIN d ON d.rollout_id = m.rollout_id AND d.t = least(m.src, m.n - 1)"""),
    "r7_fit_tolerances": ("tol_rel tol", """WITH n AS (SELECT rollout_id, max(t) + 1 AS n FROM tracks GROUP BY 1),
s AS (SELECT rollout_id, t, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tracks JOIN n USING (rollout_id) WHERE role = 'click' AND x IS NOT NULL AND t >= floor(n * 0.85::DOUBLE) WINDOW w AS (PARTITION BY rollout_id ORDER BY t)),
e AS (SELECT rollout_id, avg(x) AS cx, avg(y) AS cy, max(sqrt(pow(x - px, 2) + pow(y - py, 2))) AS speed FROM s GROUP BY 1), o AS (SELECT rollout_id, avg(x) AS ox, avg(y) AS oy FROM tracks WHERE role = 'view' AND x IS NOT NULL GROUP BY 1),
f AS (SELECT sqrt(pow(cx - ox, 2) + pow(cy - oy, 2)) / sqrt(greatest(coalesce(area, 1), 1)) AS rel, speed FROM e JOIN o USING (rollout_id) LEFT JOIN regions USING (rollout_id))
SELECT 1.5 * quantile_cont(rel, 0.95::DOUBLE) AS tol_rel, coalesce(greatest(1.0::DOUBLE, 2 * quantile_cont(speed, 0.95::DOUBLE)), 1.5) AS tol FROM f"""),
    "r10_selftest_grid": ("factor", f"""WITH q AS (SELECT rollout_id, count(*) = count(sx) AND count(*) = count(ox) AS whole, max(sqrt(pow(sx - ox, 2) + pow(sy - oy, 2))) AS md, max(st) AS ms FROM (SELECT *, sqrt(pow(sx - lag(sx) OVER w, 2) + pow(sy - lag(sy) OVER w, 2)) AS st FROM fin WINDOW w AS (PARTITION BY rollout_id ORDER BY t)) GROUP BY 1),
g(place, factor) AS (VALUES {', '.join(f'({i}, {m}::DOUBLE)' for i, m in enumerate(compiler.GRID))}),
e AS (SELECT place, factor, success, coalesce(whole AND md < {BASE} * factor * sqrt(nullif(area, 0)) AND coalesce(ms, 0) <= 110, false) AS ok FROM q JOIN golds USING (rollout_id) LEFT JOIN regions USING (rollout_id), g),
c AS (SELECT place, factor, count(*) FILTER (success AND ok) AS demos_passed, count(*) FILTER (NOT success AND NOT ok) AS negatives_failed, count(*) FILTER (success) AS demos, count(*) FILTER (NOT success) AS negatives FROM e GROUP BY ALL),
b AS (SELECT coalesce(min(place) FILTER (demos_passed = demos AND negatives_failed = negatives), arg_max(place, (demos_passed, negatives_failed, -place))) AS best, bool_or(demos_passed = demos AND negatives_failed = negatives) AS accepted FROM c)
SELECT place::BIGINT AS place, factor, demos_passed, negatives_failed, demos, negatives, place = best AS best, accepted FROM c, b"""),
    "a6_worst_role": ("q", "SELECT rollout_id, min(quality) AS q, arg_min(role, (quality, role)) AS role FROM bindings GROUP BY 1"),
    "a10_bind_rate": ("quality", "SELECT rollout_id, role, bound, quality, required FROM bindings"),
    "a12_policy_role_windows": ("rate early mid late drop_", """WITH r AS (SELECT policy, rollout_id, role, count(x)::DOUBLE / count(*) AS rate, sum(d) FILTER (u < 0.05)::DOUBLE / nullif(count(*) FILTER (u < 0.05), 0) AS e, sum(d) FILTER (u >= 0.3 AND u < 0.5)::DOUBLE / nullif(count(*) FILTER (u >= 0.3 AND u < 0.5), 0) AS m,
  sum(d) FILTER (u >= 0.8)::DOUBLE / nullif(count(*) FILTER (u >= 0.8), 0) AS l FROM (SELECT *, vis::DECIMAL(20, 12) AS d, t::DOUBLE / count(*) OVER (PARTITION BY rollout_id, role) AS u FROM tracks) GROUP BY ALL)
SELECT policy, role, avg(rate) AS rate, avg(e) AS early, avg(m) AS mid, avg(l) AS late, avg(e - l) AS drop_ FROM r GROUP BY ALL"""),
    "s9_role_data": ("", "SELECT b.rollout_id, b.role, b.bound, CASE WHEN b.role = 'view' THEN area END AS area FROM bindings b LEFT JOIN regions USING (rollout_id)"),
    "p17_box_iou": ("iou", "SELECT rollout_id, t::INT AS t, i / (200 - i) AS iou FROM (SELECT rollout_id, t, greatest(CASE WHEN sx IS NULL OR ox IS NULL THEN 0 END, 10 - abs(sx - ox), 0) * greatest(10 - abs(sy - oy), 0) AS i FROM frames)"),
}

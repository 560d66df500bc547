"""Pixel rows, time windows, linking and report series as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.operators import induction, linking, pixels
from gradewright.sources import domain as D
from gradewright.streaming import windows

from .evaluation import DIAGONAL

#: The views' frames, ours: a column of pixels a role, WIDTH x HEIGHT; masks of two roles.
ROLES = ("click", "error", "purchase", "signup", "view")
WIDTH, HEIGHT, AREA, NEAR, MOVING = len(ROLES), 4, 2, 1, 0.2


def _tracks(s, d) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    return D.tracks(s, d).select("rollout_id", "role", "t", place.alias("px"), F.floor(F.coalesce("x", F.lit(0.0))).alias("v"), F.col("x").isNotNull().alias("seen"))


def pixel_rows(s, d) -> DataFrame:
    p = _tracks(s, d).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))))
    return p.select("rollout_id", "t", F.col("px").alias("x"), "y", (F.col("v") % 256).alias("r"), ((F.col("v") * 3 + F.col("y")) % 256).alias("g"), ((F.col("t") * 7) % 256).alias("b"))


def masks(s, d) -> DataFrame:
    m = _tracks(s, d).filter(F.col("seen") & F.col("role").isin(D.SUBJECT, D.OBJECT))
    return m.select("rollout_id", "role", "t", F.col("px").alias("x"), F.explode(F.sequence(F.lit(0), (F.col("v") % 3).cast("int"))).alias("y"))


def sizes(s, d) -> DataFrame:
    return D.tracks(s, d).groupBy("rollout_id").agg((F.max("t") + 1).alias("n")).select("rollout_id", F.lit(WIDTH).alias("w"), F.lit(HEIGHT).alias("h"), "n")


def detections(s, d) -> DataFrame:
    """Two candidates a frame and role: a box at (value, k) with a score drawn from the id."""
    t = D.table(s, d, "events").select(F.col("user_id").alias("rollout_id"), F.col("event_type").alias("role"), F.expr("cast(event_id div 64 as int)").alias("t"), F.col("event_id").alias("k"),
                                       F.col("value").alias("x0"), F.get_json_object("props", "$.k").cast("double").alias("y0"), ((F.col("event_id") % 10) / 10).alias("score"))
    return t.withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 20})


def _windowed(fn):
    def run(s, d):
        w = fn(D.table(s, d, "events"))
        at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
        return w.select("user_id", at("start"), at("end").alias("stop"), "n", "mean")

    return run


def sparkline(s, d) -> DataFrame:
    """Points of each rollout's object series, scaled to [0, 1]; none below two points."""
    o = D.tracks(s, d).filter(F.col("role") == D.OBJECT).filter("x is not null")
    g = o.groupBy("rollout_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda p: p["x"]).alias("v")).filter("size(v) >= 2")
    low, span = F.array_min("v"), F.array_max("v") - F.array_min("v")
    g = g.select("rollout_id", F.posexplode(F.transform("v", lambda x: F.when(span > 0, (x - low) / span).otherwise(0.0))).alias("i", "u"))
    return g


QUERIES = {
    "a11_centroid_area": lambda s, d: pixels.centroids(masks(s, d), AREA),
    "f23_anchor_deviation": lambda s, d: pixels.anchor_deviation(pixel_rows(s, d), pixels.foreground(masks(s, d), sizes(s, d).drop("n"), NEAR)),
    "g4_background_drift": lambda s, d: pixels.background_drift(pixel_rows(s, d), masks(s, d), sizes(s, d), NEAR),
    "r1_colour_bindings": lambda s, d: pixels.colour_bindings(pixels.centroids(masks(s, d)), sizes(s, d).select("rollout_id", "n")),
    "r1_colour_visibility": lambda s, d: pixels.colour_visibility(pixels.centroids(masks(s, d))),
    "r6_relational_roles": lambda s, d: induction.roles(D.tracks(s, d).withColumnRenamed("role", "entity_name").withColumn("entity", F.array_position(F.array(*map(F.lit, ROLES)), F.col("entity_name")).cast("int") - 1), ["rollout_id"], DIAGONAL, MOVING),
    "s16_sparkline": sparkline,
    "t1_tumbling": _windowed(lambda e: windows.tumbling(e, ["user_id"], "8 hours")),
    "t2_sliding": _windowed(lambda e: windows.sliding(e, ["user_id"], "5 hours", "2 hours")),
    "t3_sessions": _windowed(lambda e: windows.sessions(e, ["user_id"], "6 hours")),
    "t5_once_by_key": lambda s, d: windows.once_by_key(D.table(s, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type"),
    "u1_foreground": lambda s, d: pixels.foreground(masks(s, d), sizes(s, d).drop("n"), NEAR),
    "w12_t4_linking": lambda s, d: linking.link(detections(s, d), DIAGONAL),
}

_PX = f"""tk AS (SELECT rollout_id, role, t::INT AS t, (list_position({list(ROLES)}, role) - 1)::INT AS px, floor(coalesce(x, 0))::BIGINT AS v, x IS NOT NULL AS seen FROM tracks),
pix AS (SELECT rollout_id, t, px AS x, y::INT AS y, v % 256 AS r, (v * 3 + y) % 256 AS g, t * 7 % 256 AS b FROM tk, range(0, {HEIGHT}) u(y)),
msk AS (SELECT rollout_id, role, t, px AS x, y::INT AS y FROM tk, range(0, 3) u(y) WHERE seen AND role IN ('click', 'view') AND y <= v % 3),
sz AS (SELECT rollout_id, max(t) + 1 AS n FROM tk GROUP BY 1),
fg AS (SELECT DISTINCT rollout_id, least(greatest(x + dx, 0), {WIDTH - 1})::INT AS x, least(greatest(y + dy, 0), {HEIGHT - 1})::INT AS y FROM msk, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
bg AS (SELECT rollout_id, t, x, y, (r + g + b) / 3.0::DOUBLE AS v FROM pix ANTI JOIN fg USING (rollout_id, x, y)),
dv AS (SELECT a.rollout_id, a.t, avg(abs(a.v - z.v)) AS dev, count(*) AS background FROM bg a JOIN bg z ON a.rollout_id = z.rollout_id AND a.x = z.x AND a.y = z.y AND z.t = 0 AND a.t > 0 GROUP BY ALL),
ca AS (SELECT rollout_id, role, t, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM msk GROUP BY ALL)"""


def _window_sql(source: str, stop: str) -> str:
    f = "'%Y-%m-%d %H:%M:%S'"
    return f"SELECT user_id, strftime(b, {f}) AS start, strftime({stop}, {f}) AS stop, count(*) AS n, avg(value) AS mean FROM ({source}) GROUP BY user_id, b"


ORACLES = {
    "a11_centroid_area": ("cx cy", f"WITH {_PX} SELECT rollout_id, role, t, area, CASE WHEN area >= {AREA} THEN cx END AS cx, CASE WHEN area >= {AREA} THEN cy END AS cy FROM ca"),
    "f23_anchor_deviation": ("dev", f"WITH {_PX} SELECT * FROM dv"),
    "g4_background_drift": ("value", f"""WITH {_PX}, kk AS (SELECT rollout_id, n, least({pixels.SAMPLES}, n - 1) AS k FROM sz WHERE n >= 2),
tm AS (SELECT DISTINCT rollout_id, CASE WHEN k = 1 THEN 1 WHEN i = k - 1 THEN n - 1 ELSE floor(1 + i * ((n - 2)::DOUBLE / (k - 1))) END::INT AS t FROM kk, range(0, {pixels.SAMPLES}) u(i) WHERE i < k),
rk AS (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY rollout_id) AS m FROM tm),
lt AS (SELECT rollout_id, avg(dev) AS late, max(background) AS background FROM rk JOIN dv USING (rollout_id, t) WHERE p >= m // 2 GROUP BY 1),
okk AS (SELECT rollout_id, late, coalesce(n >= {pixels.LEAST_FRAMES} AND background >= {pixels.LEAST_BACKGROUND} * {WIDTH * HEIGHT}, false) AS ok FROM sz LEFT JOIN lt USING (rollout_id))
SELECT rollout_id, 'background_drift' AS signal, CASE WHEN ok THEN 'ok' ELSE 'evidence_missing' END AS status, CASE WHEN ok THEN exp(-late / {pixels.SCALE}) END AS value FROM okk"""),
    "r1_colour_bindings": ("quality", f"WITH {_PX} SELECT rollout_id, role, min(t) < greatest(3, any_value(n) // 20) AS bound, count(DISTINCT t)::DOUBLE / any_value(n) AS quality FROM ca JOIN sz USING (rollout_id) GROUP BY ALL"),
    "r1_colour_visibility": ("visibility", f"WITH {_PX} SELECT rollout_id, role, t, area::DOUBLE / max(area) OVER (PARTITION BY rollout_id, role) AS visibility FROM ca"),
    "r6_relational_roles": ("", f"""WITH {_PX}, n AS (SELECT rollout_id, max(t) + 1 AS n FROM tracks GROUP BY 1),
o AS (SELECT rollout_id, px AS e, a.t, x, y, t >= floor(n * {induction.SETTLED}::DOUBLE) AS late FROM tracks a JOIN tk USING (rollout_id, role, t) JOIN n USING (rollout_id)),
st AS (SELECT rollout_id, e, coalesce(avg(x) FILTER (late), avg(x)) AS fx, coalesce(avg(y) FILTER (late AND x IS NOT NULL), avg(y)) AS fy, bool_or(late) AS late,
  sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) >= {MOVING * DIAGONAL} AS mover FROM o WHERE x IS NOT NULL GROUP BY ALL),
pr AS (SELECT m.rollout_id, arg_min({{'m': m.e, 's': s.e}}, (sqrt(pow(m.fx - s.fx, 2) + pow(m.fy - s.fy, 2)), m.e, s.e)) AS b FROM st m JOIN st s ON m.rollout_id = s.rollout_id AND m.mover AND NOT s.mover GROUP BY 1),
vl AS (SELECT rollout_id, e, t, coalesce(x, 0) - lag(coalesce(x, 0)) OVER w AS dx, coalesce(y, 0) - lag(coalesce(y, 0)) OVER w AS dy FROM o WINDOW w AS (PARTITION BY rollout_id, e ORDER BY t)),
cr AS (SELECT a.rollout_id, a.e, sum(a.dx * c.dx + a.dy * c.dy) / nullif(sqrt(sum(a.dx * a.dx + a.dy * a.dy)) * sqrt(sum(c.dx * c.dx + c.dy * c.dy)), 0) AS r
  FROM vl a JOIN pr ON a.rollout_id = pr.rollout_id JOIN vl c ON c.rollout_id = a.rollout_id AND c.t = a.t AND c.e = pr.b.m WHERE a.e <> pr.b.m GROUP BY ALL),
ef AS (SELECT rollout_id, arg_min(e, (-coalesce(r, 0), e)) AS e FROM cr JOIN st USING (rollout_id, e) WHERE mover GROUP BY 1)
SELECT q.rollout_id, pr.b.m AS carried, pr.b.s AS receptacle, ef.e AS effector,
  coalesce(h.late AND c.late AND sqrt(pow(h.fx - c.fx, 2) + pow(h.fy - c.fy, 2)) < {induction.SEPARATE}, false) AS ambiguous
FROM (SELECT DISTINCT rollout_id FROM st) q LEFT JOIN pr ON pr.rollout_id = q.rollout_id LEFT JOIN ef ON ef.rollout_id = q.rollout_id
LEFT JOIN st h ON h.rollout_id = q.rollout_id AND h.e = ef.e LEFT JOIN st c ON c.rollout_id = q.rollout_id AND c.e = pr.b.m"""),
    "s16_sparkline": ("u", """WITH o AS (SELECT rollout_id, t, x, min(x) OVER w AS lo, max(x) OVER w AS hi, count(*) OVER w AS n FROM tracks WHERE role = 'view' AND x IS NOT NULL WINDOW w AS (PARTITION BY rollout_id))
SELECT rollout_id, (row_number() OVER (PARTITION BY rollout_id ORDER BY t) - 1)::INT AS i, CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END AS u FROM o WHERE n >= 2"""),
    "t1_tumbling": ("mean", _window_sql("SELECT *, time_bucket(INTERVAL 8 hours, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS b FROM events", "b + INTERVAL 8 hours")),
    "t2_sliding": ("mean", _window_sql("SELECT *, time_bucket(INTERVAL 2 hours, ts::TIMESTAMP, TIMESTAMP '1970-01-01') - k * INTERVAL 2 hours AS b FROM events, range(0, 3) u(k) WHERE time_bucket(INTERVAL 2 hours, ts::TIMESTAMP, TIMESTAMP '1970-01-01') - k * INTERVAL 2 hours + INTERVAL 5 hours > ts", "b + INTERVAL 5 hours")),
    "t3_sessions": ("mean", _window_sql("SELECT *, min(ts) OVER (PARTITION BY user_id, sid) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 hours THEN 0 ELSE 1 END AS new FROM events))", "max(ts) + INTERVAL 6 hours")),
    "t5_once_by_key": ("", "SELECT DISTINCT user_id, event_type FROM events"),
    "u1_foreground": ("", f"WITH {_PX} SELECT * FROM fg"),
}

"""Scalar functions, parsers, joins and sinks' columns as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradewright.operators import replies as R
from gradewright.operators.columns import half_even, iso_seconds
from gradewright.operators.cumulative import percentiles, places
from gradewright.sources import domain as D
from gradewright.sources import files
from gradewright.spec import hostile

#: Named colours and their RGB; of equally near ones the first counts.
PALETTE = (("red", 210, 50, 50), ("green", 50, 180, 70), ("blue", 50, 80, 220), ("yellow", 230, 200, 50), ("purple", 160, 50, 200), ("orange", 230, 140, 40), ("white", 240, 240, 240), ("gray", 128, 128, 128), ("black", 30, 30, 30))
#: Colour words and the range of each channel.
RANGES = {"red": ((150, 0, 0), (255, 90, 90)), "green": ((0, 120, 0), (90, 230, 110)), "blue": ((0, 0, 150), (90, 110, 255))}
#: Fixed value: the frame rate of a file that tells none.
FPS = 10.0


def events(s, d):
    return D.table(s, d, "events")


def duplicates(s, d):
    name = F.regexp_replace(F.split_part("url", F.lit("/"), F.lit(4)), "[^A-Za-z0-9._-]+", "_")
    return D.table(s, d, "pages").groupBy(name.alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def palette_rows():
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for i, (n, r, g, b) in enumerate(PALETTE)])


def nearest_colour(r, g, b):
    """The nearest named colour; the first of equals in the order of the palette."""
    square = lambda p, c, v: (v - p[c]) * (v - p[c])
    return F.array_min(F.transform(palette_rows(), lambda p: F.struct((square(p, "r", r) + square(p, "g", g) + square(p, "b", b)).alias("d"), p["i"].alias("i"), p["name"].alias("name"))))["name"]


def colours(s, d):
    e = events(s, d).select("event_id", *[((F.col("event_id") * m) % 256).cast("long").alias(c) for c, m in (("r", 7), ("g", 13), ("b", 29))])
    return e.select("event_id", nearest_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


def colour_range(candidates):
    """struct(keyword, lo, hi) of the first candidate that holds a keyword, of its keywords the first of the table; else null."""
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*map(F.lit, lo)).alias("lo"), F.array(*map(F.lit, hi)).alias("hi")) for k, (lo, hi) in RANGES.items()])
    found = F.flatten(F.transform(candidates, lambda c: F.filter(table, lambda k: F.contains(F.lower(c), k["keyword"]))))
    return F.get(found, F.lit(0))


def in_range(found, *channels):
    inside = F.lit(True)
    for i, c in enumerate(channels):
        inside = inside & c.between(F.get(found["lo"], F.lit(i)), F.get(found["hi"], F.lit(i)))
    return F.coalesce(inside, F.lit(False))


def range_filter(s, d):
    """Pixels drawn from an event's id, kept where they lie in the range of the colour that its candidates name."""
    names = F.array(F.concat(F.lit("Big "), F.when(F.col("event_id") % 3 == 0, "RED block").otherwise("thing")), F.when(F.col("event_id") % 2 == 0, "green cup").otherwise("Blue dot"))
    e = events(s, d).select("event_id", *[((F.col("event_id") * m) % 256).alias(c) for c, m in (("r", 7), ("g", 13), ("b", 29))], colour_range(names).alias("k"))
    return e.filter(in_range(F.col("k"), F.col("r"), F.col("g"), F.col("b"))).select("event_id", "k.keyword")


def replies(s, d):
    """rollout_id, run, reply, shown, frames: synthesised answers in five styles; run 0 shows the frames in order, run 1 backwards."""
    t = D.tracks(s, d).filter("role = 'click'")
    n = t.groupBy("rollout_id").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("a"))
    n = n.withColumn("frames", F.size("a")).withColumn("k", F.least(F.lit(12), F.size("a"))).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    n = n.withColumn("shown", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.when(F.col("run") == 0, i).otherwise(F.col("k") - 1 - i)))
    style = (F.col("rollout_id") + F.col("run")) % 5
    percent = lambda i: F.coalesce((F.get("a", F.get("shown", i))["y"] + 3 * F.col("run")).cast("int"), F.lit(0)).cast("string")
    line = lambda i: (F.when(style == 0, F.concat(F.lit("Frame "), (i + 1).cast("string"), F.lit(": "), percent(i), F.lit("%"))).when(style == 1, F.concat(i.cast("string"), F.lit(" = "), percent(i)))
                      .when(style == 2, F.concat(F.lit("FRAME"), (i + 2).cast("string"), F.lit(" - "), percent(i), F.lit(" %"))).when(style == 3, F.concat(F.lit("about "), percent(i), F.lit("% done"))).otherwise(F.lit("cannot tell")))
    return n.select("rollout_id", "run", "frames", "shown", F.array_join(F.transform(F.sequence(F.lit(0), F.col("k") - 1), line), "\n").alias("reply"))


def parsed(s, d):
    r = replies(s, d).select("rollout_id", "run", F.posexplode(R.parse(F.col("reply"), F.size("shown"))).alias("i", "v"))
    return r.filter("v is not null")


def gvl(s, d):
    p = R.progress(replies(s, d), ["rollout_id"])
    part = lambda k: F.try_element_at("score.details", F.lit(k))
    return p.select("rollout_id", "score.status", "score.value", "score.confidence", "score.reason", part("voc").alias("voc"), part("reshuffle_agreement").alias("agreement"), part("n_frames_scored").cast("long").alias("frames"))


def run_differences(s, d):
    """Mean absolute difference of every two runs on the frames that all runs answered."""
    r = replies(s, d).select("rollout_id", "run", R.unshuffled(R.parse(F.col("reply"), F.size("shown")), F.col("shown")).alias("v"))
    r = r.select("rollout_id", "run", F.posexplode("v").alias("i", "v")).filter("v is not null")
    w = Window.partitionBy("rollout_id", "i")
    all_runs = r.groupBy("rollout_id").agg(F.countDistinct("run").alias("runs"))
    r = r.withColumn("got", F.count("*").over(w)).join(all_runs, "rollout_id").filter("got = runs and runs > 1")
    a, b = r.alias("a"), r.alias("b")
    j = a.join(b, (F.col("a.rollout_id") == F.col("b.rollout_id")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.run") < F.col("b.run")))  # a handful of runs
    return j.groupBy(F.col("a.rollout_id").alias("rollout_id"), F.col("a.run").alias("a"), F.col("b.run").alias("b")).agg(F.avg(F.abs(F.col("a.v") - F.col("b.v"))).alias("diff"), F.count("*").alias("frames"))


#: Bins of the colour code r + 2 g + 4 b, which goes up to CODES.
BINS, CODES = 24, 7 * 255


def histogram_similarity(s, d):
    """24-bin histograms of the colour codes of a user's clicks and views (colours drawn from the event's id), and the sum of the lesser shares."""
    code = (F.col("event_id") * 7) % 256 + 2 * ((F.col("event_id") * 13) % 256) + 4 * ((F.col("event_id") * 29) % 256)
    e = events(s, d).filter("event_type in ('click', 'view')").select("user_id", "event_type", F.least(F.lit(BINS - 1), F.floor(code * F.lit(float(BINS)) / CODES)).cast("int").alias("bin"))
    g = e.groupBy("user_id", "bin").agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    w = Window.partitionBy("user_id")
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1))
    return g.select("user_id", F.least(share("a"), share("b")).alias("m")).groupBy("user_id").agg(F.sum("m").alias("similarity"))


def probed_fps(c):
    """A file's frame rate, or FPS where it is absent, not finite or not above zero."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (c > 0), c).otherwise(FPS)


def fps(s, d):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("value") - 50)
    return events(s, d).select("event_id", probed_fps(v.cast("double")).alias("fps"))


def task_id(c):
    """The part before the first _user."""
    return F.split_part(c, F.lit("_user"), F.lit(1))


def rating_label(c):
    """2 and more is a success, 0 and 1 a failure; anything below 0 has no label."""
    return F.when(c >= 2, True).when(c >= 0, False)


def hostile_texts(s, d):
    """Texts of specifications that are refused for a control character or a Unicode separator."""
    odd = F.get(F.array(*[F.lit(x) for x in ("", "\t", "\n", "\x07", "\x85", "\u2028", "x")]), (F.col("item_id") % 7).cast("int"))
    return D.table(s, d, "benchmark").select("item_id", hostile(F.concat(F.col("text"), odd)).alias("refused"))


def merged_meta(s, d):
    """Two maps as one, the right one's value where both hold a key."""
    old = F.create_map(F.lit("_dir"), F.lit("/old"), F.lit("k"), F.get_json_object("props", "$.k"))
    new = F.create_map(F.lit("_dir"), F.concat(F.lit("/in/"), F.col("user_id").cast("string")))
    return events(s, d).select("event_id", F.explode(files.merged(old, new)).alias("key", "value"))


def half_split(s, d):
    """The first half of each class (one at least) are prototypes, the others tests."""
    p = places(D.table(s, d, "embeddings").select("vec_id", "label"), "vec_id", ["label"])
    return p.select("vec_id", F.when(F.col("place") < F.greatest(F.lit(1), F.expr("of div 2")), "prototype").otherwise("test").alias("part"))


def cross_correlation(s, d):
    f = D.frames(D.tracks(s, d)).filter("sx is not null and ox is not null")
    return f.groupBy("rollout_id").agg(F.count("*").alias("n"), F.corr("sx", "ox").alias("c"), F.stddev_pop("sx").alias("a"), F.stddev_pop("ox").alias("b")).select(
        "rollout_id", F.when((F.col("n") > 1) & (F.col("a") * F.col("b") > 1e-6), F.col("c")).otherwise(0.0).alias("ncc"))


def balanced(s, d):
    """The three nations with the best balance of customers in credit and in debt, and the first two of each by key."""
    c = D.table(s, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") >= 0).alias("p"), F.count_if(F.col("c_acctbal") < 0).alias("m"))
    return c.orderBy(F.desc(F.least("p", "m")), "c_nationkey").limit(3).select("c_nationkey", F.least("p", "m").alias("balance"))


QUERIES = {
    "f1_s13_sanitise": lambda s, d: D.table(s, d, "pages").select("page_id", F.regexp_replace("url", "[^A-Za-z0-9._-]+", "_").alias("name")),
    "f4_describe": lambda s, d: D.bindings(D.tracks(s, d)).select("rollout_id", F.concat(F.lit("co_located("), "role", F.lit(", view)")).alias("text")),
    "f5_html_escape": lambda s, d: D.table(s, d, "benchmark").select("item_id", F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("html")),
    "f6_task_prefix": lambda s, d: events(s, d).select("event_id", task_id(F.concat(F.lit("task_"), "event_type", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("_user"), F.col("user_id").cast("string"), F.lit("_user2"))).otherwise(""))).alias("task")),
    "f7_digest": lambda s, d: D.table(s, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256")),
    "f10_f11_decay": lambda s, d: events(s, d).select("event_id", F.exp(-F.col("value") / 12).alias("health")),
    "f12_clip": lambda s, d: events(s, d).select("event_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("v")),
    "f17_finite": lambda s, d: events(s, d).agg(F.count_if(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).alias("finite"), F.count("*").alias("n")),
    "f19_dot": lambda s, d: D.table(s, d, "embeddings").select("vec_id", F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x).alias("dot")),
    "f22_gray": lambda s, d: events(s, d).select("event_id", ((F.col("event_id") % 256 + F.col("user_id") % 256 + F.lit(10)) / 3.0).alias("gray")),
    "f26_severity": lambda s, d: events(s, d).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 1).otherwise(0)).alias("severity")),
    "f28_s17_gold_labels": lambda s, d: D.table(s, d, "orders").select("o_orderkey", F.when(F.lower("o_orderstatus") == "f", True).when(F.lower("o_orderstatus") == "o", False).alias("gold")),
    "s7_probe_fps": fps,
    "s20_corruption_freeze": lambda s, d: (lambda t: t.withColumn("f", F.max(F.when(F.col("t") == 2, F.col("x"))).over(Window.partitionBy("rollout_id", "role"))).select("rollout_id", "role", "t", F.when(F.col("t") >= 2, F.col("f")).otherwise(F.col("x")).alias("x")))(D.tracks(s, d)),
    "p13_range_filter": range_filter,
    "p14_rating_label": lambda s, d: D.table(s, d, "part").select("p_partkey", rating_label(F.col("p_size") % 7 - 3).alias("label")).filter("label is not null"),
    "p15_phrase_match": lambda s, d: D.table(s, d, "part").select("p_partkey", (F.contains(F.lower("p_type"), F.lit("steel")) | F.contains(F.lit("steel"), F.lower("p_type"))).alias("match")),
    "p18_nearest_colour": colours,
    "p19_duplicates": duplicates,
    "a7_percentile_median": lambda s, d: percentiles(events(s, d), "value", {"p99": 0.99, "p90": 0.9, "median": 0.5}, ["event_type"]),
    "a13_mode": lambda s, d: events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "event_type")).alias("mode"), F.max("n").alias("n")),
    "a15_histogram_similarity": histogram_similarity,
    "a16_cross_correlation": cross_correlation,
    "a17_mean_normalise": lambda s, d: (lambda x: x.withColumn("q", F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))).select("label", "i", (F.col("m") / F.col("q")).alias("v")))(D.table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))),
    "a22_distinct_sources": lambda s, d: D.table(s, d, "documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs")),
    "w5_tumbling_chunks": lambda s, d: D.tracks(s, d).groupBy("rollout_id", "role", F.expr("t div 8").alias("chunk")).agg(F.max_by("x", "t").alias("last"), F.min_by("x", "t").alias("first"), F.count("*").alias("n")),
    "w7_early_level": lambda s, d: (lambda t: t.withColumn("n", F.count("*").over(Window.partitionBy("rollout_id", "role"))).filter(F.col("t") < F.greatest(F.lit(2), F.expr("n div 10"))).groupBy("rollout_id", "role").agg(F.avg("vis").alias("early")))(D.tracks(s, d)),
    "w14_smoothstep": lambda s, d: events(s, d).select("event_id", (lambda u: u * u * (3 - 2 * u))((F.col("event_id") % 60) / 59.0).alias("ease")),
    "j1_pivot_align": lambda s, d: D.frames(D.tracks(s, d)).select("rollout_id", "t", "sx", "ox"),
    "j2_role_lookup": lambda s, d: (lambda t: t.select("rollout_id").distinct().join(D.bindings(t).filter("role = 'purchase'").select("rollout_id", "bound"), "rollout_id", "left").select("rollout_id", F.coalesce("bound", F.lit(False)).alias("bound")))(D.tracks(s, d)),
    "j12_u4_run_differences": run_differences,
    "c9_gvl_progress": gvl,
    "f3_text_functions": lambda s, d: D.table(s, d, "part").select("p_partkey", F.replace(F.lower(F.trim("p_name")), F.lit(" "), F.lit("_")).alias("phrase"), F.contains(F.lower("p_type"), F.lit("brass")).alias("holds"), F.concat_ws(", ", "p_brand", "p_type").alias("listed"), F.format_string("%s x %d", "p_brand", "p_size").alias("shown")),
    "f9_iso_seconds": lambda s, d: events(s, d).select("event_id", iso_seconds(F.col("ts")).alias("iso")),
    "f16_half_even": lambda s, d: events(s, d).select("event_id", half_even(F.col("event_id") / 8.0, 1).alias("r")),
    "f25_meta_merge": merged_meta,
    "f27_percent": lambda s, d: events(s, d).select("event_id", F.format_string("%.0f%%", 100 * (F.col("event_id") % 7) / 7.0).alias("shown")),
    "p20_hostile_text": hostile_texts,
    "f2_reply_parser": parsed,
    "u3_moving_or": lambda s, d: events(s, d).groupBy("user_id", F.expr("event_id div 64").alias("slot")).agg(F.bool_or(F.col("value") > 100).alias("moving")),
    "u2_complement": lambda s, d: D.table(s, d, "customer").join(D.table(s, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "j14_set_equality": lambda s, d: (lambda b: b.groupBy("rollout_id").agg((F.array_join(F.array_sort(F.collect_set("role")), ",") == "click,error,purchase,signup,view").alias("complete")))(D.bindings(D.tracks(s, d))),
    "o6_top_k": balanced,
    "z15_first_per_policy": lambda s, d: D.tracks(s, d).select("policy", "rollout_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("policy").orderBy("rollout_id"))).filter("k <= 3"),
    "z18_tier_policy": lambda s, d: D.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority")).otherwise(F.concat(F.lit("cl_"), "o_orderstatus")).alias("policy")),
    "z19_half_split": half_split,
}

_REP = """rb AS (SELECT rollout_id, run, count(*) AS frames, least(12, count(*)) AS k, list(y ORDER BY t) AS ys FROM tracks, (VALUES (0), (1)) r(run) WHERE role = 'click' GROUP BY ALL),
rl AS (SELECT rollout_id, run, frames, k, i, CASE run WHEN 0 THEN i ELSE k - 1 - i END AS c, coalesce((ys[CASE run WHEN 0 THEN i ELSE k - 1 - i END + 1] + 3 * run)::INT, 0) AS p FROM rb, range(0, 12) u(i) WHERE i < k),
rp AS (SELECT rollout_id, run, any_value(frames) AS frames, any_value(k) AS k, string_agg(CASE (rollout_id + run) % 5 WHEN 0 THEN 'Frame ' || (i + 1) || ': ' || p || '%' WHEN 1 THEN i || ' = ' || p WHEN 2 THEN 'FRAME' || (i + 2) || ' - ' || p || ' %' WHEN 3 THEN 'about ' || p || '% done' ELSE 'cannot tell' END, chr(10) ORDER BY i) AS reply FROM rl GROUP BY ALL),
px AS (SELECT rollout_id, run, k, regexp_extract_all(reply, '(?i)(?:frame\\s*)?(\\d+)\\s*[:=\\-]\\s*(\\d{1,3})\\s*%?', 1) AS i, regexp_extract_all(reply, '(?i)(?:frame\\s*)?(\\d+)\\s*[:=\\-]\\s*(\\d{1,3})\\s*%?', 2) AS v, regexp_extract_all(reply, '\\b(\\d{1,3})\\s*%', 1) AS bare FROM rp),
pf AS (SELECT rollout_id, run, o, px.i[j]::INT - off AS slot, arg_min(least(100, px.v[j]::INT) / 100.0::DOUBLE, j) AS v FROM px, range(1, 200) u(j), (VALUES (0, 1), (1, 0), (2, 2)) w(o, off) WHERE j <= len(px.i) AND px.i[j]::INT - off BETWEEN 0 AND k - 1 GROUP BY ALL),
pb AS (SELECT rollout_id, run, arg_min(o, (-n, o)) AS o FROM (SELECT rollout_id, run, o, count(*) AS n FROM pf GROUP BY ALL) GROUP BY ALL),
ps AS (SELECT rollout_id, run, slot AS i, v FROM pf JOIN pb USING (rollout_id, run, o) UNION ALL SELECT rollout_id, run, j - 1, least(100, bare[j]::INT) / 100.0::DOUBLE FROM px ANTI JOIN pb USING (rollout_id, run), range(1, 13) u(j) WHERE j <= len(bare) AND j <= k),
pc AS (SELECT rollout_id, run, CASE run WHEN 0 THEN i ELSE k - 1 - i END AS c, v FROM ps JOIN rp USING (rollout_id, run))"""
_GVL = """mv AS (SELECT rollout_id, c, avg(v) AS m, count(*) = 2 AS every FROM pc GROUP BY ALL),
ag AS (SELECT x.rollout_id, avg(abs(x.v - y.v)) AS diff, count(*) AS n FROM pc x JOIN pc y ON x.rollout_id = y.rollout_id AND x.c = y.c AND x.run = 0 AND y.run = 1 GROUP BY 1),
rk AS (SELECT rollout_id, c, m, rank() OVER (PARTITION BY rollout_id ORDER BY m) + (count(*) OVER (PARTITION BY rollout_id, m) - 1) / 2.0 AS rm, row_number() OVER (PARTITION BY rollout_id ORDER BY c) AS rc, row_number() OVER (PARTITION BY rollout_id ORDER BY c DESC) AS back, first_value(m) OVER (PARTITION BY rollout_id ORDER BY c) AS m0 FROM mv),
vc AS (SELECT rollout_id, count(*) AS n, CASE WHEN count(*) >= 3 AND NOT bool_and(abs(m - m0) <= 1e-8 + 1e-5 * abs(m0)) THEN corr(rm, rc) ELSE 0 END AS voc, avg(m) FILTER (back <= 3) AS last FROM rk GROUP BY 1),
an AS (SELECT rollout_id, any_value(frames) AS frames, any_value(k) AS k FROM rp GROUP BY 1),
av AS (SELECT rollout_id, count(*) AS answered FROM pc GROUP BY 1),
gz AS (SELECT an.rollout_id, frames, coalesce(answered, 0) >= greatest(3, k) AS enough, coalesce(voc, 0) AS voc, CASE WHEN ag.n >= 3 THEN least(1, greatest(0, 1 - 2 * diff)) ELSE 0.5 END AS agreement, vc.n AS scored, last FROM an LEFT JOIN av USING (rollout_id) LEFT JOIN vc USING (rollout_id) LEFT JOIN ag USING (rollout_id))"""

ORACLES = {
    "f2_reply_parser": ("v", f"WITH {_REP} SELECT rollout_id, run, i::INT AS i, v FROM ps"),
    "c9_gvl_progress": ("value confidence voc agreement", f"""WITH {_REP}, {_GVL} SELECT rollout_id, CASE WHEN ok THEN 'ok' ELSE 'evidence_missing' END AS status, CASE WHEN ok THEN last END AS value, CASE WHEN ok THEN least(1, greatest(0, (greatest(voc, 0) + agreement) / 2)) ELSE 0 END AS confidence,
  CASE WHEN frames < 4 THEN 'rollout too short' WHEN NOT enough THEN 'most frames have no readable answer' WHEN round(voc, 9) <= 0 THEN 'progress does not follow time' ELSE '' END AS reason,
  CASE WHEN ok THEN voc END AS voc, CASE WHEN ok THEN agreement END AS agreement, CASE WHEN ok THEN scored END AS frames FROM (SELECT *, frames >= 4 AND enough AS ok FROM gz)"""),
    "j12_u4_run_differences": ("diff", f"WITH {_REP} SELECT x.rollout_id, x.run AS a, y.run AS b, avg(abs(x.v - y.v)) AS diff, count(*) AS frames FROM pc x JOIN pc y ON x.rollout_id = y.rollout_id AND x.c = y.c AND x.run < y.run GROUP BY ALL"),
    "f3_text_functions": ("", "SELECT p_partkey, replace(lower(trim(p_name)), ' ', '_') AS phrase, contains(lower(p_type), 'brass') AS holds, concat_ws(', ', p_brand, p_type) AS listed, printf('%s x %d', p_brand, p_size) AS shown FROM part"),
    "f9_iso_seconds": ("", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events"),
    "f16_half_even": ("r", "SELECT event_id, round_even(event_id / 8.0::DOUBLE, 1) AS r FROM events"),
    "f25_meta_merge": ("", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, '_dir', '/in/' || user_id FROM events"),
    "f27_percent": ("", "SELECT event_id, printf('%.0f%%', 100 * (event_id % 7) / 7.0::DOUBLE) AS shown FROM events"),
    "p20_hostile_text": ("", "SELECT item_id, item_id % 7 IN (3, 4, 5) AS refused FROM benchmark"),
    "f1_s13_sanitise": ("", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages"),
    "f4_describe": ("", "SELECT rollout_id, 'co_located(' || role || ', view)' AS text FROM bindings"),
    "f5_html_escape": ("", "SELECT item_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM benchmark"),
    "f6_task_prefix": ("", "SELECT event_id, 'task_' || event_type AS task FROM events"),
    "f7_digest": ("", "SELECT item_id, sha256(text) AS sha256 FROM benchmark"),
    "f10_f11_decay": ("health", "SELECT event_id, exp(-value / 12) AS health FROM events"),
    "f12_clip": ("v", "SELECT event_id, least(1, greatest(0, value / 100)) AS v FROM events"),
    "f17_finite": ("", "SELECT count(*) FILTER (isfinite(value)) AS finite, count(*) AS n FROM events"),
    "f19_dot": ("dot", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS dot FROM embeddings"),
    "f22_gray": ("gray", "SELECT event_id, (event_id % 256 + user_id % 256 + 10) / 3.0 AS gray FROM events"),
    "f26_severity": ("", "SELECT user_id, max(CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END)::INT AS severity FROM events GROUP BY 1"),
    "f28_s17_gold_labels": ("", "SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN true WHEN 'o' THEN false END AS gold FROM orders"),
    "s7_probe_fps": ("fps", "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 10 WHEN value - 50 > 0 THEN value - 50 ELSE 10 END::DOUBLE AS fps FROM events"),
    "s20_corruption_freeze": ("x", "SELECT rollout_id, role, t::INT AS t, CASE WHEN t >= 2 THEN max(x) FILTER (t = 2) OVER (PARTITION BY rollout_id, role) ELSE x END AS x FROM tracks"),
    "p13_range_filter": ("", f"""WITH e AS (SELECT event_id, event_id * 7 % 256 AS r, event_id * 13 % 256 AS g, event_id * 29 % 256 AS b, CASE WHEN event_id % 3 = 0 THEN 'red' WHEN event_id % 2 = 0 THEN 'green' ELSE 'blue' END AS keyword FROM events),
k(keyword, r0, g0, b0, r1, g1, b1) AS (VALUES {', '.join(str((w, *lo, *hi)) for w, (lo, hi) in RANGES.items())}) SELECT event_id, keyword FROM e JOIN k USING (keyword) WHERE r BETWEEN r0 AND r1 AND g BETWEEN g0 AND g1 AND b BETWEEN b0 AND b1"""),
    "p14_rating_label": ("", "SELECT p_partkey, p_size % 7 - 3 >= 2 AS label FROM part WHERE p_size % 7 - 3 >= 0"),
    "p15_phrase_match": ("", "SELECT p_partkey, contains(lower(p_type), 'steel') OR contains('steel', lower(p_type)) AS match FROM part"),
    "p18_nearest_colour": ("", f"SELECT event_id, arg_min(name, (pow(event_id * 7 % 256 - r, 2) + pow(event_id * 13 % 256 - g, 2) + pow(event_id * 29 % 256 - b, 2), i)) AS colour FROM events, (VALUES {', '.join(str((i, *p)) for i, p in enumerate(PALETTE))}) v(i, name, r, g, b) GROUP BY 1"),
    "p19_duplicates": ("", "SELECT regexp_replace(split_part(url, '/', 4), '[^A-Za-z0-9._-]+', '_', 'g') AS name, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1"),
    "a7_percentile_median": ("p99 p90 median", "SELECT event_type, quantile_cont(value, 0.99::DOUBLE) AS p99, quantile_cont(value, 0.9::DOUBLE) AS p90, median(value) AS median FROM events GROUP BY 1"),
    "a13_mode": ("", "SELECT user_id, arg_min(event_type, (-n, event_type)) AS mode, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1"),
    "a15_histogram_similarity": ("similarity", """WITH g AS (SELECT user_id, least(23, floor((event_id * 7 % 256 + 2 * (event_id * 13 % 256) + 4 * (event_id * 29 % 256)) * 24.0::DOUBLE / 1785)) AS bin, count(*) FILTER (event_type = 'click')::DOUBLE AS a, count(*) FILTER (event_type = 'view')::DOUBLE AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT user_id, sum(m) AS similarity FROM (SELECT user_id, least(a / greatest(sum(a) OVER w, 1), b / greatest(sum(b) OVER w, 1)) AS m FROM g WINDOW w AS (PARTITION BY user_id)) GROUP BY 1"""),
    "a16_cross_correlation": ("ncc", "SELECT rollout_id, CASE WHEN count(*) > 1 AND stddev_pop(sx) * stddev_pop(ox) > 1e-6 THEN corr(sx, ox) ELSE 0 END AS ncc FROM frames WHERE sx IS NOT NULL AND ox IS NOT NULL GROUP BY 1"),
    "a17_mean_normalise": ("v", "SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS v FROM (SELECT label, (i - 1)::INT AS i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) u(i) GROUP BY label, u.i)"),
    "a22_distinct_sources": ("", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents"),
    "w5_tumbling_chunks": ("last first", "SELECT rollout_id, role, t // 8 AS chunk, arg_max_null(x, t) AS last, arg_min_null(x, t) AS first, count(*) AS n FROM tracks GROUP BY ALL"),
    "w7_early_level": ("early", "SELECT rollout_id, role, avg(vis) AS early FROM (SELECT *, count(*) OVER (PARTITION BY rollout_id, role) AS n FROM tracks) WHERE t < greatest(2, n // 10) GROUP BY ALL"),
    "w14_smoothstep": ("ease", "SELECT event_id, pow((event_id % 60) / 59.0::DOUBLE, 2) * (3 - 2 * (event_id % 60) / 59.0::DOUBLE) AS ease FROM events"),
    "j1_pivot_align": ("sx ox", "SELECT a.rollout_id, a.t::INT AS t, a.x AS sx, b.x AS ox FROM tracks a JOIN tracks b ON a.rollout_id = b.rollout_id AND a.t = b.t AND b.role = 'view' WHERE a.role = 'click'"),
    "j2_role_lookup": ("", "SELECT r.rollout_id, coalesce(bound, false) AS bound FROM (SELECT DISTINCT rollout_id FROM tracks) r LEFT JOIN bindings b ON b.rollout_id = r.rollout_id AND role = 'purchase'"),
    "u3_moving_or": ("", "SELECT user_id, event_id // 64 AS slot, bool_or(value > 100) AS moving FROM events GROUP BY ALL"),
    "u2_complement": ("", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "j14_set_equality": ("", "SELECT rollout_id, string_agg(DISTINCT role, ',' ORDER BY role) = 'click,error,purchase,signup,view' AS complete FROM bindings GROUP BY 1"),
    "o6_top_k": ("", "SELECT c_nationkey, least(count(*) FILTER (c_acctbal >= 0), count(*) FILTER (c_acctbal < 0)) AS balance FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "z15_first_per_policy": ("", "SELECT policy, rollout_id, k FROM (SELECT policy, rollout_id, (row_number() OVER (PARTITION BY policy ORDER BY rollout_id))::INT AS k FROM (SELECT DISTINCT policy, rollout_id FROM tracks)) WHERE k <= 3"),
    "z18_tier_policy": ("", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'cl_' || o_orderstatus END AS policy FROM orders"),
    "z19_half_split": ("", "SELECT vec_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id) <= greatest(1, count(*) OVER (PARTITION BY label) // 2) THEN 'prototype' ELSE 'test' END AS part FROM embeddings"),
}

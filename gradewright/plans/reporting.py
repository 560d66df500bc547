"""Leaderboards, verdict counts and report blocks as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradewright.operators import episode as E
from gradewright.sources import domain as D

from .evaluation import _C1, _PROG, _SIG, SPEC, leaderboard, rollouts, signals, success, verdicts
from .statistics import _PPI, _V, bounds, pairs, ppi, rank_intervals


def scores(spark, sf):
    """rollout_id, policy and the scores of two channels, before any gate: one row a channel."""
    d = rollouts(spark, sf).select("rollout_id", "policy", F.explode(F.array(E.success(SPEC), E.goal_distance(D.SUBJECT, D.OBJECT))).alias("c"))
    return d.select("rollout_id", "policy", "c.channel", "c.eligible", "c.status", "c.value")


def channel_means(spark, sf):
    """Mean value of each policy and channel over scores that are ok."""
    return scores(spark, sf).filter("status = 'ok'").groupBy("policy", "channel").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def ordered(spark, sf):
    """Places by pass rate descending (none last), share of abstentions, name."""
    b = leaderboard(verdicts(spark, sf))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.coalesce("pass_rate", F.lit(-1.0))), F.col("abstained") / F.greatest(F.col("n"), F.lit(1)), "policy")  # a row a policy
    return b.select("policy", F.row_number().over(w).alias("place"))


def worst_signal(spark, sf):
    """Composed score: the least signal, a missing one as zero."""
    return rollouts(spark, sf).select("rollout_id", F.array_min(F.transform(F.array(*signals()), lambda s: F.coalesce(s["value"], F.lit(0.0)))).alias("score"))


def tagged(spark, sf):
    """Demos and negatives under one tag each, from one pass over the verdicts."""
    name = F.col("rollout_id").cast("string")
    both = F.array(F.struct(F.concat(F.lit("demo"), name).alias("tag"), "verdict"), F.struct(F.concat(F.lit("neg"), name, F.lit("_frozen")).alias("tag"), F.lit("fail").alias("verdict")))
    return verdicts(spark, sf).select(F.explode(both).alias("r")).select("r.tag", "r.verdict")


def mean_order(spark, sf):
    """Policies by mean score descending, then name: the order in which rank intervals are listed."""
    m = success(spark, sf).filter("status = 'ok'").groupBy("policy").agg(F.avg("value").alias("mean"))
    return m.select("policy", "mean", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), "policy")).alias("place"))  # a row a policy


def blocks(spark, sf, golds=True):
    """The statistics blocks of a report, a line a row: block, place, text. Bounds always, and whether abstentions could turn
    the ranking; prediction-powered means where golds are given, with a line for each policy that has too few of them."""
    two = lambda c: F.format_string("%.2f", F.col(c) + 1e-9)
    by = Window.partitionBy(F.lit(0)).orderBy("policy")  # a row a policy
    b = bounds(verdicts(spark, sf))
    out = b.select(F.lit("abstention").alias("block"), F.row_number().over(by).alias("place"), F.concat("policy", F.lit(" pass rate in ["), two("low"), F.lit(", "), two("high"), F.lit("]")).alias("text"))
    undetermined = pairs(b).agg(F.count_if(F.col("relation") == "undetermined").alias("n"))
    text = F.when(F.col("n") == 0, "ranking holds whatever the abstentions are").otherwise(F.concat(F.lit("ranking depends on abstentions: "), F.col("n").cast("string"), F.lit(" pairs undetermined")))
    out = out.unionByName(undetermined.select(F.lit("abstention").alias("block"), F.lit(1_000_000).alias("place"), text.alias("text")))
    if golds:
        text = F.when(F.col("status") == "ok", F.concat("policy", F.lit(" success "), two("theta"), F.lit(" +- "), two("half_width"))).otherwise(
            F.concat("policy", F.lit(" skipped: two golds and two others are needed, there are "), F.col("n").cast("string"), F.lit(" and "), F.col("m").cast("string")))
        out = out.unionByName(ppi(spark, sf).select(F.lit("golds").alias("block"), F.row_number().over(by).alias("place"), text.alias("text")))
    return out


def rank_lines(spark, sf):
    """The block of rank intervals, by mean descending; none for fewer than two policies."""
    r = rank_intervals(spark, sf)
    text = F.format_string("%s mean=%.3f rank in [%.0f, %.0f]", "policy", "mean", "low", "high")
    return r.select(F.lit("ranks").alias("block"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), "policy")).alias("place"), text.alias("text"))  # a row a policy


QUERIES = {
    "a2_channel_means": channel_means,
    "a3_verdict_counts": lambda s, d: verdicts(s, d).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "fail", "abstain")]),
    "o1_leaderboard_order": ordered,
    "o7_mean_order": mean_order,
    "st8_stats_blocks": blocks,
    "a18_composed_score": worst_signal,
    "j5_gold_split": lambda s, d: verdicts(s, d).join(D.golds(s, d), "rollout_id", "left").groupBy("policy").agg(F.count_if(F.col("success").isNotNull()).alias("labelled"), F.count_if(F.col("success").isNull()).alias("unlabelled")),
    "j4_caps_join": lambda s, d: scores(s, d).filter("status = 'ok'").groupBy("policy", "channel", "eligible").agg(F.avg("value").alias("mean")),
    "u7_tagged_union": tagged,
}

_CH = f"WITH {_C1}, {_PROG}, ch AS (SELECT policy, 'success.predicates' AS channel, value FROM s WHERE status = 'ok' UNION ALL SELECT policy, 'progress.goal_distance', pg.value FROM pg JOIN s USING (rollout_id) WHERE pg.status = 'ok'), mn AS (SELECT policy, channel, avg(value) AS mean, count(*) AS n FROM ch GROUP BY ALL)"

ORACLES = {
    "a2_channel_means": ("mean", f"{_CH} SELECT * FROM mn"),
    "a3_verdict_counts": ("", f"{_V} SELECT count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'fail') AS fail, count(*) FILTER (verdict = 'abstain') AS abstain FROM v"),
    "o1_leaderboard_order": ("", f"{_V}, l AS (SELECT policy, count(*) AS n, count(*) FILTER (verdict = 'abstain') AS ab, count(*) FILTER (verdict = 'pass')::DOUBLE / nullif(count(*) FILTER (verdict <> 'abstain'), 0) AS pr FROM v GROUP BY 1) SELECT policy, (row_number() OVER (ORDER BY coalesce(pr, -1) DESC, ab::DOUBLE / greatest(n, 1), policy))::INT AS place FROM l"),
    "o7_mean_order": ("mean", f"WITH {_C1} SELECT policy, avg(value) AS mean, (row_number() OVER (ORDER BY avg(value) DESC, policy))::INT AS place FROM s WHERE status = 'ok' GROUP BY 1"),
    "st8_stats_blocks": ("", f"""{_V}, o AS (SELECT count(*) AS n FROM b x JOIN b y ON x.policy < y.policy WHERE NOT (x.low > y.high) AND NOT (y.low > x.high)), pp AS ({_PPI})
SELECT 'abstention' AS block, (row_number() OVER (ORDER BY policy))::INT AS place, policy || ' pass rate in [' || printf('%.2f', low + 1e-9) || ', ' || printf('%.2f', high + 1e-9) || ']' AS text FROM b
UNION ALL SELECT 'abstention', 1000000, CASE WHEN n = 0 THEN 'ranking holds whatever the abstentions are' ELSE 'ranking depends on abstentions: ' || n || ' pairs undetermined' END FROM o
UNION ALL SELECT 'golds', (row_number() OVER (ORDER BY policy))::INT, CASE WHEN status = 'ok' THEN policy || ' success ' || printf('%.2f', theta + 1e-9) || ' +- ' || printf('%.2f', half_width + 1e-9)
 ELSE policy || ' skipped: two golds and two others are needed, there are ' || n || ' and ' || m END FROM pp"""),
    "a18_composed_score": ("score", f"WITH {_SIG} SELECT rollout_id, min(coalesce(value, 0)) AS score FROM sig GROUP BY 1"),
    "j5_gold_split": ("", f"{_V} SELECT policy, count(*) FILTER (success IS NOT NULL) AS labelled, count(*) FILTER (success IS NULL) AS unlabelled FROM v LEFT JOIN golds USING (rollout_id) GROUP BY 1"),
    "j4_caps_join": ("mean", f"{_CH} SELECT policy, channel, channel = 'success.predicates' AS eligible, mean FROM mn"),
    "u7_tagged_union": ("", f"{_V} SELECT 'demo' || rollout_id AS tag, verdict FROM v UNION ALL SELECT 'neg' || rollout_id || '_frozen', 'fail' FROM v"),
}

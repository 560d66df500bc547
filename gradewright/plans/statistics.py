"""Statistics: missingness bounds, prediction-powered means, conformal thresholds, AUROC, rank correlation, rank intervals."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gradewright.operators.columns import rank_correlation
from gradewright.operators.cumulative import average_ranks, running
from gradewright.sources import domain as D

from .evaluation import _C1, class_means, dot, rollouts, success, verdicts

ALPHA, Z = 0.1, NormalDist().inv_cdf(0.95)


def bounds(v):
    """Worst and best pass rate a policy: an abstention may be either."""
    ok, fail = F.count_if(F.col("verdict") == "pass"), F.count_if(F.col("verdict") == "fail")
    return v.groupBy("policy").agg((ok / F.count("*")).alias("low"), ((F.count("*") - fail) / F.count("*")).alias("high"))


def pairs(b):
    """All pairs of policies in name order (a handful of policies, not rows)."""
    x, y = b.alias("x"), b.alias("y")
    j = x.join(y, F.col("x.policy") < F.col("y.policy"))
    rel = F.when(F.col("x.low") > F.col("y.high"), "first").when(F.col("y.low") > F.col("x.high"), "second").otherwise("undetermined")
    return j.select(F.col("x.policy").alias("a"), F.col("y.policy").alias("b"), rel.alias("relation"))


def auroc(df):
    """P(healthy > broken) + half of ties, from running counts over distinct values: no pair of rows is formed."""
    d = df.groupBy("value").agg(F.count_if(~F.col("broken")).alias("h"), F.count_if(F.col("broken")).alias("b"))
    d = running(d, "value", ["b"]).withColumn("u", F.col("h") * (F.col("b_before") + F.col("b") / 2.0))
    return d.agg((F.sum("u") / (F.sum("h") * F.sum("b"))).alias("auroc"), F.sum("h").alias("healthy"), F.sum("b").alias("broken"))


NO_BROKEN, UNATTAINABLE, NOTHING = "refused: no broken example", "refused: alpha unattainable", "admits nothing"


def conformal(df, alpha=ALPHA, keys=()):
    """The least threshold whose risk bound n/(n+1) * share of broken at or above + 1/(n+1) is within alpha, one row a key.

    status tells refusals (no broken example; too few for alpha) from a threshold above all values, which admits nothing.
    risk is the share of broken examples that is admitted, retention that of the others. Values must be finite.
    """
    d = df.groupBy(*keys, "value").agg(F.count_if(F.col("broken")).alias("b"), F.count_if(~F.col("broken")).alias("c"))
    d = running(d, "value", ["b", "c"], keys)
    n = F.col("b_all")
    above = n - F.col("b_before")
    ok = (n > 0) & ((above + 1) / (n + 1) <= alpha)
    g = d.groupBy(*keys).agg(F.max("b_all").alias("n_broken"), F.max("c_all").alias("n_clean"), F.min(F.when(ok, F.col("value"))).alias("lam"), F.max(F.when(ok, above)).alias("admitted"),
                             F.max(F.when(ok, F.col("c_all") - F.col("c_before"))).alias("kept"), F.max("value").alias("top"))
    n = F.col("n_broken")
    floor = 1 / (n + 1)
    status = F.when(n == 0, NO_BROKEN).when(floor > alpha, UNATTAINABLE).when(F.col("lam").isNull(), NOTHING).otherwise("ok")
    some, none = F.col("status") == "ok", F.col("status") == NOTHING
    return g.withColumn("status", status).select(
        *keys, "status", F.when(some, F.col("lam")).when(none, next_up(F.col("top"))).alias("threshold"), F.when(some, F.try_divide(F.col("admitted").cast("double"), n.cast("double"))).when(none, 0.0).alias("risk"),
        F.when(some, (F.col("admitted") + 1) / (n + 1)).when(none, floor).alias("bound"), F.when(some, F.try_divide(F.col("kept").cast("double"), F.col("n_clean").cast("double"))).when(none, 0.0).alias("retention"),
        F.col("n_broken").cast("long").alias("n_broken"), F.col("n_clean").cast("long").alias("n_clean"))


def next_up(c):
    """The least double above c. Its rows are results of calibrations, few enough for a Python function."""

    @F.pandas_udf("double")
    def up(x: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(x.astype(float), np.inf), x.index).where(x.notna())

    return up(c)


def calibrations(spark, sf):
    """Labellings of the events that end in a threshold, a refusal, an admission of nothing, and a refusal for too few examples."""
    e = D.table(spark, sf, "events").select("value", "event_type", "event_id")
    e = e.crossJoin(F.broadcast(e.agg(F.max("value").alias("m"))))  # one row
    case = lambda name, broken: F.struct(F.lit(name).alias("labelling"), broken.alias("broken"))
    each = F.array(case("errors", F.col("event_type") == "error"), case("none", F.lit(False)), case("top", F.col("value") >= 0.5 * F.col("m")), case("few", F.col("event_id") == 1))
    return conformal(e.select("value", F.explode(each).alias("l")).select("value", "l.labelling", "l.broken"), ALPHA, ["labelling"])


def ppi(spark, sf, alpha=ALPHA):
    return ppi_of(success(spark, sf).filter("status = 'ok'").join(D.golds(spark, sf), "rollout_id", "left"), alpha)


def ppi_of(s, alpha=ALPHA):
    """s (policy, value, success or null) -> the prediction-powered pass rate a policy: labelled and unlabelled rollouts are
    disjoint, and under two of either is skipped."""
    y, f = F.col("success").cast("int").cast("double"), F.col("value")
    s = s.withColumn("y", y).withColumn("fl", F.when(y.isNotNull(), f)).withColumn("fu", F.when(y.isNull(), f))
    g = s.groupBy("policy").agg(F.count("y").alias("n"), F.count("fu").alias("m"), F.avg("y").alias("ybar"), F.avg("fl").alias("fbar"), F.avg("fu").alias("ubar"),
                                F.var_samp("y").alias("vy"), F.var_samp("fl").alias("vf"), F.var_samp("fu").alias("vu"), F.covar_samp("y", "fl").alias("cov"))
    lam = F.when(F.col("n") < 4, 1.0).when(F.col("vf") <= 1e-12, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide("cov", "vf"))))
    g = g.withColumn("lam", lam)
    ok = (F.col("n") >= 2) & (F.col("m") >= 2)
    theta = F.col("lam") * F.col("ubar") + F.col("ybar") - F.col("lam") * F.col("fbar")
    rect = F.col("vy") - 2 * F.col("lam") * F.col("cov") + F.col("lam") * F.col("lam") * F.col("vf")
    width = F.sqrt(F.greatest(F.lit(0.0), F.col("lam") * F.col("lam") * F.try_divide(F.col("vu"), F.col("m").cast("double")) + F.try_divide(rect, F.col("n").cast("double")))) * F.lit(Z)
    return g.select("policy", "n", "m", F.when(ok, "ok").otherwise("skipped").alias("status"), F.when(ok, theta).alias("theta"), F.when(ok, width).alias("half_width"))


def voc(spark, sf):
    """Spearman correlation of a subject's observed x with its order, average ranks; 0 under three points or for a constant."""
    seen = F.transform(F.filter(F.try_element_at("tracks", F.lit(D.SUBJECT)), lambda p: p["x"].isNotNull()), lambda p: p["x"])
    d = rollouts(spark, sf).select("rollout_id", seen.alias("x")).filter("size(x) > 0")
    return d.select("rollout_id", rank_correlation(F.col("x"), F.transform("x", lambda _, i: i.cast("double"))).alias("voc"))


def loo(spark, sf):
    """Leave-one-out margins: mean dot with the own class without oneself, less that with the other. The two class means are
    one row, so a vector meets them where it lies."""
    e = D.table(spark, sf, "embeddings").select("vec_id", (F.col("label") < 5).alias("good"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = e.agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    j = e.crossJoin(F.broadcast(class_means(e, "v", good_mean=F.col("good"), bad_mean=~F.col("good")))).crossJoin(F.broadcast(n))
    own, other = F.when(F.col("good"), F.col("good_mean")).otherwise(F.col("bad_mean")), F.when(F.col("good"), F.col("bad_mean")).otherwise(F.col("good_mean"))
    size = F.when(F.col("good"), F.col("n_good")).otherwise(F.col("n_bad"))
    d = (dot("v", own) * size - dot("v", "v")) / (size - 1) - dot("v", other)
    return j.select("vec_id", "good", F.when(F.col("good"), d).otherwise(-d).alias("margin"))


def loo_summary(spark, sf):
    m = loo(spark, sf)
    a = auroc(m.select(F.round("margin", 9).alias("value"), (~F.col("good")).alias("broken"))).select("auroc")
    acc = m.agg(F.avg(((F.col("margin") > 0) == F.col("good")).cast("double")).alias("accuracy"))
    return a.crossJoin(acc)  # one row by one row


DRAWS, SPREAD = 2000, 0.05


def bootstrap_ranks(scores, draws=DRAWS, alpha=SPREAD, seed=0):
    """scores (policy, value) -> policy, mean, low, high: the interval of each policy's rank over bootstrap draws of its mean,
    ties broken at random draw by draw. Under two policies there is nothing to rank.

    A draw of n scores is a multinomial draw of the counts of their distinct values, so a policy is one row of distinct
    values and counts, however many rollouts it has. Draws depend on the seed and the policy's place by name alone.
    """
    s = scores.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("policy", "value").agg(F.count("*").alias("n"))
    s = s.groupBy("policy").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("d"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("policy", ignore_index=True)
        if len(g) < 2:
            return g.iloc[:0][["policy"]].assign(mean=0.0, low=0.0, high=0.0)
        means, own = np.empty((draws, len(g))), np.empty(len(g))
        for i, d in enumerate(g["d"]):
            values, n = np.array([x["value"] for x in d], float), np.array([x["n"] for x in d])
            own[i] = values @ n / n.sum()
            means[:, i] = np.random.default_rng([seed, i]).multinomial(n.sum(), n / n.sum(), draws) @ values / n.sum()
        order = np.lexsort((np.random.default_rng([seed, len(g)]).random(means.shape), -means), axis=1)
        rank = np.argsort(order, axis=1) + 1
        low, high = np.percentile(rank, [100 * alpha / 2, 100 * (1 - alpha / 2)], axis=0)
        return pd.DataFrame({"policy": g["policy"], "mean": own, "low": low, "high": high})

    return s.withColumn("one", F.lit("all")).groupBy("one").applyInPandas(lambda g: run(g), "policy string, mean double, low double, high double")  # a row a policy


def rank_intervals(spark, sf):
    return bootstrap_ranks(success(spark, sf).filter("status = 'ok'").select("policy", "value"))


QUERIES = {
    "a4_mnar_bounds": lambda s, d: bounds(verdicts(s, d)),
    "st3_j6_mnar_pairs": lambda s, d: pairs(bounds(verdicts(s, d))),
    "st1_conformal": lambda s, d: conformal(D.signal_cal(s, d)),
    "st1_f15_refusals": calibrations,
    "a8_st6_auroc": lambda s, d: auroc(D.signal_cal(s, d)),
    "st2_a5_ppi": ppi,
    "st5_voc": voc,
    "w10_average_ranks": lambda s, d: average_ranks(D.table(s, d, "events").select("event_id", "event_type", F.col("user_id").alias("v")), "v", ["event_type"]).select("event_id", "rank"),
    "o4_distinct_desc": lambda s, d: D.signal_cal(s, d).select("value").distinct().orderBy(F.desc("value")),
    "j11_loo_margins": loo,
    "st7_loo_auroc": loo_summary,
    "st4_w16_rank_intervals": rank_intervals,
}

_V = f"WITH {_C1}, v AS (SELECT rollout_id, policy, CASE WHEN status <> 'ok' THEN 'abstain' WHEN value >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict FROM s), b AS (SELECT policy, count(*) FILTER (verdict = 'pass')::DOUBLE / count(*) AS low, count(*) FILTER (verdict <> 'fail')::DOUBLE / count(*) AS high FROM v GROUP BY 1)"
_LOO = """e AS (SELECT vec_id, label < 5 AS good, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) u(i)), c AS (SELECT good, i, sum(v) AS s, count(*) AS n FROM e GROUP BY ALL),
lo AS (SELECT e.vec_id, e.good, sum(v * ((o.s - v) / (o.n - 1) - t.s / t.n)) * CASE WHEN e.good THEN 1 ELSE -1 END AS margin FROM e JOIN c o ON o.good = e.good AND o.i = e.i JOIN c t ON t.good <> e.good AND t.i = e.i GROUP BY e.vec_id, e.good)"""
_AUC = "(SELECT (sum(r) FILTER (NOT broken) - count(*) FILTER (NOT broken) * (count(*) FILTER (NOT broken) + 1) / 2.0) / (count(*) FILTER (NOT broken) * count(*) FILTER (broken)::DOUBLE) AS auroc, count(*) FILTER (NOT broken) AS healthy, count(*) FILTER (broken) AS broken FROM (SELECT broken, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM {0}))"

_PPI = f"""WITH {_C1}, z AS (SELECT policy, success::INT::DOUBLE AS y, CASE WHEN success IS NOT NULL THEN value END AS fl, CASE WHEN success IS NULL THEN value END AS fu FROM s LEFT JOIN golds USING (rollout_id) WHERE status = 'ok'),
g AS (SELECT policy, count(y) AS n, count(fu) AS m, avg(y) AS yb, avg(fl) AS fb, avg(fu) AS ub, CASE WHEN count(y) > 1 THEN var_samp(y) END AS vy, CASE WHEN count(fl) > 1 THEN var_samp(fl) END AS vf, CASE WHEN count(fu) > 1 THEN var_samp(fu) END AS vu, CASE WHEN count(y) > 1 THEN covar_samp(y, fl) END AS cov FROM z GROUP BY 1),
l AS (SELECT *, CASE WHEN n < 4 THEN 1 WHEN vf <= 1e-12 THEN 0 ELSE least(1, greatest(0, cov / vf)) END AS lam FROM g)
SELECT policy, n, m, CASE WHEN n >= 2 AND m >= 2 THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN n >= 2 AND m >= 2 THEN lam * ub + yb - lam * fb END AS theta,
  CASE WHEN n >= 2 AND m >= 2 THEN sqrt(greatest(0, lam * lam * vu / m + (vy - 2 * lam * cov + lam * lam * vf) / n)) * {Z!r} END AS half_width FROM l"""
_CAL = f"""d AS (SELECT labelling, value, count(*) FILTER (broken) AS b, count(*) FILTER (NOT broken) AS c FROM lab GROUP BY ALL),
k AS (SELECT labelling, value, sum(b) OVER w AS above, sum(c) OVER w AS kept, sum(b) OVER p AS n, sum(c) OVER p AS nc FROM d WINDOW w AS (PARTITION BY labelling ORDER BY value DESC), p AS (PARTITION BY labelling)),
z AS (SELECT labelling, max(n) AS n, max(nc) AS nc, max(value) AS top, min(value) FILTER (n > 0 AND (above + 1)::DOUBLE / (n + 1) <= {ALPHA}) AS lam, max(above) FILTER (n > 0 AND (above + 1)::DOUBLE / (n + 1) <= {ALPHA}) AS ad, max(kept) FILTER (n > 0 AND (above + 1)::DOUBLE / (n + 1) <= {ALPHA}) AS kp FROM k GROUP BY 1),
y AS (SELECT *, CASE WHEN n = 0 THEN '{NO_BROKEN}' WHEN 1.0 / (n + 1) > {ALPHA} THEN '{UNATTAINABLE}' WHEN lam IS NULL THEN '{NOTHING}' ELSE 'ok' END AS status FROM z),
cal AS (SELECT labelling, status, CASE status WHEN 'ok' THEN lam WHEN '{NOTHING}' THEN nextafter(top, 'inf'::DOUBLE) END AS threshold, CASE status WHEN 'ok' THEN ad / n::DOUBLE WHEN '{NOTHING}' THEN 0 END AS risk,
  CASE status WHEN 'ok' THEN (ad + 1) / (n + 1)::DOUBLE WHEN '{NOTHING}' THEN 1 / (n + 1)::DOUBLE END AS bound, CASE status WHEN 'ok' THEN kp / nullif(nc, 0)::DOUBLE WHEN '{NOTHING}' THEN 0 END AS retention, n::BIGINT AS n_broken, nc::BIGINT AS n_clean FROM y)"""

ORACLES = {
    "a4_mnar_bounds": ("low high", f"{_V} SELECT * FROM b"),
    "st3_j6_mnar_pairs": ("", f"{_V} SELECT x.policy AS a, y.policy AS b, CASE WHEN x.low > y.high THEN 'first' WHEN y.low > x.high THEN 'second' ELSE 'undetermined' END AS relation FROM b x JOIN b y ON x.policy < y.policy"),
    "st1_conformal": ("threshold risk bound retention", f"""WITH lab AS (SELECT 'all' AS labelling, value, broken FROM signal_cal), {_CAL} SELECT * EXCLUDE (labelling) FROM cal"""),
    "st1_f15_refusals": ("threshold risk bound retention", f"""WITH e AS (SELECT value, event_type, event_id, max(value) OVER () AS m FROM events), lab AS (SELECT 'errors' AS labelling, value, event_type = 'error' AS broken FROM e UNION ALL SELECT 'none', value, false FROM e
 UNION ALL SELECT 'top', value, value >= 0.5 * m FROM e UNION ALL SELECT 'few', value, event_id = 1 FROM e), {_CAL} SELECT * FROM cal"""),
    "a8_st6_auroc": ("auroc", f"SELECT * FROM {_AUC.format('signal_cal')}"),
    "st2_a5_ppi": ("theta half_width", _PPI),
    "st5_voc": ("voc", """WITH t AS (SELECT rollout_id, t, x, rank() OVER (PARTITION BY rollout_id ORDER BY x) + (count(*) OVER (PARTITION BY rollout_id, x) - 1) / 2.0 AS rx, row_number() OVER (PARTITION BY rollout_id ORDER BY t) AS rt FROM tracks WHERE role = 'click' AND x IS NOT NULL)
SELECT rollout_id, CASE WHEN count(*) >= 3 AND max(x) > min(x) THEN corr(rx, rt) ELSE 0 END AS voc FROM t GROUP BY 1"""),
    "w10_average_ranks": ("rank", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS rank FROM events"),
    "o4_distinct_desc": ("value", "SELECT DISTINCT value FROM signal_cal"),
    "j11_loo_margins": ("margin", f"WITH {_LOO} SELECT * FROM lo"),
    "st7_loo_auroc": ("auroc accuracy", f"WITH {_LOO}, q AS (SELECT round(margin, 9) AS value, NOT good AS broken FROM lo) SELECT auroc, accuracy FROM {_AUC.format('q')} CROSS JOIN (SELECT avg(((margin > 0) = good)::INT::DOUBLE) AS accuracy FROM lo)"),
}

"""Small exact cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewright.operators import predicates as P
from gradewright.operators import cumulative, dtw, replies
from gradewright.operators import episode as E
from gradewright.operators.columns import rank_correlation
from gradewright.plans import statistics


def frames(spark, rows):
    """rows: (t, sx, sy, sv, ox, oy)"""
    return spark.createDataFrame([(1, *r) for r in rows], "rollout_id long, t int, sx double, sy double, sv double, ox double, oy double")


def result(df, kind, params=None, region=None):
    r = P.evaluate(kind, params)
    return P.measure(df, ["rollout_id"], region).select(r["status"], r["holds"], r["margin"]).first()


def test_stationary(spark):
    calm = frames(spark, [(0, 5.0, 5.0, 1.0, None, None), (1, 5.2, 5.0, 1.0, None, None), (2, 5.1, 5.1, 1.0, None, None)])
    fast = frames(spark, [(0, 0.0, 0.0, 1.0, None, None), (1, 4.0, 0.0, 1.0, None, None), (2, 8.0, 0.0, 1.0, None, None)])
    assert result(calm, "stationary", {"tol": 1.0})[1] and not result(fast, "stationary", {"tol": 1.0})[1]
    one = frames(spark, [(0, 1.0, 1.0, 1.0, None, None)])
    assert tuple(result(one, "stationary")) == ("ok", True, 1.5)


def test_missing_beats_false(spark):
    gap = frames(spark, [(0, 5.0, 5.0, 1.0, 5.0, 5.0), (1, None, None, 0.0, 5.0, 5.0)])
    assert tuple(result(gap, "co_located")) == (P.MISSING, False, 0.0)
    m = P.measure(gap, ["rollout_id"])
    c = P.conjunction([P.evaluate("present"), P.evaluate("stationary")])
    assert m.select(c["status"], c["value"]).first() == (P.MISSING, None)


def test_approaching_and_contained(spark):
    near = frames(spark, [(i, 2.0 * i, 0.0, 1.0, 10.0, 0.0) for i in range(5)])
    away = frames(spark, [(i, 8 - 2.0 * i, 0.0, 1.0, 10.0, 0.0) for i in range(5)])
    assert result(near, "approaching")[1] and not result(away, "approaching")[1]
    assert result(near.filter("t < 2"), "approaching")[0] == P.MISSING
    region = spark.createDataFrame([(1, 10, 10, 40, 40, 900)], "rollout_id long, x0 int, y0 int, x1 int, y1 int, area int")
    inside, edge = frames(spark, [(0, 25.0, 25.0, 1.0, None, None)]), frames(spark, [(0, 12.0, 12.0, 1.0, None, None)])
    assert result(inside, "contained", None, region)[1] and not result(edge, "contained", None, region)[1]


def test_unknown_kind():
    with pytest.raises(P.SpecError):
        P.evaluate("flies")


@pytest.mark.parametrize(("values", "want"), [((None, 0.8), "pass"), ((1.0, 0.1), "abstain"), ((None, None), "abstain"), ((0.2, 0.1), "fail"), ((float("nan"), 0.9), "pass")])
def test_fold(spark, values, want):
    df = spark.createDataFrame([values], "a double, b double")
    channels = F.array(*[E.score("success.predicates", F.col(c).isNotNull(), F.col(c), F.lit(1.0), F.lit("")) for c in ("a", "b")])
    assert df.select(E.fold(channels)["verdict"]).first()[0] == want


def test_auroc_and_conformal(spark):
    one = lambda rows: statistics.auroc(spark.createDataFrame(rows, "value double, broken boolean")).first().auroc
    assert one([(1.0, False), (0.9, False), (0.1, True), (0.2, True)]) == 1
    assert one([(0.5, False), (0.5, True)]) == 0.5
    assert one([(0.4, False), (0.8, False), (0.6, True)]) == 0.5
    two = spark.createDataFrame([(0.1, True), (0.2, True), (0.9, False)], "value double, broken boolean")
    assert statistics.conformal(two, 0.05).first().status == statistics.UNATTAINABLE
    assert statistics.conformal(two.filter("not broken"), 0.05).first().status == statistics.NO_BROKEN
    top = statistics.conformal(two.selectExpr("-value as value", "broken"), 0.4).first()
    assert (top.status, top.threshold > -0.1, top.threshold - -0.1 < 1e-12, top.risk, top.retention) == (statistics.NOTHING, True, True, 0.0, 0.0)
    fine = statistics.conformal(two, 0.4).first()
    assert (fine.status, fine.threshold, fine.bound, fine.n_broken, fine.n_clean, fine.retention) == ("ok", 0.9, pytest.approx(1 / 3), 2, 1, 1.0)


def test_mnar(spark):
    rows = [("good", v) for v in ["pass"] * 8 + ["fail", "abstain"]] + [("shy", v) for v in ["pass"] * 2 + ["abstain"] * 8]
    b = {r.policy: (r.low, r.high) for r in statistics.bounds(spark.createDataFrame(rows, "policy string, verdict string")).collect()}
    assert b == {"good": (0.8, 0.9), "shy": (0.2, 1.0)}


def test_dtw(spark):
    line, off = [(0.0, 0.0), (1.0, 0.0)], [(0.0, 1.0)]
    assert dtw.cost(np.array(line), np.array(line)) == 0
    assert dtw.cost(np.array(line), np.array(off)) == pytest.approx((1 + 2**0.5) / 3)
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 7), (6, 2), (20, 33)):
        a, b = rng.random((n, 2)), rng.random((m, 2))
        acc = np.full((n + 1, m + 1), np.inf)
        acc[0, 0] = 0
        for i in range(n):
            for j in range(m):
                acc[i + 1, j + 1] = np.hypot(*(a[i] - b[j])) + min(acc[i, j], acc[i, j + 1], acc[i + 1, j])
        assert dtw.cost(a, b) == pytest.approx(acc[n, m] / (n + m))
    rows = [(1, [(5.0, 5.0), (None, None), (7.0, 5.0)]), (2, [(1.0, 1.0)]), (3, None)]
    t = spark.createDataFrame(rows, "rollout_id long, points array<struct<x:double,y:double>>")
    got = {r.rollout_id: r.score for r in dtw.demo_scores(t, [line]).collect()}
    assert got[1].value == 1.0 and got[1].confidence == pytest.approx(2 / 3) and got[2].reason == "too few observed points" and got[3].status == "evidence_missing"
    assert dtw.demo_scores(t, []).first().score.reason == "no demo tracks"


def one(spark, column, **cells):
    return spark.range(1).select(*[c.alias(n) for n, c in cells.items()]).select(column).first()[0]


def numbers(*v):
    return F.array(*[F.lit(x).cast("double") for x in v])


@pytest.mark.parametrize(("text", "n", "want"), [
    ("1 = 45\n2 - 80%", 2, [0.45, 0.8]), ("Frame 1: 250%", 1, [1.0]), ("frame 2: 10%\nframe 3: 40%\nFRAME 4: 70%\nframe 5: 90%", 4, [0.1, 0.4, 0.7, 0.9]), ("0: 5\n1: 10\n2: 15", 3, [0.05, 0.1, 0.15]),
    ("about 20% then 30 %, at last 999%", 2, [0.2, 0.3]), ("nothing", 2, [None, None]), ("1: 10 1: 90", 1, [0.1]), ("99999999999: 10", 1, [None]), ("", 1, [None])])
def test_replies(spark, text, n, want):
    assert one(spark, replies.parse(F.lit(text), F.lit(n))) == want


def test_value_order(spark):
    order = numbers(0, 1, 2, 3)
    got = [one(spark, rank_correlation(numbers(*v), order)) for v in ((0, 0, 0, 1), (1, 0, 0, 0), (2, 2, 2, 2))]
    assert got == [pytest.approx(0.7746, abs=1e-4), pytest.approx(-0.7746, abs=1e-4), 0.0]
    assert one(spark, rank_correlation(numbers(1, 2), numbers(0, 1))) == 0.0


@pytest.mark.parametrize(("q", "k", "want"), [((0.5, 0.5), 1, 0.75), ((0.5, 0.5), 2, 0.25), ((0.5, 0.5, 0.5), 2, 0.375), ((1, 1, 1, 0), 3, 1.0), ((0.5, 0.5, 0.5), 4, 0.0), ((0.3, 0.9, 0.2, 0.8, 0.6), 3, None)])
def test_chain(spark, q, k, want):
    if want is None:  # all outcomes, one by one
        want = sum(np.prod([p if b else 1 - p for p, b in zip(q, bits)]) for bits in itertools.product((0, 1), repeat=len(q)) if "1" * k in "".join(map(str, bits)))
    assert one(spark, E.chain_probability(numbers(*q), k)) == pytest.approx(want)


def test_running_counts(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=500) * np.exp(rng.normal(size=500) * 3), 2)
    v[:20] = 0.0
    d = spark.createDataFrame([(("a", "b")[i % 2], float(x)) for i, x in enumerate(v)], "k string, v double")
    got = {r.k: r for r in cumulative.percentiles(d, "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}, ["k"]).collect()}
    for j, k in enumerate("ab"):
        assert [got[k].p0, got[k].p50, got[k].p99, got[k].p100] == pytest.approx(list(np.percentile(v[j::2], [0, 50, 99, 100])))
    ranks = cumulative.average_ranks(d.filter("k = 'a'"), "v").collect()
    a = v[0::2]
    assert len(ranks) == len(a) and all(r["rank"] == (a < r.v).sum() + ((a == r.v).sum() + 1) / 2 for r in ranks)


def test_rank_intervals(spark):
    rows = [("top", 1.0)] * 20 + [("x", 0.0)] * 8 + [("y", 0.0)] * 8
    d = spark.createDataFrame(rows, "policy string, value double")
    got = {r.policy: (r.mean, r.low, r.high) for r in statistics.bootstrap_ranks(d).collect()}
    assert got == {"top": (1.0, 1.0, 1.0), "x": (0.0, 2.0, 3.0), "y": (0.0, 2.0, 3.0)}
    assert statistics.bootstrap_ranks(d.filter("policy = 'x'")).count() == 0
    mixed = spark.createDataFrame([("a", x) for x in (0.1, 0.9, 0.5, 0.4)] + [("b", x) for x in (0.2, 0.3, 0.6)], "policy string, value double")
    low = {r.policy: (r.low, r.high) for r in statistics.bootstrap_ranks(mixed).collect()}
    assert low == {"a": (1.0, 2.0), "b": (1.0, 2.0)}

"""Reports from cards: cards as JSON, the leaderboard as Markdown, and one HTML page. Nothing is graded again."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.errors import SpecError
from gradewright.operators import episode as E
from gradewright.plans.evaluation import board
from gradewright.plans.statistics import bootstrap_ranks, bounds, pairs, ppi_of
from gradewright.sources import files

#: Cards that one page holds; of more, `files.report_rows` writes the rows where they lie.
PAGE_CARDS = 5_000
NOTES = ("the pass rate counts graded rollouts alone and is no calibrated success rate", "abstentions are no accident: compare them before trusting an order")
STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 8px;text-align:left}"


def write_cards(cards: DataFrame, path: str) -> None:
    """One JSON object a card, a line each, with the name of the file that a card would have by itself."""
    name = F.concat(F.regexp_replace("rollout_id", "[^A-Za-z0-9._-]+", "_"), F.lit(".json"))
    cards.withColumn("file", name).withColumn("schema_version", F.lit(1)).write.json(path)


def channel_means(cards: DataFrame) -> DataFrame:
    """policy, means: the channels' mean values over cards where they are ok, as text in the order of their names."""
    c = cards.select(F.when(F.trim("policy") == "", "<unknown>").otherwise(F.col("policy")).alias("policy"), F.explode("channels").alias("c")).filter("c.status = 'ok'")
    m = c.groupBy("policy", "c.channel").agg(F.avg("c.value").alias("m"))
    return m.groupBy("policy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel", "m"))), lambda x: F.format_string("%s=%.3f", x["channel"], x["m"])), ", ").alias("means"))


def ranked(cards: DataFrame) -> list:
    """The leaderboard's rows in order: pass rate descending (none last), share of abstentions, name."""
    b = board(cards).join(channel_means(cards), "policy", "left")
    rows = b.collect()  # a row a policy
    return sorted(rows, key=lambda r: (-(r.pass_rate if r.pass_rate is not None else -1.0), r.abstained / max(r.n, 1), r.policy))


def blocks(cards: DataFrame, golds: DataFrame | None = None) -> dict[str, list[str]]:
    """Statistics by title: bounds over abstentions, rank intervals for two policies or more, and prediction-powered means
    where golds (rollout_id, success) are given; a policy with too few of them says so."""
    d = cards.select("rollout_id", F.when(F.trim("policy") == "", "<unknown>").otherwise(F.col("policy")).alias("policy"), F.col("success.verdict").alias("verdict"), E.first_channel(F.col("channels"), "success.predicates").alias("c"))
    b = bounds(d)
    lines = [f"{r.policy}: pass rate in [{r.low:.2f}, {r.high:.2f}]" for r in b.orderBy("policy").collect()]
    loose = [f"{r.a}-{r.b}" for r in pairs(b).filter("relation = 'undetermined'").orderBy("a", "b").collect()]
    out = {"Abstentions": [*lines, f"ranking depends on them: {', '.join(loose)}" if loose else "ranking holds whatever they are"]}
    scored = d.filter("c.status = 'ok' and c.value is not null").select("rollout_id", "policy", "c.value")
    ranks = bootstrap_ranks(scored.select("policy", "value")).collect()
    if ranks:
        out["Ranks"] = [f"{r.policy}: mean {r['mean']:.3f}, rank in [{r.low:.0f}, {r.high:.0f}]" for r in sorted(ranks, key=lambda r: (-r["mean"], r.policy))]
    if golds is not None and not golds.isEmpty():
        found = ppi_of(scored.join(golds.select("rollout_id", "success"), "rollout_id", "left")).orderBy("policy").collect()
        out["Golds"] = [f"{r.policy}: success {r.theta:.3f} +- {r.half_width:.3f} of {r.n} golds" if r.status == "ok" else f"{r.policy}: skipped, two golds and two others are needed ({r.n} and {r.m})" for r in found]
    return out


def markdown(cards: DataFrame, golds: DataFrame | None = None) -> str:
    spec = cards.select("spec_name", "spec_hash").first()
    if spec is None:
        raise SpecError("there are no cards to report")
    lines = [f"# Leaderboard: {spec.spec_name}", "", f"specification `{spec.spec_hash[:12]}`", "", "| policy | rollouts | graded | abstained | pass rate | channel means |", "|-|-|-|-|-|-|"]
    for r in ranked(cards):
        lines.append(f"| {r.policy} | {r.n} | {r.graded} | {r.abstained} | {'-' if r.pass_rate is None else f'{r.pass_rate:.2f}'} | {r.means or '-'} |")
    lines += ["", *(f"> {n}" for n in NOTES)]
    for title, text in blocks(cards, golds).items():
        lines += ["", f"## {title}", *(f"- {t}" for t in text)]
    return "\n".join(lines) + "\n"


def page(cards: DataFrame, golds: DataFrame | None = None, series: DataFrame | None = None) -> str:
    """One HTML page; series: rollout_id, progress (an array) for the cards' lines. Its cards are built where they lie and
    PAGE_CARDS at most."""
    n = cards.count()
    if n > PAGE_CARDS:
        raise SpecError(f"{n} cards on one page; at most {PAGE_CARDS}: write files.report_rows instead")
    reasons = F.array_join(F.concat("success.reasons", "gate.reasons"), "; ")
    d = cards.select("rollout_id", "policy", F.col("success.verdict").alias("verdict"), reasons.alias("reason"))
    d = d.join(series.select("rollout_id", "progress"), "rollout_id", "left") if series is not None else d.withColumn("progress", F.lit(None).cast("array<double>"))
    rows = [r.value for r in files.report_rows(d.orderBy("policy", "rollout_id")).collect()]
    cell = lambda *v: "".join(f"<td>{html.escape(str(x))}</td>" for x in v)
    top = "".join(f"<tr>{cell(r.policy, r.n, r.graded, r.abstained, '-' if r.pass_rate is None else f'{r.pass_rate:.2f}', r.means or '-')}</tr>" for r in ranked(cards))
    heads = lambda *v: "<tr>" + "".join(f"<th>{x}</th>" for x in v) + "</tr>"
    stats = "".join(f"<h2>{html.escape(t)}</h2><pre>{html.escape(chr(10).join(x))}</pre>" for t, x in blocks(cards, golds).items())
    return (f"<!doctype html><html><head><meta charset='utf-8'><title>Leaderboard</title><style>{STYLE}</style></head><body><h1>Leaderboard</h1>{''.join(f'<p>{html.escape(n)}</p>' for n in NOTES)}"
            f"<table>{heads('policy', 'rollouts', 'graded', 'abstained', 'pass rate', 'channel means')}{top}</table>{stats}<h2>Cards</h2><table>{heads('rollout', 'policy', 'verdict', 'progress', 'reasons')}{''.join(rows)}</table></body></html>")

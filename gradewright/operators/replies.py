"""Progress replies of a vision-language judge: parsing messy text, putting shuffled frames back in order, and the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.operators.columns import let, mean, rank_correlation, steps_to, total
from gradewright.operators.episode import score

#: A numbered percentage and a bare one. The same in Java's and RE2's dialects.
NUMBERED, BARE = r"(?i)(?:frame\s*)?(\d+)\s*[:=\-]\s*(\d{1,3})\s*%?", r"\b(\d{1,3})\s*%"
#: Where a model may begin to count, in the order of preference.
OFFSETS = (1, 0, 2)
#: Least frames of a rollout, values at the end that are averaged, agreement where it can't be told.
LEAST_FRAMES, LAST, UNKNOWN = 4, 3, 0.5


def _share(percent: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), percent.cast("int"))) / 100.0


def parse(reply: Column, n: Column) -> Column:
    """An array of n values in [0, 1] or null, one a frame in the order shown.

    Of the offsets, the one that fills most frames counts for the whole reply; the first value of a frame wins. Where no
    numbered percentage falls on a frame, bare ones are taken in their order.
    """
    index, value = F.regexp_extract_all(reply, F.lit(NUMBERED), F.lit(1)), F.regexp_extract_all(reply, F.lit(NUMBERED), F.lit(2))
    pairs = F.filter(F.transform(F.arrays_zip(index.alias("i"), value.alias("v")), lambda p: F.struct(p["i"].try_cast("int").alias("i"), _share(p["v"]).alias("v"))), lambda p: p["i"].isNotNull())
    bare = F.transform(F.regexp_extract_all(reply, F.lit(BARE), F.lit(1)), _share)

    def filled(p: Column) -> Column:
        def counted_from(first: int) -> Column:
            return F.struct(steps_to(n, lambda k: F.get(F.filter(p, lambda x: x["i"] == k + first), F.lit(0))["v"]).alias("a"))

        return let(F.array(*map(counted_from, OFFSETS)), chosen)

    def chosen(t: Column) -> Column:
        hits = [F.size(F.filter(F.get(t, F.lit(i))["a"], lambda x: x.isNotNull())) for i in range(len(OFFSETS))]
        best = F.greatest(*hits)
        out = F.when(best == 0, steps_to(n, lambda k: F.get(bare, k)))
        for i, h in enumerate(hits):
            out = out.when(h == best, F.get(t, F.lit(i))["a"])
        return out

    return let(pairs, filled)


def unshuffled(values: Column, order: Column) -> Column:
    """values by place shown, order the frame shown at each place -> values by frame."""
    return F.transform(values, lambda _, k: F.get(values, F.array_position(order, k.cast("int")).cast("int") - 1))


def progress(replies: DataFrame, keys: list[str]) -> DataFrame:
    """replies (keys, run, reply, shown array<int>: the frame at each place; frames: of the rollout) -> keys, score of
    progress.gvl, series: the means by frame.

    A frame's value is the mean over the runs that answered it. Enough is answered with max(3, n) values over all runs.
    Agreement is 1 - 2 * the mean difference of two runs on frames that every run answered, for three such frames or more.
    """
    r = replies.select(*keys, "run", "frames", "shown", parse(F.col("reply"), F.size("shown")).alias("v"))
    r = r.select(*keys, "run", "frames", unshuffled(F.col("v"), F.col("shown")).alias("v"))
    g = r.groupBy(*keys).agg(F.max("frames").alias("frames"), F.transform(F.array_sort(F.collect_list(F.struct("run", "v"))), lambda x: x["v"]).alias("runs"))  # a handful of runs
    n, runs = F.size(F.get("runs", F.lit(0))), F.size("runs")
    at = lambda k: F.filter(F.transform("runs", lambda v: F.get(v, k)), lambda x: x.isNotNull())
    g = g.withColumn("means", steps_to(n, lambda k: let(at(k), mean))).withColumn("answered", total(steps_to(n, lambda k: F.size(at(k)).cast("double"))))
    g = g.withColumn("every", F.filter(steps_to(n, lambda k: F.struct(k.alias("k"), (F.size(at(k)) == runs).alias("all"))), lambda x: x["all"]))
    g = g.withColumn("ok", F.filter(F.transform("means", lambda m, i: F.struct(m.alias("m"), i.cast("double").alias("i"))), lambda x: x["m"].isNotNull()))
    values = F.transform("ok", lambda x: x["m"])
    g = g.withColumn("voc", rank_correlation(values, F.transform("ok", lambda x: x["i"])))
    differ = lambda a, b: mean(F.transform("every", lambda x: F.abs(F.get(F.get("runs", a), x["k"]) - F.get(F.get("runs", b), x["k"]))))
    pairs = F.flatten(steps_to(runs, lambda a: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(runs - 1, F.lit(0))), lambda b: b > a), lambda b: differ(a, b))))
    agreement = F.when((runs > 1) & (F.size("every") >= 3), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - 2 * mean(pairs)))).otherwise(UNKNOWN)
    g = g.withColumn("agreement", agreement)
    enough = F.col("answered") >= F.greatest(F.lit(3), n)
    ok = (F.col("frames") >= LEAST_FRAMES) & enough
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean(F.slice(values, F.greatest(F.size("ok") - LAST + 1, F.lit(1)), F.lit(LAST)))))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.greatest(F.col("voc"), F.lit(0.0)) + F.col("agreement")) / 2))
    why = F.when(F.col("frames") < LEAST_FRAMES, "rollout too short").when(~enough, "most frames have no readable answer").when(F.round("voc", 9) <= 0, "progress does not follow time")
    detail = F.create_map(F.lit("voc"), F.col("voc"), F.lit("reshuffle_agreement"), F.col("agreement"), F.lit("n_frames_scored"), F.size("ok").cast("double"))
    return g.select(*keys, score("progress.gvl", ok, value, sure, why, detail).alias("score"), F.when(ok, values).alias("series"))

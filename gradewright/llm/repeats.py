"""Repeated passages by windows around shared minimisers.

Words are runs of anything but ASCII white space, A-Z lower-cased. A place is kept where the hash of its first GRAM
words is least among WINDOW neighbours (a minimiser), so every passage of PASSAGE words has one inside, at the same
place in every copy. Places whose first GRAM words stand in one document only are dropped. Where the PASSAGE words to
either side of a place (less at the ends of the text) stand in another document as a whole, they are repeated. Of all other
places, and of one such place each, every window of PASSAGE words that holds the GRAM words is looked up by its hash,
however many documents share it. Intervals of one document are united, so long passages come whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_limit, materialize, skew_join
from .exact_dedup import with_uid

PASSAGE, GRAM, WINDOW = 50, 16, 32
#: A window may start at a place or up to so many words before it.
BEFORE = PASSAGE - GRAM
#: Of the window hashes; odd, so it has an inverse mod 2 ** 64.
BASE = 0xD6E8FEB86659FD93
CHUNK = 100_000


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept suffixes of a text of len(h) words."""
    if len(h) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for i in range(GRAM):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    least, step = g, 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    # kept if least in some window that holds it: the greatest of the windows' least values
    top = np.r_[np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)]
    step = 1
    while step < WINDOW:
        top = np.maximum(top[:-step], top[step:])
        step *= 2
    at = np.flatnonzero(top == g)
    # in a run of one hash (periodic text), the first and the last in each GRAM words are enough: those kept stand at
    # most max(GRAM, WINDOW) <= BEFORE words apart, so their windows are those of the whole run
    same = g[at[1:]] == g[at[:-1]]
    begin = at[np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(at)), 0))]
    inside = same & (np.diff((at - begin) // GRAM) == 0)
    at = at[~(np.r_[False, inside] & np.r_[inside, False])]
    return at, g[at]


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod 2 ** 64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)], dtype=np.uint64)[:n]


def range_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Hashes of the words first .. last - 1 of a text, each word by its place relative to origin."""
    sums = np.r_[np.uint64(0), np.cumsum(h * powers(len(h), BASE), dtype=np.uint64)]
    x = (sums[last] - sums[first]) * powers(len(h) + 1, pow(BASE, -1, 1 << 64))[origin]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for u, t in zip(b.column(0).to_pylist(), b.column(1)):
            h = word_hashes(t.as_py())
            at, g = minimisers(h)
            if len(at):
                first, last = np.maximum(at - PASSAGE, 0), np.minimum(at + PASSAGE, len(h))
                around = range_hashes(h, first, last, at)
                for c, x in zip(columns, (np.full(len(at), u, np.int64), at.astype(np.int32), g.view(np.int64), around.view(np.int64), (at - first).astype(np.int8), (last - at).astype(np.int8))):
                    c.append(x)
        if columns[0]:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], ["uid", "pos", "gram", "around", "before", "after"])


def holding(n: int, at: np.ndarray) -> np.ndarray:
    """Of each start of a window of a text of n words: whether the window holds the GRAM words at a place of `at`."""
    n = n - PASSAGE + 1
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.maximum(at - BEFORE, 0), 1)
    np.add.at(steps, np.minimum(at, n - 1) + 1, -1)
    return np.cumsum(steps)[:-1] > 0


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows at open and leading places but not at following ones, whose leading place gives the same."""
    for b in batches:
        for u, t, *at in zip(b.column(0).to_pylist(), *(b.column(i) for i in range(1, 5))):
            h = word_hashes(t.as_py())
            open_, lead, follow = (holding(len(h), np.array(x.as_py(), np.int64)) for x in at)
            start = np.flatnonzero((open_ | lead) & ~follow)
            x = range_hashes(h, start, start + PASSAGE, start).view(np.int64)
            for i in range(0, len(start), CHUNK):
                some = start[i : i + CHUNK]
                yield pa.record_batch([pa.array(np.full(len(some), u, np.int64)), pa.array(some.astype(np.int32)), pa.array(x[i : i + CHUNK]), pa.array(lead[some])], ["uid", "pos", "hash", "known"])


def _by(rows: DataFrame, key: str, *more: Column) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Groups of rows (a written table) by key: their size n, least and greatest uid, further aggregates; and what joins rows with those groups that are left."""
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi"), *more)
    return groups, lambda g: skew_join(rows, g, [key], "n", hot_limit(rows.count()), "id").filter("n is not null").drop("id", "n")


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """docs (uid, text) -> uid, first, last: intervals of words that stand in another document too (end exclusive)."""
    text = docs.select("uid", "text")
    suffixes = materialize(text.mapInArrow(_suffixes, "uid long, pos int, gram long, around long, before byte, after byte"), "suffixes")
    groups, joined = _by(suffixes, "gram")
    places = materialize(joined(groups.filter("lo < hi").select("gram", "n")), "places")
    # known places: their surroundings are another document's too; the document of least uid leads
    groups, joined = _by(places, "around")
    places = materialize(joined(groups.select("around", "n", "lo", (F.col("lo") < F.col("hi")).alias("known"))).drop("around"), "known")
    known = places.filter("known").select("uid", (F.col("pos") - F.col("before")).alias("first"), (F.col("pos") + F.col("after")).alias("last"))
    # of GRAM words that are known wherever they stand, nothing is left to find
    groups, joined = _by(places.withColumnRenamed("lo", "leader"), "gram", F.min("known").alias("all_known"))
    rest = joined(groups.filter("not all_known").select("gram", "n"))
    at = lambda which: F.collect_list(F.expr(f"case when {which} then pos end"))
    rest = rest.groupBy("uid").agg(at("not known").alias("open"), at("known and uid = leader").alias("lead"), at("known and uid > leader").alias("follow"))  # bounded by the document itself
    windows = text.join(rest, "uid").select("uid", "text", "open", "lead", "follow").mapInArrow(_windows, "uid long, pos int, hash long, known boolean")
    groups, joined = _by(materialize(windows, "windows"), "hash", F.max("known").alias("any_known"))
    found = joined(groups.filter("lo < hi or any_known").select("hash", "n")).select("uid", F.col("pos").alias("first"), (F.col("pos") + PASSAGE).alias("last"))
    return known.unionByName(found)


def repeats(docs: DataFrame) -> DataFrame:
    """Documents that share a passage of PASSAGE words or more with another: doc_id, n_spans, repeated_words, spans.

    docs: uid (unique long), doc_id, text. Spans are first:last in words, end exclusive, by place, comma-joined. Null
    and short texts have none; documents without one give no row; repeated rows are documents that share all.
    """
    found = repeated_intervals(docs)
    start = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("out"))

    def step(s, x):
        apart = x["first"] > s["b"]
        closed = F.when(apart & (s["a"] >= 0), F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["out"])
        return F.struct(F.when(apart, x["first"]).otherwise(s["a"]).alias("a"), F.greatest(s["b"], x["last"]).alias("b"), closed.alias("out"))

    merged = F.aggregate(F.col("all"), start, step, lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))
    spans = found.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("all")).select("uid", merged.alias("u"))
    out = spans.join(docs.select("uid", "doc_id"), "uid")
    words = F.aggregate("u", F.lit(0), lambda a, x: a + x["b"] - x["a"])
    return out.select("doc_id", F.size("u").cast("long").alias("n_spans"), words.cast("long").alias("repeated_words"),
                      F.array_join(F.transform("u", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"))), ",").alias("spans"))


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    return repeats(with_uid(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))

"""Quality rules by distribution divergence (DataFrame functions only, one pass, no shuffle).

A document's histograms of character classes and of common words are held against its language's references, by
Jensen-Shannon distance (base 2, square root). Each rule holds only from a minimum length on, and abstains where the
language has no reference. The base rules (too few words, too many words in repeated windows) reject first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, lower_ascii, shielded, text_or_empty

WINDOW = 5
MIN_CHARS, MIN_WORDS = 300, 80
#: Of the classes, of the words, and of the mean of both.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MAX_MEAN_DISTANCE = 0.25, 0.45, 0.225

#: Classes of characters, by Unicode category but for the marks of punctuation (the last class is any other character).
CLASSES = (("lower", r"\p{Ll}"), ("upper", r"\p{Lu}\p{Lt}"), ("letter", r"\p{Lo}\p{Lm}\p{M}"), ("digit", r"\p{Nd}"),
           ("space", r"\x20\x09-\x0D"), ("stop", r".,;:!?'\x22()\x2D。、，！？：；（）「」『』،؛؟।"))
#: The share of each class in prose of scripts with two cases, of others with spaces, and of others without.
CASED = (0.795, 0.020, 0.000, 0.003, 0.160, 0.018, 0.004)
SPACED = (0.003, 0.002, 0.788, 0.003, 0.180, 0.020, 0.004)
UNSPACED = (0.003, 0.002, 0.876, 0.006, 0.010, 0.099, 0.004)
#: Languages by the reference of their classes.
SCRIPTS = ((CASED, "en de fr es it pt nl sv da no fi pl cs sk hu ro bg ru uk el tr hr sl lt lv et".split()), (SPACED, "ar fa he hi ko".split()), (UNSPACED, "zh ja".split()))
#: The commonest lower-case letters, which are dropped before the others are counted.
_PLAIN = "a-zß-öø-ÿ"
#: The commonest words of each language, and their share of all words in prose.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by".split(),
    "de": "der die und in den von zu das sich mit des auf für ist im nicht".split(),
    "fr": "de la le et les en des un du une que est pour par dans avec".split(),
    "es": "de la que el en y los las se del un por con no una su".split(),
}
WORD_SHARES = (0.050, 0.027, 0.021, 0.016, 0.013, 0.011, 0.010, 0.009, 0.008, 0.007, 0.006, 0.006, 0.005, 0.005, 0.005, 0.004)


def js_distance(counts: Column, total: Column, shares: Column) -> Column:
    """sqrt of the Jensen-Shannon divergence of counts / total and shares (arrays); each adds up to one."""
    pairs = F.arrays_zip(counts.alias("n"), shares.alias("q"))

    def part(x: Column) -> Column:
        p, q = x["n"] / total, x["q"]
        m = (p + q) / 2
        side = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0)) / 2
        return side(p) + side(q)

    return F.sqrt(F.greatest(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + part(x)), F.lit(0.0)))


def _repeated(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the text has twice or more. Windows of one 64-bit hash are compared by their words."""
    n = F.size(words) - (WINDOW - 1)
    zipped = F.arrays_zip(*[F.slice(words, i + 1, F.greatest(n, F.lit(0))) for i in range(WINDOW)])

    def count(keys: Column) -> Column:
        ordered = F.sort_array(F.arrays_zip(keys.alias("h"), F.sequence(F.lit(0), F.size(keys) - 1).alias("i")))
        at = lambda x: F.slice(words, x["i"] + 1, F.lit(WINDOW))
        same = lambda x, y: (x["h"] == y["h"]) & (at(x) == at(y))
        twice = let(ordered, lambda o: F.transform(F.filter(
            o, lambda x, i: same(x, F.get(o, i + 1)) | same(x, F.get(o, i - 1))), lambda x: x["i"]))
        covered = let(F.sort_array(twice), lambda p: F.aggregate(F.transform(
            p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered)

    return F.when(n < 2, F.lit(0)).otherwise(let(F.transform(zipped, lambda w: F.xxhash64(w)), count))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the columns of the verdict, each prefixed with __q_. Null texts count as empty; nothing else is read but lang (null: no language)."""
    text = text_or_empty()
    d = docs.withColumn("__q_text", text).withColumn("__q_words", F.array_remove(F.split("__q_text", SPACE), ""))
    lines = F.filter(F.split("__q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__q_n_words", F.size("__q_words").cast("long"))
    d = d.withColumn("__q_word_chars", F.length(F.array_join("__q_words", "")).cast("long"))
    d = d.withColumn("__q_n_symbols", F.length(F.regexp_replace("__q_text", r"[^#*$%&|<>]+", "")).cast("long"))
    d = d.withColumn("__q_n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    d = d.withColumn("__q_n_repeat_words", _repeated(F.col("__q_words")).cast("long"))
    d = d.withColumn("__q_base_failed", (F.col("__q_n_words") < 10) | (100 * F.col("__q_n_repeat_words") > 20 * F.col("__q_n_words")))
    chars = F.length("__q_text")
    # what is neither a plain lower-case letter nor space is rare: the other classes are counted in it
    rare = F.regexp_replace("__q_text", f"[{_PLAIN}{CLASSES[4][1]}]+", "")

    def classes(r: Column) -> Column:
        lower, upper, letter, digit, stop = (F.length(F.regexp_replace(r, f"[^{CLASSES[i][1]}]+", "")) for i in (0, 1, 2, 3, 5))
        space = chars - F.col("__q_word_chars")
        found = [chars - space - F.length(r) + lower, upper, letter, digit, space, stop, F.length(r) - lower - upper - letter - digit - stop]
        return F.array(*[x.cast("double") for x in found])

    shares = F.lit(None).cast("array<double>")
    for reference, langs in SCRIPTS:
        shares = F.when(F.col("lang").isin(langs), F.array(*map(F.lit, reference))).otherwise(shares)
    d = d.withColumn("__q_classes", let(rare, classes)).withColumn("__q_chars", chars.cast("double")).withColumn("__q_shares", shares)
    # counts of the language's common words; a language without a reference has none
    listed = F.lit(None).cast("array<string>")
    for lang, words in COMMON.items():
        listed = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(listed)
    hits = F.filter(F.split(lower_ascii(F.col("__q_text")), SPACE), lambda w: F.array_contains(F.col("__q_list"), w))
    d = d.withColumn("__q_list", listed).withColumn("__q_hits", hits)
    total = F.col("__q_n_words").cast("double")

    def counts(h: Column) -> Column:
        each = [F.size(h) - F.size(F.array_remove(h, F.get("__q_list", F.lit(i)))) for i in range(len(WORD_SHARES))]
        return F.array(*[x.cast("double") for x in (*each, F.col("__q_n_words") - F.size(h))])

    class_far = js_distance(F.col("__q_classes"), F.col("__q_chars"), F.col("__q_shares"))
    word_far = let(let(F.col("__q_hits"), counts), lambda n: js_distance(n, total, F.array(*map(F.lit, (*WORD_SHARES, 1 - sum(WORD_SHARES))))))
    d = d.withColumn("__q_class_distance", F.when((F.col("__q_chars") >= MIN_CHARS) & F.col("__q_shares").isNotNull(), class_far))
    d = d.withColumn("__q_word_distance", F.when((F.col("__q_n_words") >= MIN_WORDS) & F.col("__q_list").isNotNull(), word_far))
    far = (F.coalesce("__q_class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("__q_word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    far = far | F.coalesce((F.col("__q_class_distance") + F.col("__q_word_distance")) / 2 > MAX_MEAN_DISTANCE, F.lit(False))
    return d.withColumn("__q_kept", ~F.col("__q_base_failed") & ~far)


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance (null below the minimum length and for other languages).

    One row a row of docs; repeated rows repeat; an empty table gives none.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    d = measured(docs.select("doc_id", "text", "lang"))
    return d.select("doc_id", *[F.col(f"__q_{n}").alias(n) for n in names])


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs (any further columns) that the rules keep."""
    # the row number keeps the filter above the projection: pushed below, it would repeat every expression at each of its uses
    return shielded(docs, ("doc_id", "text", "lang"), lambda d: measured(d).withColumn("__q_row", F.monotonically_increasing_id()).filter("__q_kept and __q_row >= 0"))

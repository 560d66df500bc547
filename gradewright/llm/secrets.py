"""Secret scans (DataFrame functions only): fixed patterns, and a log-likelihood ratio of two character Markov models.

The models, one of random strings and one of ordinary identifiers, are first-order chains over ALPHABET, trained from
labelled samples with add-one smoothing. A candidate (20 or more characters; letters and digits both, or letters with
CASE_CHANGES changes of case) is a secret if its log-likelihood ratio passes MIN_TOTAL and, a character, MIN_MEAN. In
any other run the parts of highest ratio, widened to the next separators, are held to the same rules, so a name or path
in front hides nothing. Spans are code points, end exclusive.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, prefix_sums, shielded, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same matches as AKIA[A-Z0-9]+ of 20 or more characters: a run is taken whole
HEX = r"[0-9a-f]{24,}"  # the same as runs of 24 or more
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
MIN_TOTAL, MIN_MEAN = 6.0, 0.35
LEAST, CASE_CHANGES = 20, 5
SAMPLES, SEED = 3000, 7
MASK = "<secret>"

#: Words of ordinary identifiers, for the labelled samples.
IDENTIFIER_WORDS = """access account action address agent amount array base batch block buffer build button cache call change check
child class client code column command common config connect content context control copy count create current data
date default delete device display document domain element email enable entry error event factory field file filter
first font form format frame function group handle header height history image index input insert instance item key
label layout length level library line link list load local location lock log manager map master memory message method
mode model module name network node number object offset option order output page parent parse path pattern player
point policy position prefix process profile property query queue random range read record region register remove
report request reset resource response result return role root rule sample schema screen script search section select
sender server service session set signal simple size source stack start state status stop storage stream string style
success summary symbol system table target task template test text thread time title total track type update upload
user value vector version video view width window worker write""".split()


def labelled_samples(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """n random strings (1) and n ordinary identifiers (0), by seeded rule."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:62], ALPHABET[26:62], ALPHABET[:64], ALPHABET[:26] + "0123456789")
    out = []
    for i in range(n):
        out.append(("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 48))), 1))
        words = rng.choices(IDENTIFIER_WORDS, k=rng.randint(3, 6))
        words = [w if rng.random() < 0.85 else str(rng.randint(0, 2030)) for w in words]
        style = i % 5
        name = ("_".join(words), "-".join(words), "/".join(words), words[0] + "".join(w.capitalize() for w in words[1:]), "_".join(words).upper())[style]
        out.append((name, 0))
    return out


def codes(s: Column) -> Column:
    """Places in ALPHABET from 1, 0 for any other character."""
    return F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(samples: DataFrame) -> list[float]:
    """samples (text, label 1 random / 0 ordinary) -> the log ratio of each character pair, by code of the first, then of the second.

    At most 2 * (SIZE + 1) ** 2 counts go to the driver, whatever the number of samples. Null texts count as empty; without samples every ratio is 0.
    """
    from math import log

    c = samples.select("label", codes(text_or_empty()).alias("c")).filter(F.size("c") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * (SIZE + 1) + F.get("c", i))
    counts = c.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count().collect()
    k = SIZE + 1
    n = {0: [1.0] * (k * k), 1: [1.0] * (k * k)}
    for label, pair, count in counts:
        n[label][pair] += count
    row = {y: [sum(n[y][i * k : i * k + k]) for i in range(k)] for y in n}
    return [log(n[1][i] / row[1][i // k]) - log(n[0][i] / row[0][i // k]) for i in range(k * k)]


def table_column(table: list[float]) -> Column:
    """A constant array (folded by the optimizer)."""
    return F.transform(F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ","), lambda x: x.cast("double"))


def ratio(s: Column, table: Column) -> Column:
    """The log-likelihood ratio of a string."""
    return let(codes(s), lambda c: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), F.lit(0.0),
        lambda a, i: a + F.coalesce(F.get(table, F.get(c, i - 1) * (SIZE + 1) + F.get(c, i)), F.lit(0.0))))


def rising_parts(s: Column, table: Column) -> Column:
    """Parts (s, e) of a string, end exclusive, whose ratio is MIN_TOTAL or more; one ends where its ratio would fall by over MIN_TOTAL, or to zero. Widened to the next of = / _ -."""
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0.0).alias("run"), F.lit(0.0).alias("best"), F.expr("cast(array() as array<struct<s:int,e:int,best:double>>)").alias("out"))

    def closed(a: Column) -> Column:
        return F.when(a["best"] >= MIN_TOTAL, F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"), a["best"].alias("best"))))).otherwise(a["out"])

    def put(s: Column, e: Column, run: Column, best: Column, out: Column) -> Column:
        return F.struct(s.alias("s"), e.alias("e"), run.alias("run"), best.alias("best"), out.alias("out"))

    def found(c: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            run = a["run"] + F.coalesce(F.get(table, F.get(c, i - 1) * (SIZE + 1) + F.get(c, i)), F.lit(0.0))
            return let(run, lambda x: F.when(x > a["best"], put(a["s"], i + 1, x, x, a["out"]))
                       .when((x <= 0) | (x < a["best"] - MIN_TOTAL), put(i, i, F.lit(0.0), F.lit(0.0), closed(a))).otherwise(put(a["s"], a["e"], x, a["best"], a["out"])))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), start, step, closed)

    def widened(x: Column) -> Column:
        left = F.length(F.regexp_extract(F.substring(s, F.lit(1), x["s"]), "[^=/_-]*$", 0))
        right = F.length(F.regexp_extract(F.substring(s, x["e"] + 1, F.length(s)), "^[^=/_-]*", 0))
        return F.struct((x["s"] - left).alias("s"), (x["e"] + right).alias("e"), x["best"].alias("best"))

    def good(x: Column) -> Column:
        n = x["e"] - x["s"]
        return (n >= LEAST) & (x["best"] >= MIN_MEAN * n) & mixed(F.substring(s, x["s"] + 1, n))

    def joined(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        both = F.array(F.struct(F.least(last["s"], x["s"]).alias("s"), x["e"].alias("e")))
        return F.when(last["e"] > x["s"], F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), both)).otherwise(F.concat(a, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    parts = F.filter(F.transform(let(codes(s), found), widened), good)
    return F.aggregate(parts, F.expr("cast(array() as array<struct<s:int,e:int>>)"), joined)


def mixed(s: Column) -> Column:
    """Letters and digits both, or letters that change their case often."""
    return (s.rlike("[0-9]") & s.rlike("[A-Za-z]")) | (F.size(F.regexp_extract_all(s, F.lit("([a-z][A-Z]|[A-Z][a-z])"), F.lit(1))) >= CASE_CHANGES)


def _span(start: Column, end: Column, kind: int) -> Column:
    return F.struct(start.cast("int").alias("s"), F.lit(kind).alias("k"), end.cast("int").alias("e"))


NO_SPANS = "cast(array() as array<struct<s:int,k:int,e:int>>)"


def _matches(text: Column, pattern: str, kind: int, keep, parts=None) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches for which keep(match, its group 2) holds; of others, of their parts(match)."""
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})" if kind else pattern), F.lit(1 if kind else 0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("m"), second.alias("g")), lambda x: x["m"].isNotNull())

    def found(r: Column) -> Column:
        def spans_of(x: Column, before: Column) -> Column:
            s = before + x["gap"]
            own = F.when(keep(x["m"], x["g"]), F.array(_span(s, s + F.length(x["m"]), kind)))
            return own.otherwise(F.expr(NO_SPANS) if parts is None else F.transform(parts(x["m"]), lambda p: _span(s + p["s"], s + p["e"], kind)))

        before = prefix_sums(F.transform(r, lambda x: x["gap"] + F.length(x["m"])))
        return F.flatten(F.zip_with(r, before, spans_of))

    return F.when(text.rlike(pattern), let(rows, found)).otherwise(F.expr(NO_SPANS))


def spans(text: Column, table: Column) -> tuple[Column, Column]:
    """Arrays of (s, k, e) by start and kind: those of the fixed patterns, and those that the models add (none overlaps a fixed one)."""
    yes = lambda m, g: F.lit(True)
    base = F.array_sort(F.concat(
        _matches(text, ASSIGN, 0, lambda m, g: F.length(g) >= 6), _matches(text, ACCESS, 1, yes), _matches(text, HEX, 2, yes)))

    def random_like(m: Column, g: Column) -> Column:
        return mixed(m) & let(ratio(m, table), lambda r: (r >= MIN_TOTAL) & (r >= MIN_MEAN * F.length(m)))

    return base, _matches(text, CANDIDATE, 3, random_like, lambda m: rising_parts(m, table))


def model(spark: SparkSession) -> Column:
    return table_column(train(spark.createDataFrame(labelled_samples(), "text string, label int")))


def _listed(x: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(x, lambda p: F.concat_ws(":", F.get(names, p["k"]), p["s"].cast("string"), p["e"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __base and __all, arrays of spans. A null text counts as empty and has none."""
    base, more = spans(F.col("__text"), model(docs.sparkSession))
    out = docs.withColumn("__text", text_or_empty(text)).withColumn("__base", base).withColumn("__more", more)
    apart = F.filter("__more", lambda m: ~F.exists("__base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return out.withColumn("__all", F.array_sort(F.concat("__base", apart))).drop("__more")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov. One row a row of docs (repeated rows repeat); an empty table gives none."""
    found = with_spans(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("__base", lambda p: p["k"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("__all")).alias("spans"),
                        (F.size("__all") - F.size("__base")).cast("long").alias("n_markov"))


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span, overlapping ones as one, put as MASK; n_chars follows where it is a column. Null texts stay null."""
    return shielded(docs, ("text", "n_chars"), _redacted)


def _redacted(docs: DataFrame) -> DataFrame:
    found = with_spans(docs)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, p: Column) -> Column:
        new = p["s"] >= a["at"]
        gap = F.substring(F.col("__text"), a["at"] + 1, F.greatest(p["s"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], p["e"]).alias("at"), F.when(new, F.concat(a["out"], gap, F.lit(MASK))).otherwise(a["out"]).alias("out"))

    end = lambda a: F.concat(a["out"], F.substring(F.col("__text"), a["at"] + 1, F.length("__text")))
    clean = F.when(F.size("__all") == 0, F.col("text")).otherwise(F.aggregate("__all", start, step, end))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__all") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out

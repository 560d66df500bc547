"""Shared pieces of the corpus operators: shared-folder tables, ASCII lowering, skew-proof joins, distributed ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Groups above max(rows // HOT_PARTS, HOT_LEAST) rows count as hot, so there are at most HOT_PARTS of them.
HOT_PARTS, HOT_LEAST = 2000, 200
#: A rank is taken inside this many hash buckets of every group.
RANK_BUCKETS = 4096

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one of setCheckpointDir.

    Where neither is set, a local master (tests) gets a fresh folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    set_later = sc._jsc.sc().getCheckpointDir()
    found = sc.getConf().get("spark.checkpoint.dir") or (set_later.get() if set_later.isDefined() else None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(sc, "_gradewright_dir", None)
    if own is None:
        own = sc._gradewright_dir = "file://" + tempfile.mkdtemp(prefix="gradewright-")
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: S112 - that session has ended: the cluster's own clean-up of the folder remains
            continue


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows in what runs inside: the JVM and the worker each hold a batch of whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shielded(docs: DataFrame, own: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs) in the columns of docs, whatever their names: those not in own bear names of no operator meanwhile."""
    names = {c: c if c in own else f"x{i}" for i, c in enumerate(docs.columns)}
    return run(docs.toDF(*names.values())).select(*[F.col(n).alias(c) for c, n in names.items()])


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the fast path, which gives the same."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hot_limit(rows: int) -> int:
    return max(rows // HOT_PARTS, HOT_LEAST)


def skew_join(left: DataFrame, groups: DataFrame, keys: list[str], size: str, limit: int, salt: str) -> DataFrame:
    """left with the columns of groups (one row a key, `size` rows of left each); keys are not null.

    Groups of over `limit` rows number at most rows / limit <= HOT_PARTS, so they are broadcast; their rows go
    through the shuffle join without a key, spread by the unique column `salt`, and take their match from the broadcast.
    """
    values = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col(size) > limit).select(
        *[F.col(k).alias(f"__hot_{k}") for k in keys], F.struct(*values).alias("__hot"))
    # -1, but not a constant to the optimizer, which would drop it from the keys of the shuffle
    cold_salt = (F.least(F.col(size), F.lit(0)) - 1).cast("long")
    cold = groups.filter(F.col(size) <= limit).select(
        *[F.col(k).alias(f"__cold_{k}") for k in keys], F.struct(*values).alias("__cold"), cold_salt.alias("__cold_salt"))
    on = [F.col(k) == F.col(f"__hot_{k}") for k in keys]
    tagged = left.join(F.broadcast(hot), on, "left")
    is_hot = F.col("__hot").isNotNull()
    tagged = tagged.select(
        *left.columns, "__hot",
        *[F.when(~is_hot, F.col(k)).alias(f"__key_{k}") for k in keys],
        F.when(is_hot, F.col(salt)).otherwise(F.lit(-1)).cast("long").alias("__salt"))
    # null-safe equality would match the emptied keys, plain equality never does
    on = [F.col(f"__key_{k}") == F.col(f"__cold_{k}") for k in keys] + [F.col("__salt") == F.col("__cold_salt")]
    joined = tagged.join(cold, on, "left")
    found = F.coalesce("__hot", "__cold")
    return joined.select(*left.columns, *[found[v].alias(v) for v in values])


def position_in_group(df: DataFrame, groups: list[str], bucket: str, order: list[Column], out: str, total: str | None = None) -> DataFrame:
    """Add `out`, the 0-based place of each row in its group by (bucket, order), without gathering a group in one task.

    Rows are ranked inside (group, bucket); the counts of the buckets, at most RANK_BUCKETS a group, give the offsets.
    df is read twice: write it as a table first if it is dear. `total` adds the size of the group.
    """
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    counts = df.groupBy(*groups, bucket).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
    counts = counts.withColumn("__total", F.sum("__n").over(w)).drop("__n")
    keys = [*groups, bucket]
    joined = df.join(counts, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + F.coalesce("__before", F.lit(0))
    return joined.select(*df.columns, place.cast("long").alias(out), *([F.col("__total").alias(total)] if total else []))


def hash_bucket(h: Column) -> Column:
    """The top 12 bits of a 64-bit hash, as 0 .. RANK_BUCKETS - 1."""
    return F.shiftrightunsigned(h, 52).cast("int")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefix_sums(values: Column, chunk: int = 256) -> Column:
    """For an array of ints, the sum before each of them. Arrays grow by chunks: a fold that appends copies its array at every step."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    add = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def sums(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / chunk).cast("int"), F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(v, i * chunk + 1, F.lit(chunk)), start, add))
        return let(cut, lambda c: F.flatten(F.zip_with(c, F.aggregate(c, start, lambda a, x: add(a, x["at"]), lambda a: a["out"]), lambda x, b: F.transform(x["out"], lambda o: o + b))))

    return F.when(F.size(values) > 0, let(values, sums)).otherwise(F.expr("cast(array() as array<int>)"))

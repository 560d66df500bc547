"""Exact dedup by deterministic block naming (DataFrame functions only).

Each text is lower-cased (A-Z only) and cut into blocks of BLOCK bytes. Equal blocks get one integer name: the least
block id among them, found by grouping on the block itself, never on a hash. Then adjacent names are paired and the
pairs named, level by level, until every document has one name. (level, name) is free of collisions by induction:
a name stands for one block content at level 0, and for one pair of names (or a name alone) at each later level.

Text is shuffled twice (grouping, naming), names only after that; levels number log2(longest / BLOCK).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_LEAST, hot_limit, lower_ascii, materialize, shielded, skew_join, text_or_empty

BLOCK = 8192
#: Blocks whose rows number over 1 / HOT_BLOCKS of all block rows are hot: at most so many are broadcast.
HOT_BLOCKS = 500


def _named(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """rows with `name`, the least `bid` (unique in rows) among those that are equal in keys."""
    groups = rows.groupBy(*keys).agg(F.min("bid").alias("name"), F.count("*").alias("__copies"))
    # a row without an equal names itself: its content need not be sent to the join a second time
    joined = skew_join(rows, groups.filter("__copies > 1"), keys, "__copies", limit, "bid")
    return joined.withColumn("name", F.coalesce("name", "bid")).drop(*keys, "__copies")


def block_count(c: Column, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(c) / F.lit(block))).cast("int")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs (uid long unique, doc_id, text) -> uid, doc_id, sha, level int, name long: equal (level, name) if and only if equal text.

    Hot groups of a level are counted against the rows of that level, so at most HOT_BLOCKS blocks (4 MiB of content) and HOT_PARTS pairs are broadcast.
    """
    blocks_in_all = docs.agg(F.sum(block_count(text_or_empty(), block))).first()[0] or 0
    text = docs.select("uid", "doc_id", lower_ascii(text_or_empty()).alias("__t"))
    text = text.select("uid", "doc_id", F.sha2("__t", 256).alias("sha"), F.col("__t").cast("binary").alias("__b"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("__b", i * block + 1, F.lit(block)))
    text = text.withColumn("n", block_count(F.col("__b"), block))
    blocks = text.select("uid", "doc_id", "sha", "n", F.posexplode(cut).alias("pos", "block"))
    blocks = blocks.select("uid", "doc_id", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "n", "pos", "block",
                           F.monotonically_increasing_id().alias("bid"))
    cur = materialize(_named(blocks, ["block"], max(blocks_in_all // HOT_BLOCKS, HOT_LEAST)).drop("bid"), "block-names")
    out, level = [], 0
    longest = cur.agg(F.max("n")).first()[0] or 1
    while True:
        out.append(cur.filter("n = 1").select("uid", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        half = F.floor(F.col("pos") / 2).cast("int")
        even = F.col("pos") % 2 == 0
        pairs = cur.filter("n > 1").groupBy("uid", half.alias("pos")).agg(
            F.first("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max("n").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = materialize(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int")), "block-pairs")
        pairs = pairs.withColumn("bid", F.monotonically_increasing_id())  # a table's files: the same ids in every job
        cur = materialize(_named(pairs, ["left", "right"], hot_limit(pairs.count())).drop("bid"), "pair-names")
        longest, level = (longest + 1) // 2, level + 1
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a document: uid, doc_id, keep_id, group_size, kept, text_sha256.

    docs: uid (unique long, as of `with_uid`), doc_id, text. Null text counts as empty; the row with the largest doc_id stays (a null
    doc_id is the least); of repeated rows with that doc_id the one with the largest uid. An empty table gives no rows.
    """
    found = identities(docs, block)
    groups = found.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "uid")).alias("__keep"), F.count("*").alias("group_size"))
    joined = skew_join(found, groups, ["level", "name"], "group_size", hot_limit(docs.count()), "uid")
    return joined.select("uid", "doc_id", F.col("__keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
                         (F.col("uid") == F.col("__keep.uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def with_uid(docs: DataFrame, name: str = "uid") -> DataFrame:
    """docs with a unique long that is the same in every job: rows that don't come straight from files are written first.

    The ids follow how files are cut into tasks, which else changes with the number of executors: it is pinned here.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    steps = docs._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    if not {s.lstrip(" :+-").split(" ")[0] for s in steps} <= {"Project", "Filter", "Relation"}:
        docs = materialize(docs, "rows")
    return docs.withColumn(name, F.monotonically_increasing_id())


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = with_uid(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return exact_groups(docs).drop("uid")


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs (any further columns) without exact copies."""
    def run(d: DataFrame) -> DataFrame:
        tagged = with_uid(d, "__row")
        kept = exact_groups(tagged.select(F.col("__row").alias("uid"), "doc_id", "text")).filter("kept")
        return tagged.join(kept.select(F.col("uid").alias("__row")), "__row", "left_semi")

    return shielded(docs, ("doc_id", "text"), run)


ORACLE_OP1 = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

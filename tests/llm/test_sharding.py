"""The interleaving against a plain sort, with ties, repeated rows and one source of a third of the rows."""

import zlib

from pyspark.sql import functions as F

from gradewright.llm import sharding
from gradewright.llm.common import RANK_BUCKETS


def test_placement(spark):
    rows = [(i, f"text {i}", ("big", "big", "s0", "s1", None, f"one{i}")[i % 6], "clash") for i in range(700)]
    rows += [rows[5], (3, "text 3", "big", "clash"), (None, None, None, None), (None, "", "big", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string").repartition(6)
    got = sharding.interleave(docs).collect()
    # the hashes are Spark's; everything after them is done here by hand
    h = docs.select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).alias("b"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"),
                    F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("stratum"))
    h = h.select("*", F.xxhash64(F.lit(sharding.SEED), "doc_id", "c", (F.col("b") + 1).cast("long")).alias("h"), F.pmod(F.xxhash64(F.lit(sharding.SEED + 1), "stratum"), F.lit(1 << 20)).alias("shift")).collect()
    strata = {}
    for r in h:
        strata.setdefault(r.stratum, []).append(((r.h & (1 << 64) - 1) >> 52, r.h, -1 if r.doc_id is None else r.doc_id, r.b + 1, r.c, r))
    places = []
    for name, members in strata.items():
        for rank, m in enumerate(sorted(members, key=lambda x: x[:5])):
            at = (rank + m[5]["shift"] / float(1 << 20)) / len(members)
            places.append((min(int(at * RANK_BUCKETS), RANK_BUCKETS - 1), at, name, rank, m[5]))
    places.sort(key=lambda x: x[:4])
    n, want, slots = len(places), [], {}
    for place, (*_, r) in enumerate(places):
        shard = place * 8 // n
        slots[shard] = slots.get(shard, -1) + 1
        want.append(str((r.doc_id, r.source, r.b + 1, r.c, "rows", shard, slots[shard], None)))
    assert sorted(want) == sorted(str((r.doc_id, r.source, r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard)) for r in got)
    texts = dict((r[0], r[1]) for r in rows)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    for k in range(8):  # each shard matches the mixture to a row a source and side
        for s, of in (("big", 235), ("s0", 117)):
            assert abs(sum(r.shard == k and r.source == s for r in got) - of / 8) <= 3

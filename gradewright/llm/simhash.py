"""SimHash near-dedup with pivot distance tables.

A document's fingerprint takes the majority of the bits of its 4-word shingles' XXH64. Fingerprints at 4 or fewer
differing bits link. Each distinct fingerprint gets a table row of its Hamming distances to PIVOTS reference
fingerprints. Pairs come from blocks: of six segments of the 64 bits, four differing bits leave two untouched, so
linked fingerprints share one of 15 pairs of segments. In a block, a pair whose coordinates differ by over 4 anywhere
is discarded (triangle inequality) and the survivors are verified. Blocks are searched breadth first against the
members not yet reached, so a dense group costs a star and not all of its pairs, and no link is lost. A block too large
for one task is cut into chunks, and every pair of its chunks is a block.
Components then come from alternating large and small stars over the (few) links, as tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_limit, materialize, shielded, skew_join
from .exact_dedup import with_uid

WORDS, NEAR = 4, 4
SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PIVOTS = 16
CHUNK = 200_000  # shingles hashed at a time
#: Fingerprints of a block that one task holds; larger blocks are searched by pairs of chunks of so many.
BLOCK_ROWS = 50_000


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint; null and empty texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n, ones = len(words) - WORDS + 1, np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
    for at in range(0, n, CHUNK):
        k = min(CHUNK, n - at)
        h = np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, k), repeat(42)), np.uint64, k)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.uint64, b.num_rows).view(np.int64)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(fp)], ["uid", "doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (uid, doc_id long, text) -> uid, doc_id, fp (signed)."""
    return docs.select("uid", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "uid long, doc_id long, fp long")


def pivots() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def block_links(fps: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member) of every component with two or more members, by search against those not yet reached."""
    left = np.arange(len(fps))
    out = []
    while len(left) > 1:
        queue, left, members = [int(left[0])], left[1:], []
        while queue:
            x = queue.pop()
            members.append(x)
            if not len(left):
                continue
            may = np.abs(table[left, 0] - table[x, 0]) <= NEAR
            for p in range(1, PIVOTS):
                if not may.any():
                    break
                may &= np.abs(table[left, p] - table[x, p]) <= NEAR
            found = np.flatnonzero(may)
            found = found[np.bitwise_count(fps[left[found]] ^ fps[x]) <= NEAR]
            if len(found):
                queue += left[found].tolist()
                left = np.delete(left, found)
        if len(members) > 1:
            low = min(members, key=lambda i: int(fps[i]))
            out += [(int(fps[i]), int(fps[low])) for i in members if i != low]
    return out


def _search(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp, coords) -> links. Blocks of two, most of all, are verified at once; a block may span batches.

    Rows of a block of over `limit` fingerprints are passed on with the number of their chunk instead: no task holds them.
    """
    rest: tuple | None = None
    hot, seen = None, 0

    def out(links: np.ndarray, key: np.ndarray, fp: np.ndarray, co: np.ndarray, chunk: np.ndarray) -> pa.RecordBatch:
        gap, tail = pa.nulls(len(key), pa.int64()), len(links)
        columns = [pa.concat_arrays([pa.array(links[:, i], pa.int64()), gap]) for i in (0, 1)]
        for x, kind in ((key, pa.int64()), (fp.view(np.int64), pa.int64()), ([c.tobytes() for c in co], pa.binary()), (chunk, pa.int32())):
            columns.append(pa.concat_arrays([pa.nulls(tail, kind), pa.array(x, kind)]))
        return pa.record_batch(columns, ["u", "v", "key", "fp", "coords", "chunk"])

    none = np.zeros((0, 2), np.int64)

    def passed_on(key, fp, co) -> pa.RecordBatch:
        return out(none, key, fp, co, ((seen + np.arange(len(key))) // (limit or 1)).astype(np.int32))

    def done(key, fp, co) -> pa.RecordBatch:
        links: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        may = (np.abs(co[two] - co[two + 1]) <= NEAR).all(axis=1)
        two = two[may]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= NEAR]
        links += [(max(a, b), min(a, b)) for a, b in zip(fp[two].tolist(), fp[two + 1].tolist())]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            links += block_links(fp[s : s + n], co[s : s + n])
        return out(np.array(links, np.uint64).reshape(-1, 2).view(np.int64), key[:0], fp[:0], co[:0], key[:0])

    for b in batches:
        key = b.column(0).to_numpy()
        fp = b.column(1).to_numpy().view(np.uint64)
        co = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(-1, PIVOTS)
        if hot is not None:
            k = int(np.searchsorted(key, hot, "right"))
            if k:
                yield passed_on(key[:k], fp[:k], co[:k])
                seen += k
                key, fp, co = key[k:], fp[k:], co[k:]
        if not len(key):
            continue
        hot = None
        if rest:
            key, fp, co = np.r_[rest[0], key], np.r_[rest[1], fp], np.r_[rest[2], co]
        cut = int(np.searchsorted(key, key[-1]))  # the last block may go on
        if cut:
            yield done(key[:cut], fp[:cut], co[:cut])
        rest = (key[cut:], fp[cut:], co[cut:])
        if limit and len(rest[0]) > limit:
            hot, seen = int(rest[0][0]), 0
            yield passed_on(*rest)
            seen, rest = len(rest[0]), None
    if rest:
        yield done(*rest)


def _coords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pivot_table(b.column(0).to_numpy().view(np.uint64))
        yield pa.record_batch([b.column(0), pa.array([x.tobytes() for x in t], pa.binary())], ["fp", "coords"])


def links(fps: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct fp -> (u, v) links that join all fingerprints within NEAR bits, v the least (as unsigned) of its block's component; a written table.

    A block of over `limit` (BLOCK_ROWS) fingerprints is cut into chunks, and each pair of chunks searched as a block of its own.
    """
    limit = limit or BLOCK_ROWS
    part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in SEGMENTS]
    keys = [F.shiftleft(F.lit(i).cast("long"), 22).bitwiseOR(F.shiftleft(part[a], 11)).bitwiseOR(part[b])
            for i, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2))]
    rows = fps.mapInArrow(_coords, "fp long, coords binary").select(F.explode(F.array(*keys)).alias("key"), "fp", "coords")

    def searched(rows: DataFrame, limit: int | None) -> DataFrame:
        rows = rows.select("key", "fp", "coords").repartition("key").sortWithinPartitions("key", "fp")
        return rows.mapInArrow(lambda x: _search(x, limit), "u long, v long, key long, fp long, coords binary, chunk int")

    found = materialize(searched(rows, limit), "links")
    pairs = found.filter("u is not null").select("u", "v")
    hot = found.filter("key is not null").select("key", "fp", "coords", "chunk")
    n = hot.count()
    if n:
        chunks = hot.groupBy("key").agg((F.max("chunk") + 1).alias("chunks"), F.count("*").alias("n"))
        each = skew_join(hot, chunks, ["key"], "n", hot_limit(n), "fp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        # two pairs of chunks that share a hash are searched as one block, which finds the same links
        own = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
        pairs = pairs.unionByName(searched(each.withColumn("key", own), None).select("u", "v"))
    return materialize(pairs.distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), a written table -> node, root: the least node reachable. Alternating large and small stars."""
    while True:
        last = edges
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")
        edges = materialize(_star(both, large=True), "stars")
        edges = materialize(_star(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), large=False), "stars")
        # both are sets: of equal size and without a new edge, they are the same
        if edges.count() == last.count() and edges.join(last, ["u", "v"], "left_anti").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _star(e: DataFrame, large: bool) -> DataFrame:
    e = e.distinct()
    e = materialize(e.withColumn("id", F.monotonically_increasing_id()), "star-rows")
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    j = skew_join(e, least, ["u"], "n", hot_limit(e.count()), "id").withColumn("m", F.least("u", "m"))
    if large:
        return j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    star = j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return star.union(j.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """uid, doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), kept (one row a component).

    docs: uid (unique long), doc_id, text. Null and empty texts have fingerprint zero and link like others. A null
    doc_id counts only where a component has no other; of repeated rows the one with the least uid stays.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    n = prints.count()
    order = F.struct(F.col("doc_id").isNull().alias("__null"), "doc_id", "uid")
    fps = materialize(prints.groupBy("fp").agg(F.min(order).alias("rep"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = materialize(rooted.select("fp", "n", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    heads = rooted.groupBy("root").agg(F.min("rep").alias("head"), F.count("*").alias("__fps"))
    heads = skew_join(rooted, heads, ["root"], "__fps", hot_limit(n), "fp").select("fp", "n", "head")
    joined = skew_join(prints, materialize(heads, "heads"), ["fp"], "n", hot_limit(n), "uid")
    return joined.select("uid", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         F.col("head.doc_id").alias("component_id"), (F.col("uid") == F.col("head.uid")).alias("kept"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = with_uid(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return near_groups(docs).select("doc_id", "fingerprint", "component_id")


def drop_near(docs: DataFrame) -> DataFrame:
    """docs (any further columns) with one document of each component: that with the least doc_id."""
    def run(d: DataFrame) -> DataFrame:
        tagged = with_uid(d, "__row")
        kept = near_groups(tagged.select(F.col("__row").alias("uid"), "doc_id", "text")).filter("kept")
        return tagged.join(kept.select(F.col("uid").alias("__row")), "__row", "left_semi")

    return shielded(docs, ("doc_id", "text"), run)

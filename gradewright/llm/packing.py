"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Lengths lie in 1 .. CAPACITY, so their histogram is bounded whatever the number of documents. On it, lengths over a
third of the capacity are matched first, largest first, each with the largest partner that fits (at most two a bin);
the smaller ones then go, largest first, into the smallest gap that takes them. Every step moves a whole run of equal
bins, so the plan is a small table of segments: (length, ranks) -> (bins, offset). Each piece gets its rank among the
pieces of its length, by counts of hash buckets, and looks up its bin. No documents meet in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, hash_bucket, materialize, position_in_group
from .idruns import Classes, IdTable, buffers, flat, groups, lists, release, runs, sliced, strings

CAPACITY = 2048
NONE = np.int64(1 << 40)
#: These bound a worker's memory and no result: rows that Spark sends at a time, bytes of texts encoded at a time, bytes
#: of new strings tokenised at a time (the arrays take about a hundred times that), strings and their bytes in a table.
ROWS, GROUP, SLICE, ENTRIES, BYTES = 1000, 4_000_000, 1 << 17, 500_000, 1 << 24
#: The library cuts a text at its special tokens first, in the text as it is.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = re.compile("|".join(map(re.escape, SPECIAL)).encode())
_engines: dict[str, WordCache] = {}


class WordCache:
    """Ids of texts as the tokenizers library gives them, cached by the parts between spaces and line feeds.

    The vocabulary's normaliser composes, folds white space and lower-cases character by character, and its splitter
    drops white space; so the ids of a text are those of its parts, one after another. Parts of printable Latin-1
    characters, which composing leaves alone, are split and merged here, many at a time; the library does all others,
    special tokens among them.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that the byte level shows as themselves
        rest = [b for b in range(256) if b not in set(shown)]
        name = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = np.array([vocab[name[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[name[b] + end] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 17 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_keys, self.pair_ranks = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.first = self.ranks(np.repeat(self.inner, 512), np.tile(np.r_[self.inner, self.final], 256)).reshape(256, 512)
        self.classes = Classes(regex)
        self.words = IdTable(sliced(self.merge, SLICE), ENTRIES, BYTES)
        self.parts = IdTable(sliced(self.learn, SLICE), ENTRIES, BYTES)

    @classmethod
    def load(cls, path: str) -> WordCache:
        if path not in _engines:
            _engines[path] = cls(path)
        return _engines[path]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 17 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge(self, words: pa.Array) -> pa.Array:
        """The ids of each (non-empty) word: in each round every word takes its first pair of least rank."""
        raw, at = buffers(words)
        if not len(words):
            return lists(raw, at)
        lengths, last = np.diff(at), at[1:] - 1
        token = self.inner[raw]
        token[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(raw), NONE)
        right = raw.astype(np.int64)
        right[last] += 256
        rank[:-1] = np.where(word[1:] == word[:-1], self.first[raw[:-1], right[1:]], NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            goes_on = np.repeat(least < NONE, sizes)
            done.append((word[~goes_on], token[~goes_on]))
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & goes_on)
            hit = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]] if len(hit) else hit
            token[hit] = self.merged[rank[hit]]
            keep = goes_on
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1
            word, token, rank = word[keep], token[keep], rank[keep]
            for at in (new, new - 1):
                at = at[at >= 0]
                end = at + 1 >= len(word)
                nxt = np.where(end, at, at + 1)
                same = ~end & (word[nxt] == word[at])
                rank[at] = np.where(same, self.ranks(token[at], token[nxt]), NONE)
        word = np.concatenate([w for w, _ in done])
        ids = np.concatenate([t for _, t in done])[np.argsort(word, kind="stable")]
        return lists(ids, np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))])

    def learn(self, parts: pa.Array) -> pa.Array:
        """The ids of each (distinct) part, which a space may lead."""
        raw, at = buffers(parts)
        owner = np.repeat(np.arange(len(parts)), np.diff(at))
        shown = raw != 0x20
        raw, owner = raw[shown], owner[shown]
        after = np.r_[0, raw[:-1]]  # the byte before; of the first byte of a part it does not count
        odd = (raw < 0x20) | (raw == 0x7F) | (raw >= 0xC4) | (after == 0xC2) & (raw >= 0x80) & ((raw <= 0xA0) | (raw == 0xAD))
        odd[1:] |= (raw[1:] == 0x7C) & (raw[:-1] == 0x3C)  # "<|"
        plain = np.bincount(owner[odd], minlength=len(parts)) == 0
        sizes = np.bincount(owner, minlength=len(parts))
        ours = plain[owner]
        low = raw[ours]
        after = after[ours]
        low = low + np.where((low >= 0x41) & (low <= 0x5A) | (after == 0xC3) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), 0x20, 0).astype(np.uint8)
        sizes_ours = sizes[plain & (sizes > 0)]
        cuts, counts = runs(low, np.r_[0, np.cumsum(sizes_ours)], self.classes, self.split.findall, b"'", True)
        ids, ends = flat(self.words.find(strings(low, cuts)))
        n_ids = np.zeros(len(parts), np.int64)
        n_ids[plain & (sizes > 0)] = np.diff(ends[np.r_[0, np.cumsum(counts)]])
        if plain.all():
            return lists(ids, np.r_[0, np.cumsum(n_ids)])
        rest = raw[~ours].tobytes()
        ends = np.r_[0, np.cumsum(sizes[~plain])].tolist()
        found = [e.ids for e in self.tokenizer.encode_batch([rest[a:b].decode() for a, b in zip(ends, ends[1:])], add_special_tokens=False)]
        n_ids[~plain] = [len(x) for x in found]
        out = np.empty(n_ids.sum(), np.int32)
        mine = np.repeat(plain, n_ids)
        out[mine] = ids
        out[~mine] = [i for x in found for i in x]
        return lists(out, np.r_[0, np.cumsum(n_ids)])

    def encode_bytes(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (raw cut at the offsets), without the end mark, and the offsets of each text's in them."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        raw = np.where(raw == 0x0A, np.uint8(0x20), raw)
        cut = np.append(raw == 0x20, True)
        edge = np.zeros(len(cut), bool)
        edge[at] = True
        for m in _SPECIAL.finditer(raw):
            if not edge[m.start() + 1 : m.end()].any():
                cut[[m.start(), m.end()]] = True
        cuts = np.flatnonzero(cut | edge)
        ids, ends = flat(self.parts.find(strings(raw, cuts)))
        return ids, ends[np.searchsorted(cuts, at)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without the end mark."""
        ids, ends = self.encode_bytes(*buffers(pa.array(texts, pa.string())))
        ids, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's ids with the end mark 0, cut at capacity.

    Null and empty texts give one piece, the end mark; repeated rows give repeated pieces; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = WordCache.load(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        for b in batches:
            for doc_ids, raw, at in groups(b, GROUP):
                ids, ends = engine.encode_bytes(raw, at)
                ends = ends + np.arange(len(ends))
                marked = np.zeros(ends[-1], "<u4")
                own = np.ones(ends[-1], bool)
                own[ends[1:] - 1] = False
                marked[own] = ids
                parts = -(-np.diff(ends) // capacity)
                doc = np.repeat(np.arange(len(parts)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(np.diff(ends)[doc] - start, capacity)
                first = ends[doc] + start
                data = memoryview(marked.view(np.uint8))
                crc = [zlib.crc32(data[4 * f : 4 * (f + n)]) for f, n in zip(first.tolist(), length.tolist())]
                columns = [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(lists(marked, np.append(first, ends[-1])))
                yield pa.record_batch(columns, names)
                del raw, at, ids, ends, marked, own, data, crc, columns
                release()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Segments (length, first rank, items a bin, first bin, offset) sorted by length and rank; bins are numbered from 0."""
    left = dict(histogram)
    used = dict.fromkeys(histogram, 0)  # the next rank of each length
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first bin, bins)
    order: list[int] = []  # gaps that have runs

    def put(length: int, per_bin: int, first: int, count: int, offset: int, items: int) -> None:
        out.append((length, used[length], per_bin, first, offset))
        used[length] += items
        left[length] -= items
        gap = capacity - offset - per_bin * length
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n] > 0:
            partner = next((p for p in large if p <= min(n, capacity - n) and left[p] >= (2 if p == n else 1)), None)
            if partner is None:
                count = left[n]
                put(n, 1, bins, count, 0, count)
            elif partner == n:
                count = left[n] // 2
                put(n, 2, bins, count, 0, 2 * count)
            else:
                count = min(left[n], left[partner])
                out.append((n, used[n], 1, bins, 0))
                used[n] += count
                left[n] -= count
                put(partner, 1, bins, count, n, count)
            bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n] > 0:
            i = bisect_left(order, n)
            if i == len(order):
                gap, first, count = capacity, bins, max(1, left[n] // (capacity // n))
                bins += count
            else:
                gap = order[i]
                first, count = gaps[gap].pop()
            per_bin = gap // n
            full = min(count, left[n] // per_bin)
            rest = left[n] - full * per_bin if full < count else 0
            if i < len(order) and not gaps.get(gap, [1]):
                del gaps[gap]
                order.remove(gap)
            if full:
                put(n, per_bin, first, full, capacity - gap, full * per_bin)
            if rest:
                put(n, rest, first + full, 1, capacity - gap, rest)
            untouched = count - full - bool(rest)
            if untouched:  # its gap is as before
                if gap not in gaps:
                    gaps[gap] = []
                    insort(order, gap)
                gaps[gap].append((first + full + bool(rest), untouched))
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, length, further columns; a written table) with sequence_id and offset.

    Ties (equal doc_id and piece) take any order. An empty table gives no rows. Only the histogram goes to the driver.
    """
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    table = plan(histogram, capacity)
    key = (table[:, 0] << 40) + table[:, 1]
    kept = rows.columns
    bucketed = rows.withColumn("__h", F.xxhash64("doc_id", "piece")).withColumn("__bucket", hash_bucket(F.col("__h")))
    ranked = position_in_group(bucketed, ["length"], "__bucket", [F.col("__h"), F.col("doc_id"), F.col("piece")], "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            s = table[np.searchsorted(key, (length << 40) + rank, "right") - 1] if len(length) else table[:0]
            n = rank - s[:, 1]
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(s[:, 3] + n // np.maximum(s[:, 2], 1)),
                                   pa.array(s[:, 4] + n % np.maximum(s[:, 2], 1) * length)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.select(*kept, "__rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The pieces of docs (doc_id, text; further columns are not kept, since a piece is no document) with sequence_id and offset."""
    import public_tokenizers as P

    with batches_of(docs.sparkSession, ROWS):
        found = materialize(pieces(docs, P.path("word_bpe_49k.json")), "pieces")
    return packed(found)

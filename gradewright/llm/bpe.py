"""Byte-level BPE by corpus-level merge replay.

A task splits its texts into pieces and keeps the pieces it has not met. An inverted index maps each token pair's rank
to the places where that pair stands in those pieces; ranks are popped in order, and each merge touches only its two
neighbours. Ids, their decimal text and their bytes are then looked up for every document. A piece that is itself a token is that
token, as in the tiktoken library. A merge that makes a pair of lower rank puts off the rest of its piece, since the
library would take the lower rank first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idruns import Classes, IdTable, buffers, flat, groups, lists, runs, strings

_engines: dict[tuple[str, str], MergeReplay] = {}
#: Bytes that are surely no part of a white space character (Unicode's) that they follow, or begin; and lead bytes of such
#: characters of two, three and four bytes. A byte left out only makes a longer chunk.
_byte = np.arange(256)
_ASCII = (_byte > 0x20) & (_byte < 0x80)
_TWO, _THREE, _FOUR = (_byte >= 0xC3) & (_byte < 0xE0), (_byte == 0xE0) | (_byte >= 0xE4) & (_byte < 0xF0), _byte >= 0xF0
_BEGINS = _ASCII | _TWO | _THREE | _FOUR


class _Partners:
    """For a token, the tokens that it merges with on one side, and their merges."""

    def __init__(self, tokens: np.ndarray, partners: np.ndarray, merges: np.ndarray) -> None:
        order = np.lexsort((partners, tokens))
        self.partners, self.merges = partners[order], merges[order]
        self.first = np.searchsorted(tokens[order], np.arange(1 << 17 | 1)).tolist()

    def of(self, token: int, partners: np.ndarray) -> np.ndarray:
        """The ranks of the merges of token with each, -1 where there is none."""
        a, b = self.first[token], self.first[token + 1]
        if a == b:
            return np.full(len(partners), -1)
        at = np.minimum(np.searchsorted(self.partners[a:b], partners), b - a - 1) + a
        return np.where(self.partners[at] == partners, self.merges[at], -1)


#: A rank with fewer places is merged place by place, others all at once.
FEW = 16


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        #: id of left << 17 | id of right -> id of their merge, for all splits of all tokens
        self.pairs = {ranks[t[:i]] << 17 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)])
        self.byte_pairs = np.array([[self.pairs.get(int(a) << 17 | int(b), -1) for b in self.byte_ids] for a in self.byte_ids])
        keys, merges = np.array(list(self.pairs), np.int64).reshape(-1), np.array(list(self.pairs.values()), np.int64)
        left, right = keys >> 17, keys & (1 << 17) - 1
        self.by_left, self.by_right = _Partners(left, right, merges), _Partners(right, left, merges)
        self.classes = Classes(regex)
        self.pieces = IdTable(self.replayed)
        self.chunks = IdTable(self.joined)
        top = max(self.bytes_of) + 1
        self.shown = pa.array([f"{i} ".encode() for i in range(top)], pa.large_binary())
        self.raw = pa.array([self.bytes_of.get(i) for i in range(top)], pa.large_binary())

    @classmethod
    def load(cls, path: str, pattern: str) -> MergeReplay:
        if (path, pattern) not in _engines:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
            _engines[path, pattern] = cls(ranks, pattern)
        return _engines[path, pattern]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, by merges in rank order over all pieces at once, and the number of ids of each."""
        lengths = np.array([len(x) for x in pieces], np.int64)
        if not lengths.sum():
            return np.zeros(0, np.int64), lengths
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        inside = owner[1:] == owner[:-1]
        rank, after, before = np.full((3, n), -1)
        rank[:-1] = np.where(inside, self.byte_pairs[raw[:-1], raw[1:]], -1)
        after[:-1] = np.where(inside, np.arange(1, n), -1)
        before[1:] = np.where(inside, np.arange(n - 1), -1)
        token = self.byte_ids[raw]
        tangled = np.zeros(len(pieces), bool)
        # the inverted index: rank of a pair -> the places of its left token
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        merge_of, pop, push = self.pairs.get, heapq.heappop, heapq.heappush

        def note(ranks: np.ndarray, places: np.ndarray) -> None:
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            first = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]][: len(ranks)])
            ends = first.tolist()[1:] + [len(ranks)]
            for r, a, b in zip(ranks[first].tolist(), first.tolist(), ends):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    push(heap, r)

        def one_by_one(r: int, todo: list[int], token, rank, after, before, owner) -> None:
            late: set[int] = set()
            wait: list[int] = []
            for p in todo:
                if rank[p] != r:
                    continue
                if late and owner[p] in late:
                    wait.append(p)
                    continue
                q = after[p]
                token[p] = r
                token[q] = rank[q] = -1
                after[p] = x = after[q]
                if x >= 0:
                    before[x] = p
                    new = merge_of(r << 17 | token[x], -1)
                    rank[p] = new
                else:
                    new = rank[p] = -1
                a, at = before[p], p
                while True:
                    if new >= 0:
                        if new in index:
                            index[new].append(np.array([at]))
                        elif new == r:
                            wait.append(at)
                        else:
                            index[new] = [np.array([at])]
                            push(heap, new)
                        if new < r:
                            late.add(owner[p])
                    if a < 0:
                        break
                    new = rank[a] = merge_of(token[a] << 17 | r, -1)
                    at, a = a, -1
            if wait:
                index[r] = [np.array(wait)]
                push(heap, r)

        views = [memoryview(x) for x in (token, rank, after, before, owner)]
        note(rank, np.arange(n))
        while heap:
            r = pop(heap)
            todo = index.pop(r, None)
            if todo is None:
                continue
            p = np.concatenate(todo) if len(todo) > 1 else todo[0]
            if len(p) < FEW:
                one_by_one(r, sorted(p.tolist()), *views)
                continue
            p = np.unique(p[rank[p] == r])
            q, a = after[p], before[p]
            x = after[q]
            right = np.where(x >= 0, self.by_left.of(r, token[x]), -1)
            left = np.where(a >= 0, self.by_right.of(r, token[a]), -1)
            # merges that touch each other, or make a pair that is not of a higher rank, depend on their order
            order = (rank[q] == r) | (x >= 0) & (rank[x] == r) | (right >= 0) & (right <= r) | (left >= 0) & (left <= r)
            if order.any():
                owners = owner[p[order]]
                tangled[owners] = True
                slow = tangled[owner[p]]
                tangled[owners] = False
                one_by_one(r, p[slow].tolist(), *views)
                p, q, a, x, right, left = (y[~slow] for y in (p, q, a, x, right, left))
            token[p], token[q], rank[q] = r, -1, -1
            after[p], before[x[x >= 0]] = x, p[x >= 0]
            rank[p], rank[a[a >= 0]] = right, left[a >= 0]
            note(np.r_[right, left], np.r_[p, a])
        alive = token >= 0
        return token[alive], np.bincount(owner[alive], minlength=len(pieces))

    def replayed(self, pieces: pa.Array) -> pa.Array:
        """The ids of each (distinct) piece."""
        pieces = pieces.to_pylist()
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        merged, counts = self.replay([p for p, r in zip(pieces, whole.tolist()) if r < 0])
        sizes = np.ones(len(pieces), np.int64)
        sizes[whole < 0] = counts
        ids = np.repeat(whole, sizes)
        ids[ids < 0] = merged
        return lists(ids, np.r_[0, np.cumsum(sizes)])

    def joined(self, chunks: pa.Array) -> pa.Array:
        """The ids of each (distinct) chunk, those of its pieces one after another."""
        raw, at = buffers(chunks)
        cuts, counts = runs(raw, at, self.classes, self.pattern.findall, b"'", False)
        ids, ends = flat(self.pieces.find(strings(raw, cuts)))
        return lists(ids, ends[np.r_[0, np.cumsum(counts)]])

    def encode_bytes(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (raw cut at the offsets) and the offsets of each text's in them.

        A text is cut before each single space, and around each single line feed, between two characters that are not
        white space: pieces never cross there.
        """
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        for byte in (0x20, 0x0A):
            i = np.flatnonzero(raw == byte)
            i = i[~cut[i] & ~cut[i + 1]]
            ends = _ASCII[raw[i - 1]] | _TWO[raw[i - 2]] | _THREE[raw[i - 3]] | _FOUR[raw[i - 4]]
            yes = i[_BEGINS[raw[i + 1]] & ends]
            cut[yes] = True
            if byte == 0x0A:
                cut[yes + 1] = True
        cuts = np.flatnonzero(cut)
        ids, ends = flat(self.chunks.find(strings(raw, cuts)))
        return ids, ends[np.searchsorted(cuts, at)]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_bytes(raw, np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, ids: np.ndarray, at: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of the decimal ids, and of the decoded bytes, of each run of ids."""
        out = []
        for table, gap in ((self.shown, 1), (self.raw, 0)):
            data, ends = buffers(table.take(pa.array(ids)))
            ends = ends[at].tolist()
            out.append([hashlib.sha256(data[a : max(a, b - gap)]).hexdigest() for a, b in zip(ends, ends[1:])])
        return out[0], out[1]


#: Bytes of text that a task encodes at a time, at the least.
GROUP = 8_000_000


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids themselves.

    Null texts count as empty: no tokens, digests of no bytes. Repeated rows give repeated rows; order does not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = MergeReplay.load(path, pattern)
        for b in batches:
            for doc_ids, raw, at in groups(b, GROUP):
                ids, ends = engine.encode_bytes(raw, at)
                columns = [doc_ids, pa.array(np.diff(ends), pa.int64()), *map(pa.array, engine.digests(ids, ends))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(lists(ids, ends))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

"""Token ids of very many short strings, held as Arrow arrays: no Python object a string, and little memory an entry.

A task's strings are told apart by dictionary encoding, the distinct ones looked up in a table that the worker keeps,
and only those that the table lacks are tokenised. Texts lie one after another in a buffer of UTF-8 with their offsets.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Strings, and their bytes, that a table keeps at most; beyond, it keeps those of the current call (only speed depends on it).
ENTRIES, BYTES = 1_500_000, 1 << 27
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array one after another, and its offsets in them from 0; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, len(column) + 1, 8 * column.offset) if at else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def groups(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The rows of batch (doc_id, text) in turn: doc_ids, and buffers() of their texts, of `size` bytes if so many are left."""
    raw, at = buffers(batch.column(1))
    first = 0
    while first < batch.num_rows:
        last = min(int(np.searchsorted(at, at[first] + size)), batch.num_rows)
        last = max(last, first + 1)
        yield batch.column(0).slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """The binary array of raw cut at the offsets."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])


def lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The array of int lists of ids cut at the offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists() and their offsets."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the system; Arrow's pool and the C library keep it for the worker otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def sliced(make: Callable[[pa.Array], pa.Array], size: int) -> Callable[[pa.Array], pa.Array]:
    """make, called on `size` bytes of strings at a time (a longer string by itself): its arrays are many times its input."""

    def run(values: pa.Array) -> pa.Array:
        at = buffers(values)[1]
        out, first = [], 0
        while first < len(values):
            last = max(int(np.searchsorted(at, at[first] + size, "right")) - 1, first + 1)
            out.append(make(values.slice(first, last - first)))
            first = last
        return pa.concat_arrays(out) if out else make(values)

    return run


class IdTable:
    """The ids of strings; those of new strings come from make(distinct strings), as lists()."""

    def __init__(self, make: Callable[[pa.Array], pa.Array], entries: float = np.inf, size: float = np.inf) -> None:
        """entries, size: lower limits of this table than ENTRIES and BYTES."""
        self.make, self.entries, self.size = make, entries, size
        self.keys = pa.array([], pa.binary())
        self.ids = pa.array([], pa.list_(pa.int32()))

    def find(self, values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        distinct = coded.dictionary
        at = pc.fill_null(pc.index_in(distinct, value_set=self.keys), -1).to_numpy().copy()
        unknown = at < 0
        if unknown.any():
            new = distinct.filter(pa.array(unknown))
            made = self.make(new)
            if len(self.keys) + len(new) > min(ENTRIES, self.entries) or self.keys.nbytes + new.nbytes > min(BYTES, self.size):
                known = pa.array(at[~unknown])
                self.keys, self.ids = self.keys.take(known), self.ids.take(known)
                at[~unknown] = np.arange(len(known))
            at[unknown] = len(self.keys) + np.arange(len(new))
            self.keys, self.ids = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.ids, made])
        return self.ids.take(pa.array(at).take(coded.indices))


class Classes:
    """Letter, number, white space or other, of code points, as a pattern's own engine tells them."""

    def __init__(self, engine) -> None:
        self.is_a = [engine.compile(x).match for x in (r"\p{L}", r"\p{N}", r"\s")]
        self.table = np.full(0x110000, UNKNOWN, np.uint8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        if (found == UNKNOWN).any():
            for c in np.unique(codes[found == UNKNOWN]).tolist():
                self.table[c] = next((k for k, is_a in enumerate(self.is_a) if is_a(chr(c))), OTHER)
            found = self.table[codes]
        return found


def runs(raw: np.ndarray, at: np.ndarray, classes: Classes, findall: Callable[[str], list[str]], odd: bytes, single_numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the pieces of strings (not empty), and the number of pieces of each.

    A string of one optional leading space and no other white space is cut where the class changes, the space staying
    with what follows, and single_numbers also before and after each number. A string that holds a byte of `odd` or white
    space elsewhere is cut as findall cuts it.
    """
    text = raw.tobytes().decode()
    first = (raw & 0xC0) != 0x80
    where = np.flatnonzero(first)  # the first byte of each character
    heads = np.searchsorted(where, at[:-1])  # the first character of each string
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cls = classes.of(codes)
    start = np.r_[True, cls[1:] != cls[:-1]][: len(cls)]
    if single_numbers:
        start |= cls == NUMBER
    start[heads] = True
    sizes = np.diff(np.r_[heads, len(codes)])
    led = heads[(codes[heads] == 0x20) & (sizes > 1)]
    start[led + 1] = False
    spaces = cls == SPACE
    spaces[led] = False
    spaces[heads[sizes == 1]] = False
    for b in odd:
        spaces |= codes == b
    irregular = np.add.reduceat(spaces, heads, dtype=np.int64) > 0 if len(heads) else np.zeros(0, bool)
    cuts = where[start & ~np.repeat(irregular, sizes)]
    if irregular.any():
        ends = heads + sizes
        more: list[int] = []
        for i in np.flatnonzero(irregular).tolist():
            p = int(at[i])
            for piece in findall(text[heads[i] : ends[i]]):
                more.append(p)
                p += len(piece.encode())
        cuts = np.sort(np.r_[cuts, np.array(more, np.int64)])
    counts = np.diff(np.searchsorted(cuts, at))
    return np.r_[cuts, len(raw)], counts

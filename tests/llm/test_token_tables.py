"""The tokenisers against their libraries on drawn texts, and what they merge a second time."""

import itertools
import os
import random
import string
import subprocess
import sys

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from gradewright.llm import bpe, common, idruns, packing  # noqa: E402

MARKS = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", " ", "　", "'s", "'t", ".", ",", "$$", "²", "Ⅷ", "́", "\xad", "\x7f", "\x00", "<|"]
BITS = [*"abcxyzABCéÈßñµ0189жΩ中文한अ𝔘🤖’…", "ing", "onon", "aaaa", "----"]


def drawn(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(MARKS) if rng.random() < odd else rng.choice(" \n") if rng.random() < 0.2 else rng.choice(BITS) for _ in range(rng.choice((1, 3, 30, 200))))
            for odd in (0, 0.02, 0.2, 0.8) for _ in range(n)]


def words(n):
    return ["".join(w) for w in itertools.islice(itertools.product(string.ascii_lowercase, repeat=4), n)]


def merged(monkeypatch, kind, name):
    """The number of words that each call of kind.name gets."""
    counts, inner = [], getattr(kind, name)
    monkeypatch.setattr(kind, name, lambda self, w: counts.append(len(w)) or inner(self, w))
    return counts


@pytest.mark.parametrize("few", [1, 16, 10**9])
def test_bpe_drawn(monkeypatch, few):
    import tiktoken

    monkeypatch.setattr(bpe, "FEW", few, raising=False)
    engine = bpe.MergeReplay(bpe.MergeReplay.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=engine.ranks, special_tokens={})
    rng = random.Random(few)
    texts = [*drawn(few, 60), *[" ".join("".join(rng.choices(a, k=rng.randint(1, 30))) for _ in range(800)) for a in ("ab", "ann", "0123", "éèa", "-=")]]
    assert [engine.encode(t) for t in texts] == [lib.encode_ordinary(t) for t in texts]


def test_bpe_merges_words_once(monkeypatch):
    counts = merged(monkeypatch, bpe.MergeReplay, "replay")
    engine = bpe.MergeReplay(bpe.MergeReplay.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks, P.PATTERN)
    w = words(440_000)
    one, two = [[w[j : j + 1000] for j in range(i, i + 220_000, 1000)] for i in (0, 220_000)]
    for lines in (one, two):
        assert len(engine.encode(" ".join(map(" ".join, lines)))) > 220_000
    met = sum(counts)
    engine.encode("\n".join(map(" ".join, one)))  # the same words, those that begin a line without their space
    assert met > 400_000 and sum(counts) - met < 220


@pytest.mark.parametrize("entries", [1, 300, 10**6])
def test_packing_drawn(monkeypatch, entries):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, engine = Tokenizer.from_file(path), packing.WordCache(path)
    monkeypatch.setattr(idruns, "ENTRIES", entries)
    texts = [*drawn(entries, 60), "a<|end", "oftext|>b", "<|endoftext|>\u0301", "it<|startoftext|>'s", "", "İ K Å <|EndOfText|>", "x" * 5000]
    for some in (texts, texts[::-1], texts[::3]):
        assert [np.frombuffer(x, "<u4").tolist() for x in engine.encode(some)] == [lib.encode(t, add_special_tokens=False).ids for t in some]


def test_packing_merges_words_once(monkeypatch):
    counts = merged(monkeypatch, packing.WordCache, "merge")
    engine = packing.WordCache(P.path("word_bpe_49k.json"))
    w = words(440_000)
    one, two = " ".join(w[:220_000]), " ".join(w[220_000:])
    for text in (one, two, one):
        assert len(engine.encode([text])[0]) >= 4 * 220_000
    assert 440_000 <= sum(counts) < 440_100


@pytest.mark.parametrize("size", [1, 40])
def test_packing_in_slices(monkeypatch, size):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "SLICE", size)
    monkeypatch.setattr(packing, "ENTRIES", 50)
    lib, engine = Tokenizer.from_file(path), packing.WordCache(path)
    texts = [*drawn(size, 20), "", "x" * 500, " ".join(words(300))]
    for some in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in engine.encode(some)] == [lib.encode(t, add_special_tokens=False).ids for t in some]


def test_packing_memory_of_new_words():
    """A worker that meets 4 MB of words for the first time; an executor holds two of them beside its JVM."""
    code = r"""
import itertools, re, string
import public_tokenizers as P
from gradewright.llm import packing
def peak():
    return int(re.search(r"VmHWM:\s+(\d+)", open("/proc/self/status").read()).group(1)) // 1024
engine = packing.WordCache(P.path("word_bpe_49k.json"))
text = " ".join("".join(w) * 2 for w in itertools.islice(itertools.product(string.ascii_lowercase, repeat=4), 440_000))
before = peak()
assert len(engine.encode([text])[0]) > 4 * 440_000
print(peak() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120, check=True)
    assert int(out.stdout) < 200


def test_batches_of(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    seen = lambda: spark.range(100, numPartitions=1).mapInArrow(lambda x: (b.slice(0, 1).set_column(0, "n", packing.pa.array([b.num_rows])) for b in x), "n long").collect()
    with common.batches_of(spark, 30):
        assert [r.n for r in seen()] == [30, 30, 30, 10]
        with common.batches_of(spark, 50):
            assert spark.conf.get(key) == "30"
    assert spark.conf.get(key) == before
    with pytest.raises(ValueError), common.batches_of(spark, 30):
        raise ValueError
    assert [r.n for r in seen()] == [100]

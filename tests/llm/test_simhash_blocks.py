"""Blocks too large for one task: the links by pairs of chunks join the same fingerprints."""

import numpy as np
import pytest

from gradewright.llm import simhash


@pytest.mark.parametrize("limit", [3, 10_000])
def test_chunks(spark, limit):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**64, 3, dtype=np.uint64)
    flips = lambda k: np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in range(60)], np.uint64)
    fps = np.unique(np.concatenate([s ^ flips(k) for s in seeds for k in (1, 2, 3)] + [rng.integers(0, 2**64, 50, dtype=np.uint64)]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(table, limit)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.NEAR
    signed = fps.view(np.int64)
    label = signed.copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    want = {int(x): int(r) for x, r, n in zip(signed, label, near.sum(axis=1)) if n > 1}
    assert {k: v for k, v in got.items()} | {v: v for v in got.values()} == want


def test_no_links(spark):
    empty = spark.createDataFrame([], "fp long")
    assert simhash.components(simhash.links(empty)).count() == 0

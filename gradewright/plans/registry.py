"""All queries of the evaluation engine with their SQL.

Doubles are published at six digits on both sides. A seventh digit of exactly five goes up by a margin of 1e-9, far over
the error of a sum, so the order of summation can't decide it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import evaluation, frames, motion, reporting, statistics, tables, worlds

TIE = 1e-9
MODULES = (evaluation, motion, tables, statistics, reporting, frames, worlds)


def _rounded(fn):
    def run(spark, sf_dir):
        df = fn(spark, sf_dir)
        return df.select(*[(F.round(F.col(c) + TIE, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    return run


def queries() -> dict:
    return {name: _rounded(fn) for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from gradewright.sources.domain import CTES

    out = {}
    for m in MODULES:
        for name, (doubles, sql) in m.ORACLES.items():
            swap = ", ".join(f"round({c}::DOUBLE + {TIE}::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            out[name] = f"WITH {CTES},\nresult AS ({sql})\nSELECT * {f'REPLACE ({swap})' if swap else ''} FROM result"
    return out

"""Upgrades of stored records: one DataFrame step a version, all rows of any mix of versions in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.errors import SpecError

Step = Callable[[DataFrame], DataFrame]
CURRENT = {name: 1 for name in ("task_spec", "rollout", "demo_set", "grounded", "gate_report", "grade_card", "leaderboard", "manifest")}


class Upgrades:
    def __init__(self, current: dict[str, int] | None = None) -> None:
        self.current = dict(CURRENT if current is None else current)
        self.steps: dict[tuple[str, int], Step] = {}

    def step(self, model: str, version: int) -> Callable[[Step], Step]:
        """Decorator of the step from `version` to the next; it sees only rows of that version."""
        if (model, version) in self.steps:
            raise SpecError(f"{model} has a step from version {version} already")

        def put(fn: Step) -> Step:
            self.steps[model, version] = fn
            return fn

        return put

    def apply(self, model: str, df: DataFrame) -> DataFrame:
        """df (schema_version; null counts as 1) at the current version. A newer row, or a version without a step, fails the query."""
        if model not in self.current:
            raise SpecError(f"{model!r} is not a stored model")
        target = self.current[model]
        lack = [v for v in range(1, target) if (model, v) not in self.steps]
        version = F.coalesce("schema_version", F.lit(1))
        bad = (version > target) | version.isin(lack) if lack else version > target
        said = F.concat(F.lit(f"{model} record of schema_version "), version.cast("string"), F.lit(f": only up to {target} is known"))
        df = df.withColumn("schema_version", F.when(bad, F.raise_error(said).cast("int")).otherwise(version))
        for v in range(1, target):
            if v in lack:
                continue
            done = self.steps[model, v](df.filter(F.col("schema_version") == v)).withColumn("schema_version", F.lit(v + 1))
            df = df.filter(F.col("schema_version") != v).unionByName(done, allowMissingColumns=True)
        return df

"""Content-addressed tables: a key names stage, component, version, inputs and parameters; an entry is written once."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from gradewright.errors import StoreError


def digest(value) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces, finite numbers."""
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError) as error:
        raise StoreError(f"not canonical JSON: {error}") from error
    return hashlib.sha256(text.encode()).hexdigest()


def key(stage: str, component: str, version: str, inputs: dict[str, str], params: dict | None = None) -> str:
    """A blank input digest is an error: it would give different inputs one entry."""
    blank = sorted(k for k, v in inputs.items() if not v)
    if blank:
        raise StoreError(f"no digest for {', '.join(blank)}")
    return digest({"stage": stage, "component": component, "version": version, "inputs": inputs, "params": params or {}})


class Store:
    """Entries are Parquet under root on any Hadoop file system; a rename commits them and the first one wins."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self._conf).exists(path)

    def get_or_create(self, name: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """(the entry, whether it was there before); a failed build leaves none."""
        hit = self.has(name)
        if not hit:
            part = f".{uuid.uuid4().hex}"
            fresh, final = self._path(part), self._path(name)
            files = fresh.getFileSystem(self._conf)
            try:
                build().write.parquet(f"{self.root}/{part}")
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
                options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                try:
                    context.rename(files.makeQualified(fresh), files.makeQualified(final), options)
                except Py4JJavaError:
                    if not self.has(name):  # else another writer was first
                        raise
            finally:
                files.delete(fresh, True)
        return self.spark.read.parquet(f"{self.root}/{name}"), hit

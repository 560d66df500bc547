"""Scans and sinks of rollout files: episode records, frame archives, specifications, cards, labels, manifests, reports."""

from __future__ import annotations

import io
import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.errors import SpecError
from gradewright.sources.upgrades import Upgrades

_ARTIFACT = "struct<path:string,sha256:string,kind:string>"
ROLLOUT = f"schema_version int, id string, frames {_ARTIFACT}, fps double, n_frames int, policy string, source string, actions {_ARTIFACT}, meta map<string,string>"
FRAME = "path string, t int, h int, w int, pixels binary"
#: Words of a gold label.
YES, NO = ("success", "pass", "true"), ("fail", "failure", "false")
REASON = 240


def merged(left: Column, right: Column) -> Column:
    """Two maps as one, the right one's value where both hold a key; a null map counts as empty."""
    none = F.expr("cast(map() as map<string,string>)")
    left, right = F.coalesce(left, none), F.coalesce(right, none)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def rollouts(spark: SparkSession, root: str, upgrades: Upgrades | None = None) -> DataFrame:
    """Every rollout.json below root, upgraded, with its folder in `dir` and in meta under _dir. Sort by dir where order matters."""
    d = spark.read.schema(ROLLOUT).option("recursiveFileLookup", True).option("pathGlobFilter", "rollout.json").json(root, multiLine=True)
    # the path comes percent-encoded, but not where files are read as bytes
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    d = d.withColumn("dir", F.regexp_replace(at, "/[^/]*$", ""))
    d = d.withColumn("meta", merged(F.col("meta"), F.create_map(F.lit("_dir"), F.col("dir"))))
    d = d.withColumns({"fps": F.coalesce("fps", F.lit(10.0)), "n_frames": F.coalesce("n_frames", F.lit(0)), "policy": F.coalesce("policy", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    return (upgrades or Upgrades()).apply("rollout", d)


def rollouts_of_files(spark: SparkSession, path: str, glob: str = "*.mp4", fps: float = 10.0) -> DataFrame:
    """A rollout a file: its name without suffix, digest and folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return f.select(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("id"), name.alias("file"), F.sha2("content", 256).alias("sha256"), F.lit(fps).alias("fps"), F.regexp_replace("path", "/[^/]*$", "").alias("dir"))


def frames(spark: SparkSession, root: str) -> DataFrame:
    """A row a frame of every frames.npz below root (array `frames`, T x H x W x 3 bytes). A broken archive fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as archive:
                    data = archive["frames"]
                for at in range(0, len(data), 64):
                    part = data[at : at + 64]
                    n, h, w = part.shape[:3]
                    yield pa.record_batch([pa.array([path] * n), pa.array(range(at, at + n), pa.int32()), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()),
                                           pa.array([f.tobytes() for f in part], pa.binary())], ["path", "t", "h", "w", "pixels"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "frames.npz").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content").mapInArrow(run, FRAME)


def frames_or_errors(spark: SparkSession, root: str) -> DataFrame:
    """The same with a column `error`: an archive that can't be read is one row with its error and no pixels."""
    schema = f"{FRAME}, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as archive:
                        data = archive["frames"]
                    if data.ndim != 4 or data.shape[-1] != 3 or data.dtype != np.uint8:
                        raise ValueError(f"frames are bytes of shape (T, H, W, 3), not {data.dtype} of {data.shape}")
                    rows = [(path, t, *f.shape[:2], f.tobytes(), None) for t, f in enumerate(data)]
                except Exception as error:  # whatever is wrong with one archive leaves the others alone
                    rows = [(path, None, None, None, None, f"{type(error).__name__}: {error}")]
                for at in range(0, len(rows), 64):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64]), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "frames.npz").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content").mapInArrow(run, schema)


def actions(spark: SparkSession, root: str) -> DataFrame:
    """path, t, ax, ay of every actions.npz below root (array `actions`, T x A numbers): its first two dimensions."""
    schema = "path string, t int, ax double, ay double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as archive:
                    a = archive["actions"].astype(float)
                yield pa.record_batch([pa.array([path] * len(a)), pa.array(range(len(a)), pa.int32()), pa.array(a[:, 0]), pa.array(a[:, 1])], ["path", "t", "ax", "ay"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "actions.npz").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content").mapInArrow(run, schema)


def save_episode(folder: str, name: str, frames: np.ndarray, actions: np.ndarray | None = None, fps: float = 10.0, policy: str = "", source: str = "", meta: dict | None = None) -> dict:
    """One episode as files that `rollouts`, `frames` and `actions` read: its record. For a driver's own disk, not for many."""
    import hashlib
    from pathlib import Path

    if frames.ndim != 4 or frames.shape[-1] != 3 or frames.dtype != np.uint8:
        raise SpecError(f"frames are bytes of shape (T, H, W, 3), not {frames.dtype} of {frames.shape}")
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    np.savez_compressed(at / "frames.npz", frames=frames)
    artifact = lambda f: {"path": f, "sha256": hashlib.sha256((at / f).read_bytes()).hexdigest(), "kind": f}
    record = {"schema_version": 1, "id": name, "frames": artifact("frames.npz"), "fps": fps, "n_frames": len(frames), "policy": policy, "source": source, "actions": None, "meta": meta or {}}
    if actions is not None:
        np.savez_compressed(at / "actions.npz", actions=actions.astype(np.float32))
        record["actions"] = artifact("actions.npz")
    (at / "rollout.json").write_text(json.dumps(record))
    return record


def probed_rate(fps: float | None) -> float:
    """A decoder's frame rate, or 10 where it is absent, not finite or not above zero."""
    return float(fps) if fps is not None and np.isfinite(fps) and fps > 0 else 10.0


def nearest(image: np.ndarray, side: int) -> np.ndarray:
    """An image with its longer side at `side`, by the nearest earlier pixel."""
    scale = side / max(image.shape[:2])
    y, x = (np.minimum((np.arange(max(1, round(n * scale))) / scale).astype(int), n - 1) for n in image.shape[:2])
    return image[np.ix_(y, x)]


def resize(frames: DataFrame, side: int) -> DataFrame:
    """Frames (FRAME) with the longer side at `side`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                image = nearest(np.frombuffer(r["pixels"], np.uint8).reshape(r["h"], r["w"], 3), side)
                r |= {"h": image.shape[0], "w": image.shape[1], "pixels": image.tobytes()}
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return frames.select("path", "t", "h", "w", "pixels").mapInArrow(run, FRAME)


def pixel_rows(frames: DataFrame) -> DataFrame:
    """path, t, x, y, r, g, b of every pixel, for the operators on pixel rows."""
    schema = "path string, t int, x int, y int, r int, g int, b int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, t, h, w, pixels in zip(*(c.to_pylist() for c in batch.columns)):
                rgb = np.frombuffer(pixels, np.uint8).reshape(-1, 3).astype(np.int32)
                y, x = (a.ravel().astype(np.int32) for a in np.mgrid[:h, :w])
                yield pa.record_batch([pa.array([path] * len(x)), pa.array(np.full(len(x), t, np.int32)), *map(pa.array, (x, y, rgb[:, 0], rgb[:, 1], rgb[:, 2]))], [c.split()[0] for c in schema.split(", ")])

    return frames.select("path", "t", "h", "w", "pixels").mapInArrow(run, schema)


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames with a digest each, ranged by path and time: neighbours share a file, and no folder a rollout is made."""
    frames.withColumn("sha256", F.sha2("pixels", 256)).repartitionByRange("path", "t").sortWithinPartitions("path", "t").write.parquet(path)


def spec(text: str) -> dict:
    """A task specification from YAML; it must be a mapping."""
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise SpecError("a specification is a mapping")
    return found


def spec_text(found: dict) -> str:
    import yaml

    return yaml.safe_dump(found, sort_keys=False, allow_unicode=True)


def cards(spark: SparkSession, folder: str, schema: str, upgrades: Upgrades | None = None) -> DataFrame:
    """Every *.json of the folder, one card a file, upgraded; `file` names where each came from. Sort by it where order matters."""
    found = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(folder, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    if "schema_version" not in found.columns:
        return found
    return (upgrades or Upgrades()).apply("grade_card", found)


def golds(spark: SparkSession, path: str) -> DataFrame:
    """rollout_id, success of a JSON mapping; any other label fails the query."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("rollout_id", "v"))
    said = F.concat(F.lit("gold label of "), "rollout_id", F.lit(" is neither yes nor no: "), F.coalesce("v", F.lit("null")))
    return raw.select("rollout_id", F.when(F.lower("v").isin(*YES), True).when(F.lower("v").isin(*NO), False).otherwise(F.raise_error(said).cast("boolean")).alias("success"))


@contextmanager
def manifest(spark: SparkSession, path: str, **facts) -> Iterator[dict]:
    """A record of the run, written as JSON also when the run fails."""
    record = {"started": time.time(), "status": "ok", **facts}
    try:
        yield record
    except BaseException as error:
        record |= {"status": "failed", "error": f"{type(error).__name__}: {error}"}
        raise
    finally:
        record["ended"] = time.time()
        spark.createDataFrame([(json.dumps(record, default=str),)], "value string").coalesce(1).write.text(path)


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sparkline(v: Column, width: int = 160, height: int = 32) -> Column:
    """An array as an inline SVG line between its least and greatest value; empty below two points."""
    low, n = F.array_min(v), F.size(v)
    span = F.when(F.array_max(v) > low, F.array_max(v) - low).otherwise(1.0)
    points = F.transform(v, lambda x, i: F.format_string("%.1f,%.1f", (i * F.lit(float(width)) / (n - 1)), F.lit(height - 2.0) - (x - low) / span * (height - 4)))
    drawn = F.concat(F.lit(f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="#357" points="'), F.array_join(points, " "), F.lit('"/></svg>'))
    return F.when(n >= 2, drawn).otherwise("")


def report_rows(cards: DataFrame) -> DataFrame:
    """cards (rollout_id, policy, verdict, reason, progress array) -> value: a table row of HTML each, built where the cards lie."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    text = lambda c: escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    reason = escaped(F.substring(F.coalesce("reason", F.lit("")), 1, REASON))
    return cards.select(F.concat(F.lit("<tr>"), cell(text("rollout_id")), cell(text("policy")), cell(text("verdict")), cell(F.coalesce(sparkline(F.col("progress")), F.lit(""))), cell(reason), F.lit("</tr>")).alias("value"))

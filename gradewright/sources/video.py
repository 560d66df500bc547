"""Videos as frame rows. The decoder is an optional package, loaded by the tasks; decoded frames are kept by content."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.errors import MissingDependency
from gradewright.sources.files import FRAME, nearest, probed_rate
from gradewright.sources.store import Store, key

SUFFIXES = ("mp4", "avi", "mkv", "webm")
VERSION = "1"


def installed_decoder() -> Callable[[bytes], tuple[np.ndarray, float | None]]:
    """A function from a file's bytes to frames (T, h, w, 3 or 4) and a frame rate, by the first package that is there."""
    try:
        reader = importlib.import_module("imageio.v3")
    except ImportError as error:
        raise MissingDependency("imageio", "video") from error

    def decode(content: bytes) -> tuple[np.ndarray, float | None]:
        return np.asarray(reader.imread(content, plugin="pyav")), reader.immeta(content, plugin="pyav").get("fps")

    return decode


def decoded(spark: SparkSession, root: str, max_side: int | None = None, decoder: Callable[[], Callable] = installed_decoder, max_frames: int | None = None) -> DataFrame:
    """path, t, h, w, pixels and fps of every video below root; alpha is dropped, the longer side is max_side at most.

    A file that can't be decoded gives one row with its error and no pixels, so the others go on. decoder() is called
    once a task.
    """
    schema = f"{FRAME}, fps double, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder()
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.string()]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    data, rate = decode(content.as_py())
                    data = np.asarray(data)[:max_frames, :, :, :3].astype(np.uint8)
                    data = data if max_side is None or max(data.shape[1:3]) <= max_side else np.stack([nearest(f, max_side) for f in data])
                    rows = [(path, t, f.shape[0], f.shape[1], np.ascontiguousarray(f).tobytes(), probed_rate(rate), None) for t, f in enumerate(data)]
                except Exception as error:  # any decoder's failure is the file's, not the run's
                    rows = [(path, None, None, None, None, None, f"{type(error).__name__}: {error}")]
                for at in range(0, len(rows), 64):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64]), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)}}}").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content").mapInArrow(run, schema)


def decoded_once(store: Store, root: str, decoder_name: str, max_side: int | None = None, decoder: Callable[[], Callable] = installed_decoder) -> tuple[DataFrame, bool]:
    """(the decoded frames, whether they were there before): keyed by the files' content, the side and the decoder."""
    files = store.spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)}}}").option("recursiveFileLookup", True).load(root)
    row = files.select("path", F.sha2("content", 256).alias("sha")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha"))), ","), 256)).first()  # a line a file
    name = key("decode", decoder_name, VERSION, {"files": row[0] if files.limit(1).count() else ""}, {"max_side": max_side})
    return store.get_or_create(name, lambda: decoded(store.spark, root, max_side, decoder))


def joined_views(top: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Three cameras of a rollout as one picture: one above, the two others below it at half size. The shortest one ends it."""
    d = top.select("path", "t", "h", "w", F.col("pixels").alias("a"))
    for name, view in (("b", left), ("c", right)):
        d = d.join(view.select("path", "t", F.struct("h", "w", "pixels").alias(name)), ["path", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = lambda h, w, p: np.frombuffer(p, np.uint8).reshape(h, w, 3)
        for batch in batches:
            out = []
            for path, t, h, w, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                half = (h // 2, w // 2)
                low = np.concatenate([_sized(image(v["h"], v["w"], v["pixels"]), *half) for v in (b, c)], axis=1)
                both = np.concatenate([image(h, w, a)[:, : low.shape[1]], low])
                out.append((path, t, *both.shape[:2], both.tobytes()))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*out)) or [[]] * 5, kinds)], [x.split()[0] for x in FRAME.split(", ")])

    return d.mapInArrow(run, FRAME)


def _sized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    return image[np.ix_(*((np.arange(n) * size / n).astype(int) for n, size in ((h, image.shape[0]), (w, image.shape[1]))))]


def marked(frames: DataFrame, tracks: DataFrame, colours: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Frames with a 5 x 5 mark of its colour where each role is observed; for the eye alone."""
    points = tracks.filter("x is not null").groupBy(F.col("rollout_id").alias("path"), "t").agg(F.collect_list(F.struct("role", "x", "y")).alias("marks"))
    d = frames.select("path", "t", "h", "w", "pixels").join(points, ["path", "t"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                image = np.frombuffer(r["pixels"], np.uint8).reshape(r["h"], r["w"], 3).copy()
                for m in r.pop("marks") or ():
                    x, y = round(m["x"]), round(m["y"])
                    image[max(0, y - 2) : max(0, y + 3), max(0, x - 2) : max(0, x + 3)] = colours.get(m["role"], (255, 255, 255))
                r["pixels"] = image.tobytes()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("t", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("pixels", pa.binary())]))

    return d.mapInArrow(run, FRAME)

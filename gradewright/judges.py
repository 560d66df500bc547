"""Judges that see images and answer in text: the interface, a chat endpoint over HTTP, and asking about many rollouts."""

from __future__ import annotations

import base64
import json
import struct
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.errors import InfraError

#: Frames a rollout that a judge is shown, and how often in another order.
FRAMES, RUNS = 12, 2
PROMPT = """Task: {task}
The first image shows the start of a rollout (0 % done). The other {n} images are frames of the same rollout in RANDOM order.
Judge each of them by itself: how much of the task is done, in percent? Answer one line a frame:
Frame 1: <percent>%
Frame 2: <percent>%
..."""


class Judge(Protocol):
    name: str
    version: str

    def complete(self, images: Sequence[np.ndarray], prompt: str) -> str: ...


def png(image: np.ndarray) -> bytes:
    """An image (h, w, 3) of bytes as a PNG file."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(h, 3 * w)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


class HttpJudge:
    """A chat completions endpoint. Anything that goes wrong on the way is an InfraError, which may be tried again."""

    name, version = "http.chat", "0.1.0"

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 120.0) -> None:
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def complete(self, images: Sequence[np.ndarray], prompt: str) -> str:
        shown = [{"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(png(i)).decode()}} for i in images]
        body = {"model": self.model, "messages": [{"role": "user", "content": [{"type": "text", "text": prompt}, *shown]}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
                found = json.load(answer)["choices"][0]["message"]["content"]
        except (urllib.error.URLError, TimeoutError, OSError, ValueError, KeyError, IndexError, TypeError) as error:
            raise InfraError(f"{self.url}: {type(error).__name__}: {error}") from error
        if not isinstance(found, str):
            raise InfraError(f"{self.url}: the answer holds no text")
        return found


def ask(frames: DataFrame, judge: Callable[[], Judge], task: str, n_frames: int = FRAMES, runs: int = RUNS, seed: int = 0) -> DataFrame:
    """frames (path, t, h, w, pixels) -> rollout_id, run, reply, shown, frames: the replies that `replies.progress` reads.

    A rollout's sampled frames meet in one task and are shown after its first one, in a seeded order a run. judge() is
    called once a task.
    """
    n = frames.groupBy("path").agg(F.count("*").cast("int").alias("n"))
    grid = F.udf(lambda k: np.unique(np.linspace(0, k - 1, min(n_frames, k)).astype(int)).tolist(), "array<int>")  # a row a rollout
    shots = frames.select("path", "t", "h", "w", "pixels").join(n.select("path", "n", F.explode(grid("n")).alias("t")), ["path", "t"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        images = [np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w, 3) for r in rows.itertuples()]
        found, model = [], judge()
        for i in range(runs):
            order = np.random.default_rng(seed + i).permutation(len(images))
            reply = model.complete([images[0], *(images[k] for k in order)], PROMPT.format(task=task, n=len(images)))
            found.append((key[0], i, reply, order.tolist(), int(rows["n"].iloc[0])))
        return pd.DataFrame(found, columns=["rollout_id", "run", "reply", "shown", "frames"])

    return shots.groupBy("path").applyInPandas(run, "rollout_id string, run int, reply string, shown array<int>, frames int")

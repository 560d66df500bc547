"""A small drawn world with known truth: a hand carries a block to a cup, in five kinds of episode and five corruptions.

Episodes are rows (path, kind, seed, frames, scene); their frames come from one Arrow pass, an episode a row, so any
number of them spreads over the cluster. The tracks of the seedless kinds are also closed forms over Columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.errors import SpecError
from gradewright.sources.files import FRAME

# The size of a frame, the shade behind everything and the depth of its grain, block side, hand radius, wall of the cup.
HEIGHT, WIDTH, SHADE, GRAIN, SIDE, RADIUS, WALL = 96, 128, 200, 6, 8, 4, 4
#: Kinds of episode and their outcome. A vanished block is a failure that a gate should refuse to grade.
KINDS = {"success": "success", "fail_miss": "fail", "fail_drop": "fail", "vanish": "fail", "random": "fail"}
CORRUPTIONS = ("vanish_late", "freeze", "noise_ramp", "teleport", "bg_morph")
#: When the hand arrives, the block drops or vanishes, as shares of the episode; frames from arrival to release and of the retreat.
ARRIVE, DROP, VANISH, RELEASE, RETREAT = 0.6, 0.4, 0.55, 2, 10.0
#: How far below the hand the block hangs, how far below the cup's middle it settles, how far beside the cup a miss ends, the retreat.
HANG, SETTLE, MISS, AWAY = 10.0, 6.0, 18.0, (26.0, -22.0)
EPISODE = "path string, kind string, seed long, n int, scene string"


@dataclass(frozen=True)
class Scene:
    """Colours and layout; the task is the same in every scene."""

    hand: tuple[int, int, int]
    block: tuple[int, int, int]
    cup: tuple[int, int, int]
    x0: int
    x1: int
    y0: int
    y1: int
    start: float

    @property
    def inside(self) -> tuple[int, int, int, int]:
        return self.x0 + WALL, self.y0, self.x1 - WALL, self.y1 - WALL

    @property
    def rightward(self) -> bool:
        return self.x0 > WIDTH / 2

    @property
    def rest(self) -> tuple[float, float]:
        """Where the block settles."""
        x0, y0, x1, y1 = self.inside
        return (x0 + x1) / 2, (y0 + y1) / 2 + SETTLE

    def beside(self) -> float:
        return self.x0 - MISS if self.rightward else self.x1 + MISS


#: The scene, and one of other colours with the layout turned round.
SCENES = {"a": Scene((40, 60, 220), (220, 40, 40), (40, 180, 60), 100, 124, 30, 66, 16.0), "b": Scene((160, 40, 200), (235, 200, 40), (40, 90, 230), 4, 28, 30, 66, WIDTH - 20.0)}


def ease(u: np.ndarray) -> np.ndarray:
    return u * u * (3 - 2 * u)


def truth(kind: str, seed: int, n: int, scene: Scene) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Hand and block by frame (NaN once the block has vanished), and the frames at which something happens."""
    if kind not in KINDS:
        raise SpecError(f"{kind!r} is no kind of episode; kinds are {', '.join(KINDS)}")
    t = np.arange(n)
    if kind == "random":
        rng, at, speed, hand = np.random.default_rng(seed), np.array([scene.start, HEIGHT / 2]), np.zeros(2), []
        for push in rng.normal(0, 1.6, (n, 2)):
            speed = 0.8 * speed + push
            at = np.clip(at + speed, RADIUS + 1, [WIDTH - SIDE - 2, HEIGHT - SIDE - 2])
            hand.append(at)
        hand = np.array(hand)
        return hand, hand + [0.0, HANG], {}
    arrive = int(n * ARRIVE)
    x, y = scene.rest
    goal = np.array([scene.beside() if kind == "fail_miss" else x, y - HANG])
    begin = np.array([scene.start, HEIGHT / 2])
    hand = begin + (goal - begin) * ease(np.clip(t / max(arrive, 1), 0, 1))[:, None]
    block = hand + [0.0, HANG]
    if kind == "fail_drop":
        at = int(n * DROP)
        block[at:] = block[max(at - 1, 0)]
        return hand, block, {"drop_frame": at}
    release = min(arrive + RELEASE, n - 1)
    block[release:] = block[max(release - 1, 0)]
    away = np.array([-AWAY[0] if scene.rightward else AWAY[0], AWAY[1]])
    hand[release:] = hand[max(release - 1, 0)] + away * ease(np.minimum(1.0, (t[release:] - release) / RETREAT))[:, None]
    events = {"release_frame": release}
    if kind in ("success", "vanish"):
        events["contained_from"] = release
    if kind == "vanish":
        events["vanish_frame"] = int(n * VANISH)
        block[events["vanish_frame"]:] = np.nan
    return hand, block, events


def drawn(hand: np.ndarray, block: np.ndarray, seed: int, scene: Scene) -> np.ndarray:
    """Frames (n, HEIGHT, WIDTH, 3): grain that stays, the cup, then the block where there is one, then the hand."""
    grain = np.random.default_rng([seed, 1]).integers(0, GRAIN, (HEIGHT, WIDTH, 3))
    still = (SHADE + grain).astype(np.uint8)
    for rows, columns in ((slice(scene.y0, scene.y1), slice(scene.x0, scene.x0 + WALL)), (slice(scene.y0, scene.y1), slice(scene.x1 - WALL, scene.x1)), (slice(scene.y1 - WALL, scene.y1), slice(scene.x0, scene.x1))):
        still[rows, columns] = scene.cup
    out = np.repeat(still[None], len(hand), axis=0)
    yy, xx = np.mgrid[:HEIGHT, :WIDTH]
    for frame, (hx, hy), (bx, by) in zip(out, hand, block):
        if np.isfinite(bx):
            left, top = round(bx - SIDE / 2), round(by - SIDE / 2)
            frame[max(0, top) : max(0, top + SIDE), max(0, left) : max(0, left + SIDE)] = scene.block
        frame[(xx - hx) ** 2 + (yy - hy) ** 2 <= RADIUS**2] = scene.hand
    return out


def ruddy(frames: np.ndarray) -> np.ndarray:
    """Pixels in the range of the block's colour. Fixed values."""
    return ((frames >= (150, 0, 0)) & (frames <= (255, 90, 90))).all(axis=-1)


def corrupted(frames: np.ndarray, how: str, seed: int) -> np.ndarray:
    """A copy that is broken in one way. Shares, amplitudes and periods are fixed values."""
    n, rng, out = len(frames), np.random.default_rng([seed, 2]), frames.copy()
    u = np.arange(n) / max(n - 1, 1)
    if how == "vanish_late":
        late = out[int(n * 0.75):]
        late[ruddy(late)] = SHADE
    elif how == "freeze":
        out[int(n * 0.4):] = out[int(n * 0.4)]
    elif how == "noise_ramp":
        out = np.clip(out + rng.normal(0, 1, out.shape) * (60 * u**2)[:, None, None, None], 0, 255).astype(np.uint8)
    elif how == "teleport":
        for t in range(int(n * 0.3), n):
            ys, xs = np.nonzero(ruddy(out[t]))
            if t % 12 < 3 and len(xs):
                colour = out[t, ys[0], xs[0]].copy()
                dy, dx = rng.integers(-30, 30), rng.integers(-50, 50)
                out[t, ys, xs] = SHADE
                out[t, np.clip(ys + dy, 0, HEIGHT - 1), np.clip(xs + dx, 0, WIDTH - 1)] = colour
    elif how == "bg_morph":
        drift = rng.normal(0, 1, out.shape[1:])
        moved = np.clip(out + drift * (50 * u)[:, None, None, None], 0, 255).astype(np.uint8)
        out = np.where(ruddy(out)[..., None], out, moved)
    else:
        raise SpecError(f"{how!r} is no corruption; there are {', '.join(CORRUPTIONS)}")
    return out


def made(kind: str, seed: int, n: int, scene: str) -> np.ndarray:
    """Frames of `kind`, or of `corruption:kind`."""
    how, _, base = kind.rpartition(":")
    hand, block, _ = truth(base, seed, n, SCENES[scene])
    frames = drawn(hand, block, seed, SCENES[scene])
    return corrupted(frames, how, seed) if how else frames


def episodes(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """(path, kind, seed, n, scene) as a table; kinds may be `corruption:kind`."""
    return spark.createDataFrame(list(rows), EPISODE)


def dataset(spark: SparkSession, kinds: dict[str, int] | None = None, seed: int = 0, n: int = 60, scene: str = "a") -> DataFrame:
    """The default set: two successes, two misses, a drop, a vanished block, a random walk. Its path is kind_00, kind_01, ..."""
    kinds = kinds or {"success": 2, "fail_miss": 2, "fail_drop": 1, "vanish": 1, "random": 1}
    names = [(f"{k}_{j:02d}", k) for k, count in kinds.items() for j in range(count)]
    return episodes(spark, [(path, k, seed + i, n, scene) for i, (path, k) in enumerate(names)])


def benchmark(spark: SparkSession, seeds: int = 3, n: int = 60) -> DataFrame:
    """path, kind, seed, n, scene, is_broken: two clean episodes and all corruptions of a success, for each seed."""
    kinds = [("success", "success", False), ("fail_miss", "fail_miss", False), *((c, f"{c}:success", True) for c in CORRUPTIONS)]
    listed = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("kind"), F.lit(c).alias("is_broken")) for a, b, c in kinds]))
    d = spark.range(seeds).select(F.col("id").alias("seed"), listed.alias("k"))
    return d.select(F.concat("k.name", F.lit("_s"), F.col("seed").cast("string")).alias("path"), "k.kind", "seed", F.lit(n).alias("n"), F.lit("a").alias("scene"), "k.is_broken")


def frames(rows: DataFrame) -> DataFrame:
    """Episodes -> their frames (path, t, h, w, pixels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, seed, n, scene in zip(*(c.to_pylist() for c in b.columns)):
                data = made(kind, seed, n, scene)
                yield pa.record_batch([pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array([HEIGHT] * n, pa.int32()), pa.array([WIDTH] * n, pa.int32()), pa.array([f.tobytes() for f in data], pa.binary())], ["path", "t", "h", "w", "pixels"])

    return rows.select("path", "kind", "seed", "n", "scene").mapInArrow(run, FRAME)


def truths(rows: DataFrame) -> DataFrame:
    """Episodes -> path, kind, label, t, hand_x, hand_y, block_x, block_y, ax, ay (the hand's commanded steps), events (JSON)."""
    schema = "path string, kind string, label string, t int, hand_x double, hand_y double, block_x double, block_y double, ax double, ay double, events string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, seed, n, scene in zip(*(c.to_pylist() for c in b.columns)):
                base = kind.rpartition(":")[2]
                hand, block, events = truth(base, seed, n, SCENES[scene])
                step = np.diff(hand, axis=0, prepend=hand[:1])
                columns = [hand[:, 0], hand[:, 1], block[:, 0], block[:, 1], step[:, 0], step[:, 1]]
                text = [[path] * n, [kind] * n, [KINDS[base]] * n]
                yield pa.record_batch([*map(pa.array, text), pa.array(range(n), pa.int32()), *(pa.array(c, from_pandas=True) for c in columns), pa.array([json.dumps(events)] * n)], [x.split()[0] for x in schema.split(", ")])

    return rows.select("path", "kind", "seed", "n", "scene").mapInArrow(run, schema)


def closed_form(kind: Column, t: Column, n: int, scene: Scene = SCENES["a"]) -> list[Column]:
    """hand_x, hand_y, block_x, block_y of the seedless kinds as Columns; the block's are null once it has vanished."""
    arrive, drop, gone = int(n * ARRIVE), int(n * DROP), int(n * VANISH)
    release = min(arrive + RELEASE, n - 1)
    smooth = lambda u: u * u * (3 - 2 * u)
    x, y = scene.rest
    goal = F.when(kind == "fail_miss", scene.beside()).otherwise(x)
    path = lambda at: smooth(F.least(F.lit(1.0), at / F.lit(float(max(arrive, 1)))))
    px = lambda at: F.lit(scene.start) + (goal - scene.start) * path(at)
    py = lambda at: F.lit(HEIGHT / 2) + (y - HANG - HEIGHT / 2) * path(at)
    hold = F.when(kind == "fail_drop", F.least(t, F.lit(drop - 1))).otherwise(F.least(t, F.lit(release - 1)))
    back = F.when((kind != "fail_drop") & (t >= release), smooth(F.least(F.lit(1.0), (t - release) / RETREAT))).otherwise(0.0)
    away = -AWAY[0] if scene.rightward else AWAY[0]
    hand_at = F.when(kind == "fail_drop", t).otherwise(F.least(t, F.lit(release - 1)))
    seen = (kind != "vanish") | (t < gone)
    return [px(hand_at) + away * back, py(hand_at) + AWAY[1] * back, F.when(seen, px(hold)), F.when(seen, py(hold) + HANG)]


def write_dataset(rows: DataFrame, root: str, spec_text: str) -> None:
    """Frames and truths of the episodes, their labels and the specification, under root on any file system Spark writes."""
    from gradewright.sources.files import write_frames

    write_frames(frames(rows), f"{root}/frames")
    truths(rows).write.parquet(f"{root}/truth")
    base = F.element_at(F.split("kind", ":"), -1)
    label = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[base]
    rows.select("path", "kind", label.alias("label")).write.json(f"{root}/labels")
    rows.sparkSession.createDataFrame([(spec_text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{root}/spec")


class ProgressOracle:
    """A stand-in for a judge: progress is how near the block's colour is to the inside of the cup, as text in two styles."""

    name, version = "test.progress_oracle", "0.1.0"
    #: Fixed value: the usual distance at the start.
    FAR = 110.0

    def __init__(self, noise: float = 0.0, seed: int = 0, style: str = "lines", scene: str = "a") -> None:
        self.noise, self.style, self.scene = noise, style, SCENES[scene]
        self.rng = np.random.default_rng(seed)

    def progress(self, image: np.ndarray) -> float:
        ys, xs = np.nonzero(ruddy(image))
        if not len(xs):
            return 0.0
        x0, y0, x1, y1 = self.scene.inside
        p = 1 - np.hypot(xs.mean() - (x0 + x1) / 2, ys.mean() - (y0 + y1) / 2) / self.FAR
        return float(np.clip(np.clip(p, 0, 1) + (self.rng.normal(0, self.noise) if self.noise else 0), 0, 1))

    def complete(self, images: Sequence[np.ndarray], prompt: str) -> str:
        """The first image is the start of the rollout and gets no line."""
        shares = [round(100 * self.progress(i)) for i in images[1:]]
        return "\n".join(f"Frame {i}: {p}%" if self.style == "lines" else f"roughly {p}% of it is done" for i, p in enumerate(shares, 1))

"""Files, store, upgrades, components, linking and streams on small cases."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradewright import components
from gradewright.errors import PluginError, SpecError, StoreError
from gradewright.operators import linking
from gradewright.sources import files, store
from gradewright.sources.upgrades import Upgrades
from gradewright.streaming import windows


@pytest.fixture
def episodes(tmp_path):
    rng = np.random.default_rng(3)
    for name in ("b", "a/deep"):
        d = tmp_path / "in" / name
        d.mkdir(parents=True)
        (d / "rollout.json").write_text(json.dumps({"id": name, "policy": "p", "meta": {"k": "v"}}, indent=1))
        np.savez(d / "frames.npz", frames=rng.integers(0, 256, (3, 4, 6, 3), dtype=np.uint8))
    return tmp_path / "in"


def test_rollouts(spark, episodes):
    rows = files.rollouts(spark, str(episodes)).orderBy("dir").collect()
    assert [r.id for r in rows] == ["a/deep", "b"] and rows[1].fps == 10.0 and rows[1].schema_version == 1
    assert rows[1].meta["k"] == "v" and rows[1].meta["_dir"].endswith("/in/b")


def test_frames_resize_pixels_write(spark, episodes, tmp_path):
    data = np.load(episodes / "b/frames.npz")["frames"]
    f = files.frames(spark, str(episodes)).filter(F.col("path").endswith("/b/frames.npz"))
    rows = f.orderBy("t").collect()
    assert [bytes(r.pixels) for r in rows] == [x.tobytes() for x in data]
    small = files.resize(f, 3).orderBy("t").first()
    assert (small.h, small.w) == (2, 3) and bytes(small.pixels) == data[0][::2, ::2].tobytes()
    px = files.pixel_rows(f.filter("t = 1")).orderBy("y", "x").collect()
    assert [(p.r, p.g, p.b) for p in px] == [tuple(map(int, v)) for v in data[1].reshape(-1, 3)]
    files.write_frames(f, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.sha2("pixels", 256) == F.col("sha256")).count() == 3


def test_rollouts_of_files(spark, tmp_path):
    (tmp_path / "clip.one.mp4").write_bytes(b"abc")
    r = files.rollouts_of_files(spark, str(tmp_path)).first()
    assert r.id == "clip.one" and r.sha256.startswith("ba7816bf")


def test_golds(spark, tmp_path):
    p = tmp_path / "golds.json"
    p.write_text(json.dumps({"a": True, "b": "Failure", "c": "PASS"}))
    assert dict(map(tuple, files.golds(spark, str(p)).collect())) == {"a": True, "b": False, "c": True}
    p2 = tmp_path / "bad.json"
    p2.write_text('{"a": "maybe"}')
    with pytest.raises(Exception, match="neither yes nor no"):
        files.golds(spark, str(p2)).collect()


def test_spec_and_manifest(spark, tmp_path):
    assert files.spec(files.spec_text({"task": "x", "roles": ["a"]})) == {"task": "x", "roles": ["a"]}
    with pytest.raises(SpecError):
        files.spec("- a")
    with pytest.raises(ZeroDivisionError), files.manifest(spark, str(tmp_path / "m"), spec="s"):
        1 / 0
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0])["status"] == "failed"


def test_store(spark, tmp_path):
    k = store.key("ground", "c", "1", {"rollout": "abc"})
    assert k != store.key("ground", "c", "2", {"rollout": "abc"})
    with pytest.raises(StoreError):
        store.key("ground", "c", "1", {"rollout": ""})
    s = store.Store(spark, str(tmp_path))
    with pytest.raises(ZeroDivisionError):
        s.get_or_create(k, lambda: 1 / 0)
    assert s.get_or_create(k, lambda: spark.range(3))[1] is False
    df, hit = s.get_or_create(k, lambda: spark.range(9))
    assert hit and df.count() == 3 and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == [k]


def test_upgrades(spark):
    u = Upgrades({"m": 3})
    u.step("m", 1)(lambda d: d.withColumn("x", F.col("x") * 10))
    u.step("m", 2)(lambda d: d.withColumn("x", F.col("x") + 1))
    with pytest.raises(SpecError):
        u.step("m", 2)
    rows = u.apply("m", spark.createDataFrame([(1, 1), (2, 2), (3, 3), (None, 4)], "schema_version int, x int")).collect()
    assert sorted(map(tuple, rows)) == [(3, 3), (3, 3), (3, 11), (3, 41)]
    with pytest.raises(Exception, match="only up to 3"):
        u.apply("m", spark.createDataFrame([(4, 1)], "schema_version int, x int")).collect()


def test_components():
    cls = type("A", (), {})
    components.register("channel", "test.one")(cls)
    components.register("channel", "test.one")(cls)
    assert components.find("channel", "test.one") is cls
    with pytest.raises(PluginError):
        components.register("channel", "test.one")(type("B", (), {}))
    with pytest.raises(PluginError, match="test.one"):
        components.find("channel", "none")
    base = components.RunConfig(params={"a": {"k": 1}})
    base.with_changes(grounder="g").params["a"]["k"] = 2
    assert base.params["a"]["k"] == 1


def test_report_rows(spark):
    d = spark.createDataFrame([(1, "<p>", "pass", "r" * 300, [0.0, 1.0]), (2, None, None, None, [1.0])], "rollout_id int, policy string, verdict string, reason string, progress array<double>")
    a, b = [r[0] for r in files.report_rows(d).collect()]
    assert "&lt;p&gt;" in a and "0.0,30.0 160.0,2.0" in a and "r" * 240 + "</td>" in a and "svg" not in b


def _boxes(rows):
    return pd.DataFrame([(t, k, x, 0.0, x + 10, 10.0, s) for k, (t, x, s) in enumerate(rows)], columns=["t", "k", "x0", "y0", "x1", "y1", "score"])


def test_linking():
    leash = linking.linked_rows(linking.Linker(100.0), _boxes([(0, 0.0, 0.9), (1, 90.0, 0.99), (1, 5.0, 0.5), (2, 5.0, 0.1)]))
    assert [(r[0], r[1]) for r in leash] == [(0, 0.0), (1, 5.0)]
    lost = linking.linked_rows(linking.Linker(10.0), _boxes([(0, 0.0, 0.9), *[(t, 500.0, 0.1) for t in range(1, 7)], (7, 500.0, 0.8)]))
    assert [(r[0], r[1]) for r in lost] == [(0, 0.0), (7, 500.0)]
    near = linking.linked_rows(linking.Linker(10.0), _boxes([(0, 0.0, 0.9), (1, 500.0, 0.8)]))
    assert [r[0] for r in near] == [0]
    assert linking.overlap((0, 0, 2, 2), (1, 0, 3, 2)) == pytest.approx(1 / 3)


def _stream(spark, df, path, parts):
    for i, part in enumerate(parts):
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/*")


def _drain(out, name, tmp_path):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out.sparkSession.table(name)


def test_linking_stream_is_the_batch(spark, tmp_path):
    rows = [(1, "a", t, k, float(t * 3 + 400 * k), 0.0, float(t * 3 + 400 * k + 10), 10.0, 0.5 + 0.1 * k) for t in range(8) for k in range(2)]
    d = spark.createDataFrame(rows, "rollout_id long, role string, t int, k int, x0 double, y0 double, x1 double, y1 double, score double")
    # frame 4 is split over two micro-batches; the last frame waits for a later one
    s = _stream(spark, d, str(tmp_path / "in"), ["t < 4 or (t = 4 and k = 0)", "t > 4 or (t = 4 and k = 1)"])
    got = sorted(map(tuple, _drain(linking.link_stream(s, 100.0), "linked", tmp_path).collect()))
    want = sorted(map(tuple, linking.link(d, 100.0).collect()))
    assert len(want) == 8 and got == [r for r in want if r[2] < 7]


def test_windows_over_the_events_table_as_a_stream(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value")
    assert dict(d.dtypes)["ts"] == "timestamp_ntz"
    s = _stream(spark, d, str(tmp_path / "in"), ["true"])
    for name, fn in (("e1", lambda x: windows.tumbling(x, ["user_id"], "8 hours")), ("e2", lambda x: windows.sliding(x, ["user_id"], "5 hours", "2 hours")), ("e3", lambda x: windows.sessions(x, ["user_id"], "6 hours"))):
        assert _drain(fn(s), name, tmp_path).count() > 50
    assert _drain(windows.once_by_key(s, ["user_id"], "60 days"), "e4", tmp_path).count() == d.select("user_id").distinct().count()


def test_saved_record_is_read_again(spark, tmp_path):
    """A record whose meta holds the folder of an earlier load."""
    frames = np.zeros((5, 4, 6, 3), np.uint8)
    files.save_episode(str(tmp_path / "e"), "e", frames, np.ones((5, 3)), meta={"_dir": "/old", "k": "v"})
    r = files.rollouts(spark, str(tmp_path)).first()
    assert r.meta["_dir"].endswith("/e") and r.meta["k"] == "v" and r.n_frames == 5 and r.actions.path == "actions.npz"
    assert files.actions(spark, str(tmp_path)).agg(F.sum("ax"), F.count("*")).first()[:] == (5.0, 5)
    with pytest.raises(SpecError):
        files.save_episode(str(tmp_path / "x"), "x", np.zeros((5, 4, 6)))


def test_streamed_windows_are_the_batch(spark, tmp_path):
    d = spark.range(48).select((F.col("id") % 2).alias("user"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.col("id").cast("double").alias("value"))
    s = _stream(spark, d, str(tmp_path / "in"), ["value < 24", "value >= 24"])
    got = {tuple(r) for r in _drain(windows.tumbling(s, ["user"], "1 hour"), "chunks", tmp_path).collect()}
    want = {tuple(r) for r in windows.tumbling(d, ["user"], "1 hour").collect()}
    assert got <= want and len(got) >= 12
    twice = s.select((F.col("value") % 5).alias("key"), "ts")
    assert _drain(windows.once_by_key(twice, ["key"], "10 hours"), "once", tmp_path).count() == 5

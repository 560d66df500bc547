"""The drawn world end to end: verdicts by kind, the gate on broken videos, compiling from demos, runs over files."""

import dataclasses
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewright import builtin, compiler, components, conformance, grading, judges
from gradewright.errors import InfraError, MissingDependency, PluginError, SpecError, StoreError
from gradewright.operators import appearance, embedding, grounders, replies
from gradewright.plans import evaluation, statistics
from gradewright.sources import files, video
from gradewright.sources.store import Store
from gradewright.spec import Phase, Predicate, Role, TaskSpec, clean, insertion_spec, spec_from_dict, spec_from_yaml
from gradewright.synthetic import world

N = 60
CONFIG = grading.Config(channels=("success.predicates", "progress.goal_distance", "phase.ordered_coverage", "success.tl_dtmc"))


@pytest.fixture(scope="module")
def graded(spark):
    rows = world.dataset(spark, dict.fromkeys(world.KINDS, 1), n=N)
    frames = world.frames(rows).persist()
    policies = rows.select(F.col("path").alias("rollout_id"), F.col("kind").alias("policy"))
    truth = world.truths(rows)
    g = grounders.colour(frames, insertion_spec(), policies).with_tables(actions=truth.join(policies, truth.path == policies.rollout_id).select("rollout_id", "policy", "t", "ax", "ay"))
    return g, {r.policy: r for r in grading.cards(g, CONFIG).collect()}


def value(card, channel):
    return next(c.value for c in card.channels if c.channel == channel)


def test_verdicts_by_kind(graded):
    _, c = graded
    assert (c["success"].success.verdict, c["success"].gate.verdict) == ("pass", "gradeable")
    assert c["fail_miss"].success.verdict == c["fail_drop"].success.verdict == "fail" and c["random"].success.verdict in ("fail", "abstain")
    v = c["vanish"]
    assert (v.gate.verdict, v.success.verdict) == ("ungradeable", "abstain") and any("permanence" in r for r in v.gate.reasons) and all(r.startswith("gate: ") for r in v.success.reasons)
    assert {x.status for x in v.channels} == {"skipped"}
    assert "contained(carried_object, receptacle)" in c["fail_miss"].success.violated and "stationary(carried_object)" in c["success"].success.satisfied
    p = {k: value(c[k], "progress.goal_distance") for k in c}
    assert p["success"] > 0.9 > max(p["fail_miss"], p["fail_drop"]) and value(c["success"], "phase.ordered_coverage") == 1.0
    assert c["success"].spec_hash == insertion_spec().content_hash()


def test_leaderboard_of_cards(spark, graded):
    cards = grading.cards(graded[0], grading.Config())
    rows = {r.policy: r for r in evaluation.board(cards).collect()}
    assert (rows["vanish"].abstained, rows["vanish"].pass_rate, rows["success"].pass_rate, rows["fail_miss"].pass_rate) == (1, None, 1.0, 0.0)
    with pytest.raises(SpecError, match="several"):
        evaluation.board(cards.unionByName(cards.withColumn("spec_hash", F.lit("x"))))
    with pytest.raises(SpecError, match="no cards"):
        evaluation.board(cards.limit(0))


def test_actions_against_the_video(spark, graded):
    g, _ = graded
    signal = components.find("gate_signal", "action_video_consistency")()
    right = {r.rollout_id: r.s for r in signal.table(g).collect()}
    turned = g.with_tables(actions=g.actions.withColumns({"ax": -F.col("ax"), "ay": -F.col("ay")}))
    wrong = {r.rollout_id: r.s for r in signal.table(turned).collect()}
    assert right["success_00"].value > 0.95 and wrong["success_00"].value < 0.05 and "against" in wrong["success_00"].reason
    assert signal.table(g.with_tables(actions=None)).first().s.reason == "no actions"


def test_closed_form_is_the_truth(spark):
    kinds = [k for k in world.KINDS if k != "random"]
    t = world.truths(world.episodes(spark, [(k, k, 3, N, "a") for k in kinds]))
    drawn = world.closed_form(F.col("kind"), F.col("t"), N)
    names = ("hand_x", "hand_y", "block_x", "block_y")
    far = [F.max(F.abs(c - F.col(n))).alias(n) for c, n in zip(drawn, names)]
    apart = t.groupBy("kind").agg(*far, *[F.count_if(c.isNull() != F.col(n).isNull()).alias(f"{n}_gap") for c, n in zip(drawn, names)]).collect()
    assert len(apart) == 4 and all(r[n] < 1e-9 and r[f"{n}_gap"] == 0 for r in apart for n in names)


def test_gate_on_broken_videos(spark):
    rows = world.benchmark(spark, 2, N).persist()
    g = grounders.colour(world.frames(rows.repartition(8)).persist(), insertion_spec())
    names = ("permanence", "motion_sanity", "background_drift", "appearance_consistency", "track_continuity")
    cards = grading.cards(g, grading.Config(signals=names, channels=("success.predicates",)))
    s = cards.select("rollout_id", F.array_min(F.transform("signals", lambda x: F.coalesce(x["value"], F.lit(0.0)))).alias("value"), "signals").join(rows.select(F.col("path").alias("rollout_id"), F.col("is_broken").alias("broken")), "rollout_id").persist()
    a = statistics.auroc(s).first()
    by = {r.rollout_id: (round(r.value, 3), [(x.signal, x.value) for x in r.signals]) for r in s.collect()}
    assert (a.healthy, a.broken) == (4, 10) and a.auroc >= 0.8, by
    low = {"freeze": "motion_sanity", "bg_morph": "background_drift", "teleport": "track_continuity", "vanish_late": "permanence"}
    for kind, signal in low.items():
        assert dict(by[f"{kind}_s0"][1])[signal] < dict(by["success_s0"][1])[signal], kind


def test_likeness():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (20, 20, 3), dtype=np.uint8)
    assert appearance.likeness(a, a) == pytest.approx(1.0) and appearance.likeness(a, a[:12]) > 0.45
    assert appearance.likeness(np.zeros((9, 9, 3), np.uint8), np.full((9, 9, 3), 255, np.uint8)) == 0.0


@pytest.fixture(scope="module")
def compiled(spark):
    demos = world.frames(world.episodes(spark, [(f"demo{i}", "success", i, N, "a") for i in range(3)]).repartition(3)).persist()
    return compiler.compile_spec(demos, "put the small thing into the container")


def test_compiled(spark, compiled):
    t = compiled.spec_provenance.self_test
    assert (t.ran, t.accepted, t.demos_passed, t.demos_total, t.negatives_failed, t.negatives_total) == (True, True, 3, 3, 8, 8)
    assert len(set(compiled.spec_provenance.demo_digests)) == 3 and compiled.role("carried_object").candidates == ("red object",)
    assert spec_from_yaml(compiled.to_yaml()).content_hash() == compiled.content_hash()
    blind = dataclasses.replace(compiled, roles=tuple(dataclasses.replace(r, candidates=("spaghetti",)) for r in compiled.roles))
    rows = [("a_success", "success", 7, N, "a"), ("a_miss", "fail_miss", 7, N, "a"), ("a_drop", "fail_drop", 7, N, "a"), ("b_success", "success", 5, N, "b"), ("b_miss", "fail_miss", 5, N, "b"), ("b_drop", "fail_drop", 9, N, "b")]
    g = grounders.relational(world.frames(world.episodes(spark, rows).repartition(6)).persist(), blind)
    got = {r.rollout_id: r.success.verdict for r in grading.cards(g, grading.Config(signals=("binding_health",), policy=())).collect()}
    assert got == {"a_success": "pass", "a_miss": "fail", "a_drop": "fail", "b_success": "pass", "b_miss": "fail", "b_drop": "fail"}


def test_compiler_refuses(spark):
    walks = world.frames(world.episodes(spark, [(f"w{i}", "random", i, N, "a") for i in range(3)]))
    with pytest.raises(SpecError, match="REFUSE"):
        compiler.compile_spec(walks, "anything")
    with pytest.raises(SpecError, match="at least 2 demos"):
        compiler.compile_spec(walks.filter("path = 'w0'"), "anything")


def test_negatives(spark):
    rows = spark.createDataFrame([("d", t, t * 10) for t in range(20)], "path string, t int, x int")
    got = {}
    for r in compiler.minted(rows).orderBy("t").collect():
        assert r.path == f"d#neg_{r.kind}"
        got.setdefault(r.kind, []).append(r.x // 10)
    assert got == {"reversed": list(range(19, -1, -1)), "frozen": [*range(8), *[7] * 12], "truncated": [*range(10), *[9] * 10], "stalled": [0, 1, 2] * 6 + [0, 1]}


NAMES = [(k, n) for k in ("grounder", "gate_signal", "channel") for n in components.names(k) if n != "openvocab.gdino_sam" and not n.startswith("test.")]


@pytest.mark.parametrize(("kind", "name"), NAMES)
def test_conformance(spark, kind, name):
    assert set(conformance.run(kind, components.find(kind, name)(), spark).values()) == {"ok"}


def test_conformance_finds_what_is_broken(spark):
    from gradewright.operators import episode as E

    class Loud:
        name, version, caps = "test.loud", "1", builtin.Caps(value_range=(0.0, 0.5))

        def column(self, spec):
            return E.score("other", F.lit(True), F.lit(0.9), F.lit(1.0), F.lit(""))

    found = conformance.run("channel", Loud(), spark)
    assert "name" in found["contract"] and "confident" in found["honest"] and found["caps"] == "ok"

    class Rude:
        name, version = "", "1"

        def table(self, g):
            raise ValueError("no tracks")

    found = conformance.checks("gate_signal", Rude(), spark)
    with pytest.raises(conformance.Broken, match="name"):
        found["identity"]()
    with pytest.raises(conformance.Broken, match="not an error"):
        found["honest"]()
    assert components.names("grounder") == ["blob.color", "frames.passthrough", "openvocab.gdino_sam", "relational.motion"] and len(components.names("gate_signal")) >= 7
    with pytest.raises(MissingDependency):
        components.find("grounder", "openvocab.gdino_sam")().ground(None, insertion_spec())


def test_run_over_files(spark, tmp_path):
    for name, kind in (("ok one", "success"), ("miss", "fail_miss")):
        hand, _, _ = world.truth(kind, 1, N, world.SCENES["a"])
        files.save_episode(str(tmp_path / "in" / name), name, world.made(kind, 1, N, "a"), np.diff(hand, axis=0, prepend=hand[:1]), policy=kind)
    store = str(tmp_path / "store")
    cards = {r.rollout_id: r for r in grading.grade(spark, str(tmp_path / "in"), insertion_spec(), str(tmp_path / "out"), store=store).collect()}
    assert cards["ok one"].success.verdict == "pass" and cards["ok one"].file == "ok_one.json" and cards["miss"].success.verdict == "fail" and cards["miss"].policy == "fail_miss"
    broken = tmp_path / "in" / "bad"
    files.save_episode(str(broken), "bad", world.made("success", 2, 5, "a"))
    (broken / "frames.npz").write_bytes(b"junk")
    with pytest.raises(PluginError, match="1 of 3 rollouts failed.*bad"):
        grading.grade(spark, str(tmp_path / "in"), insertion_spec(), str(tmp_path / "out2"), store=store)
    assert spark.read.parquet(str(tmp_path / "out2" / "cards")).count() == 2
    record = json.loads(spark.read.text(str(tmp_path / "out2" / "manifest")).first()[0])
    assert record["status"] == "failed" and record["cache_hit"] is True and record["failed"] == 1
    twice = spark.createDataFrame([("a b",), ("a_b",)], "id string")
    with pytest.raises(PluginError, match="share the file name"):
        grading.refuse_duplicates(twice)
    with pytest.raises(StoreError):
        grading.frames_digest(files.frames(spark, str(tmp_path / "in")).limit(0))


def test_judged_progress(spark):
    frames = world.frames(world.episodes(spark, [("s", "success", 1, N, "a"), ("m", "fail_miss", 1, N, "a")])).persist()
    scored = {}
    for style in ("lines", "prose"):
        asked = judges.ask(frames, lambda style=style: world.ProgressOracle(style=style), "put it in")
        scored[style] = {r.rollout_id: r.score for r in replies.progress(asked, ["rollout_id"]).collect()}
    assert scored["lines"] == scored["prose"]
    s, m = scored["lines"]["s"], scored["lines"]["m"]
    assert s.status == "ok" and s.value > 0.85 > m.value and s.details["voc"] > 0.9 and s.details["reshuffle_agreement"] == 1.0


def test_http_judge():
    said = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            said.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            body = json.dumps({"choices": [{"message": {"content": "Frame 1: 40%"}}]} if self.path == "/ok" else {"choices": []}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    image = np.zeros((2, 3, 3), np.uint8)
    assert judges.HttpJudge(f"{at}/ok", "m").complete([image], "how far?") == "Frame 1: 40%"
    assert said[0]["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,iVBOR")
    with pytest.raises(InfraError):
        judges.HttpJudge(f"{at}/bad", "m").complete([image], "how far?")
    server.shutdown()
    server.server_close()
    with pytest.raises(InfraError):
        judges.HttpJudge(f"{at}/ok", "m", timeout=2).complete([image], "how far?")


def test_embeddings_videos_views(spark, tmp_path):
    frames = spark.createDataFrame([("p", t, 4, 6, bytearray([t * 10 + 1] * 72)) for t in range(3)], "path string, t int, h int, w int, pixels binary")
    v = embedding.embed_frames(frames, lambda: lambda x: x.mean(axis=(2, 3)), 2).orderBy("t").collect()
    assert len(v) == 3 and all(sum(c * c for c in r.emb) == pytest.approx(1) for r in v)
    (tmp_path / "a.mp4").write_bytes(b"two")
    (tmp_path / "b.mkv").write_bytes(b"bad")

    def decoder():
        def decode(content):
            if content == b"bad":
                raise ValueError("no stream")
            return np.full((2, 8, 16, 4), 7), float("nan")

        return decode

    d = {(r.path.rsplit("/", 1)[1], r.t): r for r in video.decoded(spark, str(tmp_path), 4, decoder).collect()}
    assert (d["a.mp4", 1].h, d["a.mp4", 1].w, d["a.mp4", 1].fps) == (2, 4, 10.0) and bytes(d["a.mp4", 0].pixels) == b"\x07" * 24 and "no stream" in d["b.mkv", None].error
    store = Store(spark, str(tmp_path / "store"))
    assert [video.decoded_once(store, str(tmp_path), "stub", 4, decoder)[1] for _ in range(2)] == [False, True]
    joined = video.joined_views(frames, frames, frames.filter("t < 2")).orderBy("t").collect()
    assert [(r.t, r.h, r.w) for r in joined] == [(0, 6, 6), (1, 6, 6)]
    marks = video.marked(frames, spark.createDataFrame([("p", "hand", 1, 3.0, 2.0)], "rollout_id string, role string, t int, x double, y double"), {"hand": (9, 9, 9)}).orderBy("t").collect()
    assert bytes(marks[0].pixels) == b"\x01" * 72 and bytes(marks[1].pixels).count(9) == 60


def test_open_vocabulary(spark):
    spec = TaskSpec("t", "p", (Role("red_block", motion="co_moves_with_effector", candidates=("Red block",)), Role("cup", motion="static"), Role("ghost", required=False)))
    box = lambda x, s: (x, 0.0, x + 10, 10.0, s)
    found = [("r", t, 0, "a red block on it", *box(3.0 * t, 0.9)) for t in (0, 8, 24)] + [("r", t, 1, "cup", *box(50.0 if t < 16 else 95.0, 0.8)) for t in (0, 8, 16, 24)]
    d = spark.createDataFrame(found, "rollout_id string, t int, k long, label string, x0 double, y0 double, x1 double, y1 double, score double")
    samples = spark.createDataFrame([("r", t, 32, 120.0) for t in (0, 8, 16, 24)], "rollout_id string, t int, n int, diagonal double")
    g = grounders.open_vocabulary(d, samples, spec)
    b = {r.role: r for r in g.bindings.collect()}
    assert (b["red_block"].bound, b["red_block"].quality, b["ghost"].bound, b["ghost"].reason) == (True, 0.75, False, "nothing detected")
    assert b["cup"].quality == 0.75 * 0.25 and "static" in b["cup"].reason  # it jumped beyond the leash, then too far for a thing that stands still
    t = {r.t: r for r in g.tracks.filter("role = 'red_block'").collect()}
    assert len(t) == 32 and (t[4].x, t[16].x, t[24].x, t[25].x) == (17.0, 53.0, 77.0, None) and (t[9].vis, t[17].vis, t[31].vis) == (0.9, 0.0, 0.9)


def test_specifications():
    s = insertion_spec()
    assert spec_from_yaml(s.to_yaml()).content_hash() == s.content_hash() and spec_from_dict(s.to_dict()).to_dict() == s.to_dict()
    assert [p.name for p in s.ordered_phases()] == ["approach", "insert", "settle"] and s.success[0].describe() == "contained(carried_object, receptacle)"
    other = dataclasses.replace(s, spec_provenance=dataclasses.replace(s.spec_provenance, compiler="x"))
    assert other.content_hash() == s.content_hash() != dataclasses.replace(s, version=2).content_hash()
    for bad in (lambda: Predicate("flies", "a"), lambda: Predicate("contained", "a"), lambda: Role("a", motion="wild"), lambda: clean("a\x07"), lambda: Phase("x\u2028y"), lambda: s.role("nobody"),
                lambda: spec_from_dict({"name": "n", "prompt": "p", "roles": [], "color": 1}), lambda: spec_from_dict({"name": "n"}), lambda: spec_from_dict(s.to_dict() | {"schema_version": 9}), lambda: spec_from_yaml("- a")):
        with pytest.raises(SpecError):
            bad()
    assert clean("a\n\tb é") and s.with_tolerance(2).content_hash() == s.content_hash()

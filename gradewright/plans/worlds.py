"""The drawn world's tracks, sets and templates as queries; they need no table but the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewright.operators import grounders
from gradewright.sources import domain as D
from gradewright.spec import insertion_spec, transport_phases
from gradewright.synthetic import world

FRAMES = 60
_SEEDLESS = [k for k in world.KINDS if k != "random"]


def drawn_tracks(s, d):
    """Hand and block of every seedless kind of episode, in closed form."""
    t = s.range(FRAMES).select(F.col("id").cast("int").alias("t"), F.explode(F.array(*map(F.lit, _SEEDLESS))).alias("kind"))
    names = ("hand_x", "hand_y", "block_x", "block_y")
    return t.select("kind", "t", *[c.alias(n) for c, n in zip(world.closed_form(F.col("kind"), F.col("t"), FRAMES), names)])


def listed(rows):
    label = F.create_map(*[F.lit(x) for pair in world.KINDS.items() for x in pair])[F.element_at(F.split("kind", ":"), -1)]
    return rows.select("path", "kind", "seed", label.alias("label"))


def template(s, d):
    rows = [(i, p.name, q.kind, q.subject, q.object, q.params.get("tol_rel")) for i, p in enumerate(transport_phases()) for q in p.active]
    return s.createDataFrame(rows, "place long, name string, kind string, subject string, object string, tol_rel double")


def passed_through(s, d):
    frames = D.table(s, d, "events").select(F.col("user_id").cast("string").alias("path"))
    return grounders.passthrough(frames, insertion_spec()).bindings.select("rollout_id", "role", "bound", "quality", "reason")


QUERIES = {
    "s18_drawn_tracks": drawn_tracks,
    "s19_dataset": lambda s, d: listed(world.dataset(s)),
    "s21_benchmark": lambda s, d: world.benchmark(s).select("path", "kind", "seed", "is_broken"),
    "z4_phase_template": template,
    "r3_passthrough": passed_through,
}

_A = world.SCENES["a"]
_X, _Y = _A.rest
_ARRIVE, _DROP, _GONE = int(FRAMES * world.ARRIVE), int(FRAMES * world.DROP), int(FRAMES * world.VANISH)
_LEAVE = _ARRIVE + world.RELEASE

ORACLES = {
    "s18_drawn_tracks": ("hand_x hand_y block_x block_y", f"""WITH k(kind, gx) AS (VALUES ('success', {_X}), ('fail_miss', {_A.beside()}), ('fail_drop', {_X}), ('vanish', {_X})), b AS (SELECT kind, gx, t::INT AS t, CASE WHEN kind = 'fail_drop' THEN least(t, {_DROP - 1}) ELSE least(t, {_LEAVE - 1}) END AS held, CASE WHEN kind = 'fail_drop' THEN t ELSE least(t, {_LEAVE - 1}) END AS hand FROM k, range(0, {FRAMES}) u(t)),
e AS (SELECT *, pow(least(1, held / {_ARRIVE}::DOUBLE), 2) * (3 - 2 * least(1, held / {_ARRIVE}::DOUBLE)) AS sb, pow(least(1, hand / {_ARRIVE}::DOUBLE), 2) * (3 - 2 * least(1, hand / {_ARRIVE}::DOUBLE)) AS sh,
  CASE WHEN kind <> 'fail_drop' AND t >= {_LEAVE} THEN pow(least(1, (t - {_LEAVE}) / {world.RETREAT}::DOUBLE), 2) * (3 - 2 * least(1, (t - {_LEAVE}) / {world.RETREAT}::DOUBLE)) ELSE 0 END AS back FROM b)
SELECT kind, t, {_A.start} + (gx - {_A.start}) * sh - {world.AWAY[0]} * back AS hand_x, {world.HEIGHT / 2} + ({_Y - world.HANG} - {world.HEIGHT / 2}) * sh + {world.AWAY[1]} * back AS hand_y,
  CASE WHEN kind <> 'vanish' OR t < {_GONE} THEN {_A.start} + (gx - {_A.start}) * sb END AS block_x, CASE WHEN kind <> 'vanish' OR t < {_GONE} THEN {world.HEIGHT / 2} + ({_Y - world.HANG} - {world.HEIGHT / 2}) * sb + {world.HANG} END AS block_y FROM e"""),
    "s19_dataset": ("", "SELECT path, regexp_replace(path, '_[0-9]+$', '') AS kind, seed::BIGINT AS seed, CASE WHEN path LIKE 'success%' THEN 'success' ELSE 'fail' END AS label FROM (VALUES ('success_00', 0), ('success_01', 1), ('fail_miss_00', 2), ('fail_miss_01', 3), ('fail_drop_00', 4), ('vanish_00', 5), ('random_00', 6)) v(path, seed)"),
    "s21_benchmark": ("", f"SELECT name || '_s' || seed AS path, kind, seed::BIGINT AS seed, is_broken FROM range(0, 3) u(seed), (VALUES ('success', 'success', false), ('fail_miss', 'fail_miss', false), {', '.join(f'''('{c}', '{c}:success', true)''' for c in world.CORRUPTIONS)}) v(name, kind, is_broken)"),
    "z4_phase_template": ("tol_rel", "SELECT place::BIGINT AS place, name, kind, 'carried_object' AS subject, CASE WHEN place < 2 THEN 'receptacle' END AS object, CASE WHEN place = 1 THEN 2.5 END::DOUBLE AS tol_rel FROM (VALUES (0, 'approach', 'approaching'), (1, 'arrive', 'co_located'), (2, 'settle', 'stationary')) v(place, name, kind)"),
    "r3_passthrough": ("quality", "SELECT rollout_id, role, false AS bound, 0.0::DOUBLE AS quality, 'objects are not grounded' AS reason FROM (SELECT DISTINCT user_id::VARCHAR AS rollout_id FROM events), (VALUES ('carried_object'), ('receptacle'), ('gripper')) v(role)"),
}

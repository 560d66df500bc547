"""Entities are found in drawn frames, and roles follow from their motion."""

import numpy as np

from gradewright import __main__ as cli
from gradewright.operators import induction


def test_drawn_scene(spark):
    rows = []
    for t in range(20):
        f = np.full((60, 80, 3), 120, np.uint8)
        f[40:52, 60:72] = (30, 30, 200)  # stays
        x = 4 + 2 * t
        f[44:50, x : x + 8] = (200, 30, 30)  # is carried to it
        y = max(0, 40 - 4 * t) if t > 10 else 30
        f[y : y + 6, x : x + 8] = (30, 200, 30)  # carries, then leaves
        rows.append(("clip", t, 60, 80, bytearray(f.tobytes())))
    frames = spark.createDataFrame(rows, "path string, t int, h int, w int, pixels binary")
    found = induction.entities(frames).cache()
    centre = {r["entity"]: (r["x"], r["y"]) for r in found.filter("t = 19").collect()}
    got = induction.roles(found, ["path"], 100.0).first()
    assert len(centre) == 3 and centre[got.receptacle] == (65.5, 45.5) and centre[got.carried] == (45.5, 46.5)
    assert centre[got.effector][1] < 10 and not got.ambiguous


def test_command_line(capsys):
    assert cli.main(["version"]) == 0 and cli.main(["doctor"]) == 0
    assert "pyspark: found" in capsys.readouterr().out


def test_grade_and_report(spark, capsys, tmp_path):
    from gradewright.sources import files
    from gradewright.spec import insertion_spec
    from gradewright.synthetic import world

    (tmp_path / "spec.yaml").write_text(insertion_spec().to_yaml())
    for k in ("success", "fail_miss"):
        files.save_episode(str(tmp_path / "in" / k), k, world.made(k, 9, 60, "a"), policy=k)
    assert cli.main(["grade", str(tmp_path / "in"), str(tmp_path / "spec.yaml"), "--out", str(tmp_path / "out")]) == 0
    assert "fail: 1\npass: 1" in capsys.readouterr().out
    (tmp_path / "golds.json").write_text('{"success": true, "fail_miss": "fail"}')
    assert cli.main(["report", str(tmp_path / "out" / "cards"), "--golds", str(tmp_path / "golds.json"), "--html", str(tmp_path / "r.html")]) == 0
    said = capsys.readouterr().out
    assert "| success | 1 | 1 | 0 | 1.00 |" in said and said.index("| success |") < said.index("| fail_miss |") and "skipped" in said and "## Ranks" in said
    page = (tmp_path / "r.html").read_text()
    assert page.count("<tr>") == 6 and "success.predicates=1.000" in page

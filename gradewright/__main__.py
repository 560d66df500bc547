"""Command line: version, doctor, demo, compile, grade, report."""

from __future__ import annotations

import argparse
import importlib.util
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gradewright", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("version")
    verbs.add_parser("doctor", help="which packages are here")
    p = verbs.add_parser("demo", help="draw the default set of episodes, grade it and print its leaderboard")
    p.add_argument("--frames", type=int, default=60)
    p = verbs.add_parser("compile", help="a specification from a folder of demos")
    p.add_argument("demos", help="folder of successful episodes")
    p.add_argument("prompt")
    p.add_argument("--out", required=True, help="the YAML file to write")
    p.add_argument("--name", default="compiled-task")
    p = verbs.add_parser("grade", help="grade a folder of episodes against a specification")
    p.add_argument("rollouts")
    p.add_argument("spec", help="YAML file")
    p.add_argument("--out", required=True)
    p.add_argument("--store")
    p.add_argument("--grounder", default="blob.color")
    p = verbs.add_parser("report", help="leaderboard and statistics of graded cards")
    p.add_argument("cards", help="folder of cards as `grade` writes them")
    p.add_argument("--golds", help="JSON of rollout ids and outcomes")
    p.add_argument("--html", help="file of an HTML page")
    args = parser.parse_args(argv)
    if args.verb == "version":
        from gradewright import VERSION

        print(VERSION)
        return 0
    if args.verb == "doctor":
        needed, optional = ("pyspark", "numpy", "pandas", "pyarrow", "yaml"), ("imageio",)
        found = {p: importlib.util.find_spec(p) is not None for p in (*needed, *optional)}
        print("\n".join(f"{p}: {'found' if ok else 'missing' + (' (optional)' if p in optional else '')}" for p, ok in found.items()))
        return 0 if all(found[p] for p in needed) else 1

    from pyspark.sql import SparkSession

    from gradewright import compiler, grading, reports
    from gradewright.operators import grounders
    from gradewright.sources import files
    from gradewright.spec import insertion_spec, spec_from_yaml
    from gradewright.synthetic import world

    spark = SparkSession.builder.appName("gradewright").getOrCreate()
    if args.verb == "demo":
        from pyspark.sql import functions as F

        rows = world.dataset(spark, n=args.frames)
        g = grounders.colour(world.frames(rows.repartition(rows.count())).persist(), insertion_spec(), rows.select(F.col("path").alias("rollout_id"), F.col("kind").alias("policy")))
        print(reports.markdown(grading.cards(g, grading.Config()).persist()))
    elif args.verb == "compile":
        frames = files.frames(spark, args.demos)
        Path(args.out).write_text(compiler.compile_spec(frames.persist(), args.prompt, args.name).to_yaml(), encoding="utf-8")
    elif args.verb == "grade":
        cards = grading.grade(spark, args.rollouts, spec_from_yaml(Path(args.spec).read_text(encoding="utf-8")), args.out, grading.Config(grounder=args.grounder), args.store)
        print("\n".join(f"{r.verdict}: {r.n}" for r in cards.groupBy("success.verdict").agg(*_count()).orderBy("verdict").collect()))
    else:
        cards = spark.read.parquet(args.cards)
        golds = files.golds(spark, args.golds) if args.golds else None
        print(reports.markdown(cards, golds))
        if args.html:
            Path(args.html).write_text(reports.page(cards, golds), encoding="utf-8")
    return 0


def _count() -> list:
    from pyspark.sql import functions as F

    return [F.count("*").alias("n")]


if __name__ == "__main__":
    sys.exit(main())

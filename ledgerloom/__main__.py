"""Command line: ``python -m ledgerloom <stage> ...`` over TSV records and Parquet stages.

    prepare   clean records, retrieve candidates with features; labelled ones, given the truth
    tune      fit a run on labelled pairs and tell what it reaches out of fold
    compare   the runs' files as a table, the best first
    submit    fit a run on labelled pairs and write the match lists of other queries
    evaluate  match lists against the truth
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_records
from ledgerloom.operators import metrics as M
from ledgerloom.operators import splits
from ledgerloom.plans import linkage
from ledgerloom.sources import tables


def _settings(name: str) -> linkage.Settings:
    known = {s.name: s for s in linkage.pipelines(vectors=True)}
    if name not in known:
        raise SystemExit(f"no run {name}; there are {', '.join(known)}")
    return known[name]


def _entities(spark: SparkSession, path: str) -> DataFrame:
    return splits.folds(tables.read_truth(spark, path, strict=True)[1], "q", [])


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    queries, pool = (clean_records(tables.read_records(spark, p, strict=True)) for p in (a.queries, a.pool))
    truth = tables.read_truth(spark, a.truth, strict=True)[0] if a.truth else None
    tables.write_table(linkage.features_of(queries, pool, _settings(a.run), truth), a.out)


def tune(spark: SparkSession, a: argparse.Namespace) -> None:
    began, settings = time.time(), _settings(a.run)
    entities, pairs = _entities(spark, a.truth), spark.read.parquet(a.pairs)
    found = linkage.evaluate(settings, pairs, entities)
    tables.write_table(found, f"{a.out}/{settings.name}/pairs")
    told = linkage.report(spark.read.parquet(f"{a.out}/{settings.name}/pairs"), entities)
    rows = {k: [r.asDict() for r in t.collect()] for k, t in told.items()}  # each of a bounded number of rows
    run = {"name": settings.name, "parent": settings.parent, "settings": linkage.describe(settings), "macro_f05": rows["overall"][0]["macro_f05"], "wall_s": time.time() - began, "report": rows}
    spark.createDataFrame([(tables.to_json(run),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/{settings.name}/run.json")


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.leaderboard(spark, f"{a.out}/*/run.json").select("name", "parent", "macro_f05", "wall_s").show(100, truncate=False)


def submit(spark: SparkSession, a: argparse.Namespace) -> None:
    bundle = linkage.fit_bundle(_settings(a.run), spark.read.parquet(a.pairs), _entities(spark, a.truth))
    queries, pool = (tables.read_records(spark, p, strict=True) for p in (a.queries, a.pool))
    tables.write_lists(linkage.link(bundle, queries, pool), a.out)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    truth, entities = tables.read_truth(spark, a.truth, strict=True)
    predicted = tables.read_truth(spark, a.lists)[0]
    M.match_sets(predicted, truth, entities).show(truncate=False)


STAGES = {"prepare": (prepare, "queries pool truth? run out"), "tune": (tune, "pairs truth run out"), "compare": (compare, "out"), "submit": (submit, "pairs truth queries pool run out"), "evaluate": (evaluate, "lists truth")}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("ledgerloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    stages = out.add_subparsers(dest="stage", required=True)
    for name, (_, options) in STAGES.items():
        stage = stages.add_parser(name)
        for o in options.split():
            stage.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?") and o != "run", default="P8" if o == "run" else None)
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"ledgerloom {a.stage}").getOrCreate()
    STAGES[a.stage][0](spark, a)


if __name__ == "__main__":
    main()

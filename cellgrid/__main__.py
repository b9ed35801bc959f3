"""Command line: ``python -m cellgrid COMMAND …``; ``--help`` lists the commands."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellgrid.plans import engines
from cellgrid.plans.config import load_config
from cellgrid.plans.workflow import Build, load_deck, save_card
from cellgrid.sources import formats
from cellgrid.sources.tables import bundle_of_files, open_matrix, write_matrix

def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellgrid")
    top.add_argument("--verbosity", default="info", choices=("error", "warning", "info", "debug"))
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *positional: str, deck: bool = True) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=text)
        for p in (("deck", "samples", "out") if deck else ()) + positional:
            own.add_argument(p)
        if deck:
            own.add_argument("--annotations", help="folder of tag definitions")
            own.add_argument("--species-genes", help="YAML file of gene categories")
            own.add_argument("--species", help="species whose categories are masked")
        return own

    build = command("build", "plan a deck, or run it with --run")
    build.add_argument("--engine", default="local", choices=("local", "condor"))
    build.add_argument("--run", action="store_true", help="without it, the plan is printed")
    command("process", "run one task", "task")
    command("pool", "pool the leaves")
    command("subset", "list the sizes of a card's subsets", "card")
    split = command("split", "write a card that divides a finished task", "task")
    split.add_argument("--method", default="coverage", choices=("coverage", "dendrogram", "cluster", "paris"))
    split.add_argument("--thresh", type=float, default=None)
    merge = command("merge", "merge a finished task's weak clusters", "task")
    merge.add_argument("--threshold", type=int, default=1)
    tasks = commands.add_parser("tasks", help="list a deck's tasks and what they need")
    tasks.add_argument("deck")
    command("qc", "report on the samples' quality", "samples", "out", deck=False)
    command("make", "make a matrix bundle from a MatrixMarket file and tab-separated cells and genes", "matrix", "cells", "genes", "bundle", deck=False)
    return top


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    logging.basicConfig(level=given.verbosity.upper())
    spark = SparkSession.builder.appName("cellgrid").getOrCreate()
    if given.command == "tasks":
        print("\n".join(f"{t}: {' '.join(d)}" for t, d in load_deck(given.deck, spark).tasks().items()))
        return
    if given.command == "make":
        write_matrix(bundle_of_files(spark, given.matrix, given.cells, given.genes), given.bundle)
        return
    if given.command == "qc":
        from cellgrid.operators.qc import qc_report

        report = qc_report(open_matrix(spark, given.samples), load_config(given.out)["params"])
        report.write.mode("overwrite").parquet(f"{given.out}/qc")
        report.show(1000, truncate=False)
        return
    rules = formats.annotation_folder(spark, given.annotations) if given.annotations else (None, None)
    categories = {} if rules[1] is None else {r["category"]: r["tags"] for r in rules[1].groupBy("category").agg(F.collect_list("tag").alias("tags")).collect()}
    species = formats.species_genes(spark, given.species_genes) if given.species_genes else None
    build = Build(spark, load_deck(given.deck, spark), given.samples, given.out, load_config(given.out), rules[0], species, given.species, categories)
    if given.command == "build" and given.engine == "condor":
        for name, text in engines.job_files(build, sys.executable + " -m cellgrid", f"{given.out}/condor").items():
            formats.put_bytes(spark, f"{given.out}/condor/{name}", text.encode())
        print("\n".join(build.plan()))
    elif given.command == "build":
        print("\n".join(build.run(dry=not given.run)))
    elif given.command in ("process", "pool"):
        build.process(given.task if given.command == "process" else "Pool")
    elif given.command == "subset":
        for r in build.assigned(given.card).groupBy("subset").agg(F.count("*").alias("n")).orderBy("subset").collect():
            print(f"{r['subset'] or '-'}\t{r['n']}")
    elif given.command == "split":
        card = build.split(given.task, given.method, given.thresh)
        if card:
            save_card(spark, given.deck, given.task, card)
        print(card or "not divided")
    elif given.command == "merge":
        print(f"{build.merge(given.task, given.threshold)} clusters")


if __name__ == "__main__":
    main()

"""python -m stayflow.cli COMMAND [--config FILE] [--tables DIR] [--output DIR]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from stayflow.config import Config
from stayflow.plans import runs
from stayflow.sources.store import release_all

COMMANDS = {"extract": runs.extract_run, "tokenize": runs.tokenize_run, "train": runs.train_run, "evaluate": runs.evaluate_run, "run-all": runs.run_all, "ablation": runs.ablation_run}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stayflow", description="Clinical event sequences on Spark.")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--config", help="settings as JSON or YAML")
    p.add_argument("--tables", help="folder of the source tables")
    p.add_argument("--prefix", help="what stands before a table's name in its file name")
    p.add_argument("--ecg-csv", help="waveform prototypes")
    p.add_argument("--output", help="folder of the results")
    p.add_argument("--n-patients", type=int, help="about so many patients, in proportion to the split")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = Config.load(args.config)
    for name, value in (("tables", args.tables), ("prefix", args.prefix), ("ecg_csv", args.ecg_csv), ("output", args.output)):
        if value:
            setattr(config.data, name, value)
    if args.n_patients:
        config.extraction.n_patients = args.n_patients
    spark = SparkSession.builder.appName("stayflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        result = COMMANDS[args.command](spark, config)
    finally:
        release_all(spark)
    for r in result if isinstance(result, list) else [result]:
        print(runs.as_text(r) if isinstance(r, runs.StageResult) else r)
    return int(any(isinstance(r, runs.StageResult) and not r.success for r in (result if isinstance(result, list) else [result])))


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: run a matrix of experiments, a smoke run of the synthetic data set, or the contracts of one data set."""

from __future__ import annotations

import argparse
import json
import logging
import random

import numpy as np
from pyspark.sql import SparkSession

from textloom.operators import validation
from textloom.plans import matrix

log = logging.getLogger("textloom")


def seeded(seed: int) -> None:
    """Seeds of the driver; plans draw by hash of their own seeds."""
    random.seed(seed)
    np.random.seed(seed)


def validated(spark: SparkSession, dataset: dict) -> dict:
    """The diagnostics of a data set; raises where it breaks its contract."""
    bundle = matrix.DATASETS[dataset["name"]](spark, dataset)
    validation.check(validation.bundle_violations(bundle))
    said = validation.diagnostics(bundle).head().asDict()
    rules = dataset.get("validation", {})
    validation.check_mapping(bundle, rules.get("minimum_mapping_rate", 0.95), rules.get("fail_on_mapping_error", True))
    return said


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--config", help="YAML file of an experiment")
    what.add_argument("--smoke", action="store_true", help="two methods on the synthetic data set")
    what.add_argument("--validate", metavar="CONFIG", help="YAML file of a data set, whose contracts are checked")
    parser.add_argument("--output", default="outputs", help="folder of a smoke run")
    parser.add_argument("--log-level", default="INFO")
    said = parser.parse_args(args)
    logging.basicConfig(level=said.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = spark or SparkSession.builder.getOrCreate()
    if said.validate:
        import yaml

        with open(said.validate, encoding="utf-8") as file:
            config = yaml.safe_load(file)
        try:
            print(json.dumps(validated(spark, config.get("dataset", config))))
        except validation.EngineError as error:
            log.error("%s", error)
            return 1
        return 0
    if said.smoke:
        e = matrix.Experiment("smoke", [{"name": "synthetic", "split": "test"}], [{"name": "fixed_256"}, {"name": "sentence_fixed_256"}], said.output)
    else:
        e = matrix.load(said.config)
    seeded(e.seed)
    out = matrix.run(spark, e)
    print(json.dumps(out, indent=2, default=str))
    log.info("%s: %d completed, %d failed", e.run_name, out["completed_count"], out["failed_count"])
    return 1 if out["failed_count"] else 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: ``python -m trajecta fit`` and ``python -m trajecta predict``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from trajecta.plans import pipeline
from trajecta.sources import read_sessions


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trajecta", description="Trains on session tables and predicts them.")
    commands = parser.add_subparsers(dest="command", required=True)
    fit = commands.add_parser("fit", help="train on labelled sessions and save the model")
    fit.add_argument("sessions")
    fit.add_argument("model")
    fit.add_argument("--models", nargs="*", help="of logit, forest and boosted; all by default")
    fit.add_argument("--folds", type=int, default=pipeline.FOLDS)
    predict = commands.add_parser("predict", help="write id,probability of sessions as CSV")
    predict.add_argument("model")
    predict.add_argument("sessions")
    predict.add_argument("output")
    predict.add_argument("--batch", type=int, help="consecutive ids at a time")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    sessions = read_sessions(spark, given.sessions)
    if given.command == "fit":
        model = pipeline.fit(sessions, folds=given.folds, models=given.models)
        pipeline.save(model, given.model)
        print(json.dumps({"scores": model.scores, "weights": model.weights}))
    else:
        pipeline.predict_to_csv(pipeline.load(spark, given.model), sessions, given.output, given.batch)


if __name__ == "__main__":
    main()

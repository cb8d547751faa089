"""Command line (survey G5, H25): ``python -m lumenar COMMAND``. Stages read and write tables; training and generation belong to whoever has the models."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calibrator, evaluation, evaluator, records
from .plans import ablations, config
from .sources import manifests
from .sources import records as files


def _spark() -> SparkSession:
    return SparkSession.builder.appName("lumenar").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """A table of generations: Parquet, or JSON lines with the schema Spark finds."""
    df = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return df if "_pos" in df.columns else df.withColumn("_pos", F.monotonically_increasing_id())


def prepare(spark: SparkSession, settings: dict, args: argparse.Namespace) -> dict:
    data = settings["data"]
    rows = files.read_split_jsonl(spark, data["local_jsonl"], "example_id string, id string, document string, summary string, prompt string, response string, references array<string>, _split string, split string, group_id string, cluster_id int, metadata map<string,string>")
    examples = records.expanded(rows, data["name"])
    return records.prepare(examples, args.out, {s: data[f"{s}_ratio"] for s in ("train", "validation", "test")}, data["split_seed"], data["split_unit"], data["use_official_splits"], args.overwrite)


def calibrate(spark: SparkSession, settings: dict, args: argparse.Namespace) -> dict:
    evaluator.refuse_other_splits(args.split, args.allow_other_split)
    chosen = settings["evaluation"]
    rows = _rows(spark, args.predictions)
    judged = rows.withColumn("outcome", evaluator.correct(evaluator.prediction_of(rows), evaluator.references_of(rows)))
    model = calibrator.fit_calibrator(judged, "outcome", list(chosen["calibration_features"]), chosen["calibration_l2"], chosen["calibration_max_iter"], chosen["calibration_tolerance"])
    model.save(args.out)
    return evaluator.calibration_summary(judged.select("_pos", model.confidence().alias("confidence"), "outcome"), chosen["ece_bins"]).first().asDict()


def evaluate(spark: SparkSession, settings: dict, args: argparse.Namespace) -> dict:
    chosen, rows = settings["evaluation"], _rows(spark, args.predictions)
    if chosen["max_eval_examples"]:
        rows = rows.orderBy("_pos").limit(chosen["max_eval_examples"])
    examples = evaluator.evaluated(rows, chosen["semantic_estimator"], chosen["semantic_confidence_mapping"], by_length=chosen["length_normalize_sequence_probability"])
    manifests.write_jsonl(examples, f"{args.out}/examples")
    out = evaluator.evaluation_metrics(spark.read.json(f"{args.out}/examples").withColumn("correctness", F.col("correctness").cast("double"))).first().asDict()
    files.write_json(f"{args.out}/metrics.json", out)
    return out


def evaluate_ood(spark: SparkSession, settings: dict, args: argparse.Namespace) -> dict:
    source = settings["evaluation"]["confidence_source"]
    side = lambda path: _rows(spark, path).select(evaluation.confidence_of(source).alias("confidence"), F.col("routing_distance").alias("distance"), F.col("routing_margin").alias("margin"), "_pos")
    return evaluation.out_of_distribution(side(args.known), side(args.foreign)).first().asDict()


def aggregate(spark: SparkSession, settings: dict, args: argparse.Namespace) -> dict:
    found = sorted(Path(args.root).glob("*/evaluation/test_metrics.json"))
    long = [(p.parts[-3], k, float(v)) for p in found for k, v in json.loads(p.read_text()).items() if isinstance(v, (int, float))]
    summary = evaluation.seed_summary(spark.createDataFrame(long, "run string, metric string, value double"), F.regexp_replace("run", args.seed_pattern, ""))
    rows = [r.asDict() for r in summary.orderBy("run", "metric").collect()]  # a few runs by their measures
    manifests.write_report(args.out, rows)
    Path(f"{args.out}.tex").write_text(files.latex_table(summary, sorted({r["metric"] for r in rows})))
    return {"runs": len({r["run"] for r in rows}), "rows": len(rows)}


COMMANDS = {"prepare": prepare, "calibrate": calibrate, "evaluate": evaluate, "evaluate-ood": evaluate_ood, "aggregate": aggregate, "list-ablations": lambda *_: ablations.described()}
#: Options of each command beside those of all; those without default must be given.
OPTIONS = {"prepare": {"out": None, "overwrite": False}, "calibrate": {"predictions": None, "out": None, "split": "validation", "allow-other-split": False}, "evaluate": {"predictions": None, "out": None}, "evaluate-ood": {"known": None, "foreign": None}, "aggregate": {"root": None, "out": None, "seed-pattern": r"_s\d+$"}, "list-ablations": {}}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenar")
    commands = top.add_subparsers(dest="command", required=True)
    for name, options in OPTIONS.items():
        own = commands.add_parser(name)
        own.add_argument("--config")
        own.add_argument("--set", action="append", default=[], metavar="section.key=value")
        own.add_argument("--ablation", action="append", default=[])
        for option, default in options.items():
            own.add_argument(f"--{option}", **({"action": "store_true"} if default is False else {"required": default is None, "default": default}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = config.load(args.config, args.set, args.ablation)
        out = COMMANDS[args.command](_spark() if args.command != "list-ablations" else None, settings, args)
    except Exception as e:  # noqa: BLE001 - a command fails with its message
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())

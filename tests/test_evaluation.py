"""Evaluation of records, losses, samplers, manifests, configuration and the command line, against values worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lumenar.__main__ import main
from lumenar.functions import losses, numeric
from lumenar.functions.text import tokens
from lumenar.operators import evaluator, records, sampling, semantic
from lumenar.plans import ablations, config
from lumenar.sources import manifests

SAMPLE = "struct<text:string,sequence_log_probability:double,token_count:int>"


def test_evaluated_records(spark):
    rows = [(0, "a", "Paris", ["paris "], [("Paris", math.log(0.4), 1), ("PARIS", math.log(0.2), 1), ("Rome", math.log(0.4), 1)]), (1, "b", "x y", ["z"], [("x", 4 * math.log(0.5), 4), ("y", math.log(0.5), 1), ("y", math.log(0.5), 1)])]
    df = spark.createDataFrame(rows, f"_pos long, example_id string, generation string, target array<string>, samples array<{SAMPLE}>")
    out = {r.example_id: r for r in evaluator.evaluated(df, "frequency", "max_class_probability").collect()}
    assert out["a"].correctness == 1 and out["b"].correctness == 0 and list(out["a"].semantic_class_ids) == [0, 0, 1]
    assert out["a"].semantic_entropy == pytest.approx(-(2 / 3) * math.log(2 / 3) - math.log(1 / 3) / 3) and out["a"].confidence == pytest.approx(2 / 3)
    weighted = {r.example_id: r for r in evaluator.evaluated(df, "model-probability").collect()}
    assert weighted["a"].semantic_entropy == pytest.approx(-0.6 * math.log(0.6) - 0.4 * math.log(0.4))
    assert weighted["b"].semantic_entropy == pytest.approx(-math.log(1 / 3) / 3 - 2 / 3 * math.log(2 / 3))  # by length all three weigh alike
    summed = {r.example_id: r for r in evaluator.evaluated(df, "kuhn_eq4").collect()}
    assert summed["a"].semantic_entropy == pytest.approx(-(math.log(0.6) + math.log(0.4)) / 2) and summed["b"].confidence == pytest.approx(math.exp(-math.log(2) / 2))
    metrics = evaluator.evaluation_metrics(evaluator.evaluated(df, "frequency")).first()
    assert metrics.num_examples == 2 and metrics.semantic_correctness_rate == 0.5 and metrics.accuracy == metrics.rouge_l_f1 == 0.5
    assert evaluator.percent_scale(evaluator.evaluation_metrics(evaluator.evaluated(df, "frequency"))).first().accuracy == 50
    assert evaluator.evaluated(df.limit(0), "frequency").count() == 0
    for wrong in ({"estimator": "guess"}, {"mapping": "guess"}):
        with pytest.raises(ValueError):
            evaluator.evaluated(df, **wrong)


def test_fields_of_records(spark):
    df = spark.createDataFrame([(0, None, "gold", "said", None), (1, None, "gold", None, None), (2, ["r"], "gold", "said", "first")], "_pos long, references array<string>, response string, output string, prediction string")
    kept = df.filter("_pos <> 1")
    assert [(r.p, list(r.r)) for r in kept.orderBy("_pos").select(evaluator.prediction_of(df).alias("p"), evaluator.references_of(df).alias("r")).collect()] == [("said", ["gold"]), ("first", ["r"])]
    with pytest.raises(Exception, match="without references"):
        df.filter("_pos = 1").select(evaluator.references_of(df)).collect()
    with pytest.raises(Exception, match="log-probability"):
        evaluator.evaluated(kept).collect()
    lists = spark.createDataFrame([(0, "a", ["a"], ["a", "b"], [-2.0, -4.0], [1, 2])], "_pos long, prediction string, references array<string>, samples array<string>, sequence_log_probabilities array<double>, sample_token_counts array<int>")
    assert list(lists.select(evaluator.samples_of(lists, F.col("prediction"))[1].alias("x")).first().x) == [-2.0, -2.0]


def test_equal_forms(spark):
    pairs = [("Ｙes", "yes", 1), (" yes ", "yes", 1), ("STRASSE", "straße", 1), ("  PARIS ", "Paris", 1), ("oui", "non", 0), ("été", "ete", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, same int")
    assert all(r.got == r.same for r in df.select(semantic.correct(F.col("a"), F.array("b")).alias("got"), "same").collect())
    assert spark.createDataFrame([(None, ["a"]), ("a", None), ("a", [None])], "a string, b array<string>").select(semantic.correct(F.col("a"), F.col("b")).alias("x")).collect() == [(None,), (None,), (0.0,)]


def test_batches_and_losses(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4], [24, 25]), (0, [5], [26])], "batch int, prompt_ids array<int>, response_ids array<int>")
    out = losses.collated(df, "batch", 3, 3, 99, 0).orderBy(F.desc(F.size("prompt_ids"))).collect()
    assert list(out[0].input_ids) == [2, 3, 4, 24, 25, 99, 0, 0] and list(out[0].labels) == [-100, -100, -100, 24, 25, 99, -100, -100] and sum(out[1].attention_mask) == 3
    assert list(losses.collated_prompts(df, "batch", 3, 0, 4).orderBy(F.desc(F.size("prompt_ids"))).first().input_ids) == [0, 2, 3, 4]
    assert list(df.select(losses.response_tokens(F.col("response_ids"), [7], 3, 99).alias("x")).first().x) == [7, 24, 99]
    flat = spark.createDataFrame([([[0.0, 0.0], [0.0, math.log(3)], [5.0, 5.0]], [-100, 1, 1], [1, 1, 0])], "logits array<array<double>>, labels array<int>, mask array<int>")
    got = flat.select(losses.shifted_nll(F.col("logits"), F.col("labels")).alias("nll"), losses.first_token_kl(F.col("logits"), F.col("mask")).alias("first"), losses.prefix_kl(F.col("logits"), F.col("labels"), 1).alias("prefix")).first()
    assert got.nll == pytest.approx(math.log(2) - math.log(0.75)) and got.first == pytest.approx(math.log(2) + 0.25 * math.log(0.25) + 0.75 * math.log(0.75)) and got.prefix == pytest.approx(0)
    assert losses.token_mean_nll(flat).first().nll == pytest.approx(got.nll / 2)
    with pytest.raises(Exception, match="finite"):
        flat.select(losses.objective(F.lit(float("nan")), F.lit(0.0), 0.1)).collect()


def test_samplers(spark):
    df = spark.createDataFrame([(f"x{n}", 0 if n < 90 else 1 if n < 100 else None) for n in range(110)], "example_id string, cluster_id int")
    inside, outside = sampling.of_expert(df, 1)
    assert inside.count() == 10 and outside.count() == 100 and sampling.of_expert(df, None)[1].count() == 0
    drawn = sampling.draw_complement(outside, 250, 3, rows_per_bucket=30)
    assert abs(drawn.agg(F.sum("copies")).first()[0] - 250) <= 1 and {r.copies for r in drawn.collect()} <= {2, 3}
    even = {r.cluster_id: r.n for r in sampling.draw_complement(outside, 200, 3, by_cluster=True).groupBy("cluster_id").agg(F.sum("copies").alias("n")).collect()}
    assert abs(even[0] - 100) <= 2 and abs(even[None] - 100) <= 2
    assert sampling.draw_complement(outside.limit(0), 5, 1).count() == 0
    log = spark.createDataFrame([("r", e, x) for e, x in enumerate([3.0, 2.0, 2.5, 2.4, 2.6])], "run string, epoch int, validation_loss double")
    assert [r.stopped for r in sampling.early_stopping(log, 2).orderBy("epoch").collect()] == [False, False, False, False, True]
    assert [r.group_size for r in sampling.accumulation_groups(spark.range(5).toDF("batch"), 2).orderBy("batch").collect()] == [2, 2, 2, 2, 1]


def test_repeated_ids_are_refused(spark):
    df = spark.createDataFrame([("a", "g", "train"), ("a", "h", "train")], "example_id string, group_id string, split string")
    with pytest.raises(ValueError, match="a"):
        records.deterministic_split(df, {"train": 1.0})


def test_manifests(spark, tmp_path):
    assert manifests.latest_run(["x/a__20260101T000000Z", "a__20260301T000000Z", "b__20270101T000000Z", "other"], "a") == "a__20260301T000000Z"
    assert {r.run: r.folder for r in manifests.latest_runs(spark.createDataFrame([("a__20260101T000000Z",), ("a__20260301T000000Z",), ("x",)], "folder string")).collect()} == {"a": "a__20260301T000000Z"}
    for wrong in ("/etc", "../x", "a/../../b", " ", "C:/x"):
        with pytest.raises(ValueError):
            manifests.safe_relative(wrong)
    fine = {k: {"expert_id": k, "method": "k_ft", "completed": True, "packages": {"p": 1}} for k in range(2)}
    manifests.consistent_experts(fine, 2, "k_ft")
    with pytest.raises(ValueError, match="packages"):
        manifests.consistent_experts({0: fine[0], 1: fine[1] | {"packages": {}}}, 2, "k_ft")
    with pytest.raises(ValueError, match="model"):
        manifests.compatible({"model": 1}, {"model": 2})
    path, made = str(tmp_path / "t"), []
    make = lambda: made.append(1) or spark.range(3)
    assert [manifests.cached(path, {"a": k}, make, spark)[1] for k in (1, 1, 2)] == [False, True, False] and len(made) == 2
    with pytest.raises(ValueError):
        manifests.cached(path, {"a": 3}, make, spark, refuse=True)
    manifests.write_report(str(tmp_path / "r"), [{"b": 1}, {"a": 2}])
    assert (tmp_path / "r.csv").read_text().splitlines() == ["a,b", ",1", "2,"]
    assert len(manifests.missing_files(str(tmp_path))) == 5
    (tmp_path / "f").write_text("1")
    assert manifests.files_fingerprint([str(tmp_path / "f")]) == manifests.files_fingerprint([str(tmp_path / "f")])
    assert manifests.has_samples(spark.createDataFrame([(["a", "b"],)], "semantic_samples array<string>"), 2) and not manifests.has_samples(spark.createDataFrame([(["a"],), (None,)], "semantic_samples array<string>"), 2)


@pytest.mark.parametrize("wrong", ["objective.lambda_kl=-1", "objective.method=k_ft", "generation.temperature=0", "generation.top_p=0", "lora.dropout=1", "evaluation.semantic_samples=1", "evaluation.calibration_features=[]", 'evaluation.calibration_features=["x"]', "clustering.num_clusters=1", "clustering.max_clusters=1", "clustering.strategy=random_balanced", "tokenization.pad_to_multiple_of=0", "runtime.device=", "data.max_examples=0", "optimization.optimizer=sgd"])
def test_values_that_are_refused(wrong):
    with pytest.raises(ValueError):
        config.load(pairs=[wrong])


def test_ablations():
    assert len(ablations.ABLATIONS) == 35 and config.load(ablations=["k_ft"])["objective"]["lambda_kl"] == 0
    with pytest.raises(ValueError, match="both set"):
        config.load(ablations=["k_ft", "vanilla_ft"])
    with pytest.raises(ValueError, match="Unknown"):
        config.load(ablations=["x"])


def test_command_line(spark, tmp_path, capsys):
    assert main(["list-ablations"]) == 0 and "paper" in json.loads(capsys.readouterr().out)
    rows = tmp_path / "g.jsonl"
    rows.write_text("\n".join(json.dumps({"example_id": str(n), "prediction": "a" if n % 2 else "b", "references": ["a"], "samples": ["a", "b"]}) for n in range(6)))
    assert main(["evaluate", "--predictions", str(rows), "--out", str(tmp_path / "e"), "--ablation", "frequency_semantic_entropy"]) == 0
    assert json.loads((tmp_path / "e/metrics.json").read_text())["semantic_correctness_rate"] == 0.5
    assert main(["evaluate", "--predictions", str(tmp_path / "none"), "--out", str(tmp_path / "e")]) == 1
    source = tmp_path / "d.jsonl"
    source.write_text("\n".join(json.dumps({"id": f"x{n}", "document": f"d {n}", "summary": "s"}) for n in range(20)))
    capsys.readouterr()
    assert main(["prepare", "--set", "data.name=xsum", "--set", f"data.local_jsonl={source}", "--out", str(tmp_path / "p")]) == 0
    assert json.loads(capsys.readouterr().out) == {"train": 16, "validation": 2, "test": 2}
    for seed in (1, 2):
        (tmp_path / f"runs/r_s{seed}/evaluation").mkdir(parents=True)
        (tmp_path / f"runs/r_s{seed}/evaluation/test_metrics.json").write_text(json.dumps({"brier": seed / 10}))
    assert main(["aggregate", "--root", str(tmp_path / "runs"), "--out", str(tmp_path / "report")]) == 0 and (tmp_path / "report.tex").exists()


def test_the_best_subsequence(spark):
    texts = [("the cat sat on the mat", ["the cat lay on the mat", "a dog"]), ("", ["a"]), ("a", [""]), ("b a b a", ["a b a b", "b b"]), (None, ["a"])]
    df = spark.createDataFrame(texts, "a string, b array<string>").select(tokens(F.col("a")).alias("a"), F.transform("b", lambda r: tokens(r)).alias("b"))
    for r in df.select(numeric.best_rouge_l(F.col("a"), F.col("b")).alias("x"), numeric.best_reference(numeric.rouge_l, F.col("a"), F.col("b")).alias("y")).collect():
        assert r.x == pytest.approx(r.y)
    assert df.select(numeric.best_rouge_l(F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(5 / 6)
    with pytest.raises(Exception, match="no references"):
        df.select(numeric.best_rouge_l(F.col("a"), F.array().cast("array<array<string>>"))).collect()

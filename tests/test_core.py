"""Core operators against SQL on the smallest tables and against plain Python."""

import hashlib
import inspect
import json
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenar import queries
from lumenar.functions import numeric as N
from lumenar.functions import text as X
from lumenar.operators import calibrator as K
from lumenar.operators import clustering as C
from lumenar.operators import evaluation as E
from lumenar.operators import records as R
from lumenar.operators import routing as G
from lumenar.operators import semantic as S
from lumenar.plans import config
from lumenar.sources import records as IO
from lumenar.streaming import scoring

DATA = Path("/root/testdata/sf0.001")


def one(df, column):
    return df.select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = queries.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    plain = lambda v: repr(v + 0.0) if isinstance(v, float) else repr(v)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ｓtraße  É ", None, "")], "a string, b string, c string")
    assert one(df, X.semantic_text(F.col("a"))) == "strasse é" and one(df, X.stripped(F.col("b"))) == "" and one(df, X.tokens(F.col("b"))) == []
    assert one(df, X.split_name(F.lit(" Dev "))) == "validation" and one(df, X.split_name(F.lit(""))) == "all" and one(df, X.split_name(F.lit("x"), strict=False)) is None
    with pytest.raises(Exception, match="Unknown split"):
        one(df, X.split_name(F.lit("x")))
    assert one(df, X.distinct_texts(F.array(F.lit(" a"), F.lit("a "), F.lit(None), F.lit("b")))) == ["a", "b"]
    assert one(df, X.folder_name(F.lit("..a b/c.."))) == "a-b-c" and one(df, X.folder_name(F.col("c"))) == "experiment"
    assert one(df, X.statement(F.lit(" x "), F.lit("Q\nAnswer:"))) == "Q\nAnswer: x"
    assert X.allocation_counts(10, {"a": 0.8, "b": 0.1, "c": 0.1}) == {"a": 8, "b": 1, "c": 1} and X.allocation_counts(1, {"a": 1, "b": 1}) == {"a": 1, "b": 0}


def test_conversations(spark):
    data = [{"id": "s1", "split": "train", "story": "A b.", "questions": ["q1", "q2"], "answers": {"input_text": ["one", "two"]}, "additional_answers": {"0": [{"input_text": "the first"}]}}]
    coqa = spark.createDataFrame(data, "id string, split string, story string, questions array<string>, answers struct<input_text:array<string>>, additional_answers map<string,array<struct<input_text:string>>>")
    out = R.expand_coqa(coqa, use_history=True).orderBy("turn").collect()
    assert out[0].references == ["one", "the first"] and out[1].references == ["two"] and out[1].example_id == "s1:turn-001"
    assert out[1].prompt == "Story: A b.\nQuestion: q1\nAnswer: one\nQuestion: q2\nAnswer:"
    quac = spark.createDataFrame([("d1", "dev", "C.", ["q1"], ["t1"], [{"texts": ["there", "over there"]}], {"texts": ["over there"]})], "dialogue_id string, split string, context string, questions array<string>, turn_ids array<string>, answers array<struct<texts:array<string>>>, orig_answers struct<texts:array<string>>")
    row = R.expand_quac(quac).first()
    assert (row.example_id, row.response, row.references) == ("t1", "over there", ["over there", "there"])
    assert R.expand_coqa(coqa.limit(0)).count() == 0


def test_history_is_one_text_cut_for_each_row(spark):
    data = [(f"e{k % 7}{k}", None if k % 11 == 5 else f"g{k % 3}", (k * 5) % 9, [None, "", "é|ü", "yes", "漢字"][k % 5]) for k in range(60)] + [("x", "empty", 0, ""), ("y", "empty", 1, None), ("z", "empty", 2, "a")]
    df = spark.createDataFrame(data, "example_id string, group_id string, turn int, response string")
    for between in ("|", " · ", ""):
        want = {(r.example_id, r.turn_number, between.join(r.history)) for r in R.with_history(df.filter("group_id is not null"), F.col("group_id"), F.col("turn")).collect()}
        got = R.with_history_text(df, "group_id", "turn", between)
        assert {(r.example_id, r.turn_number, r.history) for r in got.collect()} == want and got.columns == [*df.columns, "turn_number", "history"]
    assert R.with_history_text(df.limit(0), "group_id", "turn").count() == 0
    plan = queries.w6_history(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), -1" in plan and not any("collect_list" in line and "windowspec" in line for line in plan.splitlines())


def test_history_of_a_long_group_is_dealt_among_all_rows(spark):
    data = [(f"h{k:05}", "hot" if k % 10 == 3 else f"g{k // 30}", k, None if k % 50 == 3 else f"é{k} said at length" * 10) for k in range(20_000)]
    df = spark.createDataFrame(data, "example_id string, group_id string, turn int, response string").repartition(3)
    want, so_far = {}, {}
    for key, group, _, said in data:
        want[key] = (len(so_far.setdefault(group, [])), "|".join(so_far[group]))
        so_far[group].append(said or "")
    assert len("|".join(so_far["hot"]).encode()) > R.LONG_TEXT
    got = R.with_history_text(df, "group_id", "turn").withColumn("part", F.spark_partition_id())
    kept = got.select("example_id", "turn_number", F.md5("history").alias("h"), "part", "group_id").collect()
    assert {r.example_id: (r.turn_number, r.h) for r in kept} == {k: (n, hashlib.md5(h.encode()).hexdigest()) for k, (n, h) in want.items()} and len(kept) == len(data)
    parts = {r.part for r in kept}
    assert len(parts) > 1 and {r.part for r in kept if r.group_id == "hot"} == parts
    for part in parts:  # no run of them fills a writer's first 100 values
        run = longest = 0
        for r in (r for r in kept if r.part == part):
            run = run + 1 if r.group_id == "hot" else 0
            longest = max(longest, run)
        assert longest < 100


def test_deterministic_split(spark):
    df = spark.createDataFrame([(f"e{n}", f"g{n // 3}") for n in range(300)], "example_id string, group_id string").withColumn("split", F.lit("x"))
    a = {r.example_id: r.split for r in R.deterministic_split(df, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    b = {r.example_id: r.split for r in R.deterministic_split(df.orderBy(F.desc("example_id")), {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert a == b and len(a) == 300 and list(a.values()).count("train") == 240
    assert all(len({a[f"e{n}"] for n in range(3 * g, 3 * g + 3)}) == 1 for g in range(100))
    assert [r.example_id for r in R.duplicate_ids(df.union(df.limit(1))).collect()] == ["e0"]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_overlap_scores(spark):
    r = random.Random(1)
    pairs = [([r.choice("abcd") for _ in range(r.randrange(8))], [r.choice("abcd") for _ in range(r.randrange(8))]) for _ in range(40)]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, a array<string>, b array<string>")
    for row in df.select("a", "b", N.common_subsequence(F.col("a"), F.col("b")).alias("l"), N.rouge_1(F.col("a"), F.col("b")).alias("r")).collect():
        both = sum(min(row.a.count(t), row.b.count(t)) for t in set(row.a))
        assert row.l == lcs(row.a, row.b) and math.isclose(row.r, 2 * both / (len(row.a) + len(row.b)) if both else 0)


def test_tokens_and_losses(spark):
    df = spark.range(1)
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    ids, labels = N.response_labels(ints(2, 3, 4), ints(24, 25), 8, 8, 99)
    assert one(df, N.padded(ids, F.lit(8), 0)) == [2, 3, 4, 24, 25, 99, 0, 0] and one(df, N.padded(labels, F.lit(8), -100)) == [-100, -100, -100, 24, 25, 99, -100, -100]
    assert one(df, N.generated_length(ints(5, 9, 0, 0), 9, 0)) == 2 and one(df, N.generated_length(ints(5, 6, 0, 0), 9, 0)) == 2 and one(df, N.generated_length(ints(5, 6), 9, 0)) == 2
    assert math.isclose(one(df, N.sequence_nll(ints(-1.0, -2.0, -3.0), ints(-100, 1, 2))), 5.0)
    assert abs(one(df, N.kl_to_uniform(ints(0.25, 0.25, 0.25, 0.25)))) < 1e-12 and math.isclose(one(df, N.entropy(ints(0.5, 0.5, 0.0), 2)), 1.0)
    pooled = F.array(ints(1.0, 2.0), ints(3.0, 4.0), ints(9.0, 9.0))
    assert one(df, N.pooled(pooled, ints(1, 1, 0), "mean")) == [2.0, 3.0] and one(df, N.pooled(pooled, ints(1, 1, 0), "last")) == [3.0, 4.0]


def test_semantic_measures(spark):
    data = [("a", "Yes", math.log(0.5), 0), ("a", " yes", math.log(0.25), 1), ("a", "no", math.log(0.25), 2), ("b", "x", None, 0), (None, "x", 0.0, 0)]
    out = {r.example_id: r for r in S.semantic_rows(spark.createDataFrame(data, "example_id string, text string, log_probability double, _pos long")).collect()}
    assert set(out) == {"a", "b"} and out["a"].classes == 2 and math.isclose(out["a"].confidence, 2 / 3)
    assert math.isclose(out["a"].rao_entropy, -(math.log(0.75) + math.log(0.25)) / 2) and out["b"].weighted_entropy is None
    df = spark.createDataFrame([("p", ["a1", "b1", "a2", "b2"])], "prompt string, answers array<string>")
    same = lambda pairs: [x[0] == y[0] for _, x, y in pairs]
    for transitive in (False, True):
        assert df.select(S.scored_class_ids(same, transitive)("prompt", "answers").alias("i")).first().i == [0, 1, 0, 1]


def facts(spark, data):
    return spark.createDataFrame([(n, float(p), float(y)) for n, (p, y) in enumerate(data)], "_pos long, confidence double, outcome double")


def test_measures_against_brute_force(spark):
    r = random.Random(2)
    data = [(r.randrange(11) / 10, r.random() < 0.5) for _ in range(300)]
    df = E.checked(facts(spark, data))
    hits, misses = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in hits for b in misses) / (len(hits) * len(misses))
    assert math.isclose(E.auroc(df).first().auroc, want)
    order = sorted(range(300), key=lambda n: (-data[n][0], n))
    risks, wrong = [], 0
    for place, n in enumerate(order, 1):
        wrong += not data[n][1]
        risks.append(wrong / place)
    assert np.allclose([x.risk for x in E.risk_coverage(df).orderBy("place").collect()], risks)
    assert E.thinned(E.risk_coverage(df)).count() == 101
    assert sum(x["count"] for x in E.reliability_bins(df, adaptive=True).collect()) == 300
    assert E.auroc(facts(spark, [(0.1, 1), (0.2, 1)])).first().auroc is None
    with pytest.raises(Exception, match="confidence must lie"):
        E.scalar_metrics(E.checked(facts(spark, [(1.5, 1)]))).collect()


def test_calibrator_against_newton(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 400
    lp, count, d, second = -rng.exponential(5, n), rng.integers(1, 30, n), rng.exponential(3, n), 0.0
    second = d + rng.exponential(3, n)
    x = np.column_stack([lp / count, (second - d) / second])
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, 2.0])))).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([lp, count, d, second, y])], "sequence_log_probability double, generated_token_count double, routing_distance double, second_routing_distance double, y double")
    model = K.fit_calibrator(df, "y", ["mean_token_log_probability", "relative_routing_margin"])
    z = np.column_stack([np.ones(n), (x - x.mean(0)) / x.std(0)])
    b = np.zeros(3)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-z @ b))
        pen = np.array([0, 1e-3, 1e-3])
        b -= np.linalg.solve(z.T @ (z * (mu * (1 - mu))[:, None]) / n + np.diag(pen), z.T @ (mu - y) / n + pen * b)
    assert model.converged and np.allclose([model.intercept, *model.weights], b, atol=1e-6)
    model.save(str(tmp_path / "c.json"))
    assert K.Calibrator.load(str(tmp_path / "c.json")) == model
    assert K.fit_calibrator(df.withColumn("y", F.lit(1.0)), "y", ["relative_routing_margin"]).weights == [0.0]
    with pytest.raises(ValueError, match="Unknown feature"):
        K.feature("price")


def test_fitted_clusters_try_the_whole_range(spark, monkeypatch):
    given, fit = {}, inspect.signature(C.fit_clusters)

    def held(*args, **named):
        bound = fit.bind(*args, **named)
        bound.apply_defaults()
        given.update(bound.arguments)
        return args[0].withColumn("cluster", F.lit(0)), {}, {}

    monkeypatch.setattr(C, "fit_clusters", held)
    queries.c7_fitted_clusters(spark, str(DATA))
    assert C.candidate_counts(1000, most=given["most"], fixed=given["fixed"]) == list(range(2, 11)) and given["starts"] == 10


def test_fitted_clusters_share_their_passes(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal([8 * (n % 4), 8 * (n // 4)], 0.6, (60, 2)) for n in range(7)] + [[[1.0, 1.0]] * 20])
    df = spark.createDataFrame([(f"k{n}", v) for n, v in enumerate(x.tolist())], "example_id string, v array<double>").repartition(3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit", "fit")
    assigned, found, scores = C.fit_clusters(df)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("fit")) < 300  # nine numbers of ten seedings each: above a thousand if each is fitted for itself
    assert sorted(scores) == list(range(2, 11)) and max(scores, key=scores.get) == 7 == len(found)
    got = {r.example_id: (r.v, r.cluster) for r in assigned.collect()}
    centers = np.array([found[i] for i in range(7)])
    near = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
    assert [got[f"k{n}"] for n in range(len(x))] == [(v, c) for v, c in zip(x.tolist(), near.tolist())]
    assert all(np.allclose(x[near == i].mean(0), centers[i], atol=2e-4) for i in range(7))
    held = spark.createDataFrame([(k, v, c) for k, (v, c) in got.items()], "example_id string, v array<double>, cluster int")
    assert abs(scores[7] - C.silhouettes(held).agg(F.avg("silhouette")).first()[0]) < 1e-9
    few = spark.createDataFrame([(str(n), [float(n % 2), 0.0]) for n in range(9)], "example_id string, v array<float>")
    assert C.fit_clusters(few)[0].select("cluster").distinct().count() == 2 and len(C.fit_clusters(few, fixed=1)[1]) == 1


def test_routing_and_clusters(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 0.0]), ("tie", [1.0, 0.0])], "example_id string, v array<float>")
    centroids = spark.createDataFrame([(1, [2.0, 0.0]), (0, [0.0, 0.0])], "cluster_id int, centroid array<float>")
    out = {r.example_id: r for r in G.routed(vectors, centroids).collect()}
    assert (out["a"].expert, out["b"].expert, out["tie"].expert, out["tie"].margin) == (0, 1, 0, 0.0)
    single = G.routed(vectors, centroids.filter("cluster_id = 0")).first()
    assert (single.margin, single.router_entropy, single.router_max_probability) == (0.0, 0.0, 1.0)
    rng = np.random.default_rng(4)
    points = [(f"k{n}", [float(x) for x in rng.normal([10 * (n % 3), 0], 0.5)]) for n in range(90)]
    df = spark.createDataFrame(points, "example_id string, v array<double>")
    assigned, found, scores = C.fit_clusters(df, most=5, starts=2)
    assert len(found) == 3 and max(scores, key=scores.get) == 3
    assert sorted(x.n for x in C.balanced_partition(df, 7).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()) == [12, 13, 13, 13, 13, 13, 13]
    made = spark.createDataFrame([(k, c) for k, c in found.items()], "cluster_id int, centroid array<double>")
    IO.save_clusters(str(tmp_path / "c"), made, assigned.select("example_id", F.col("cluster").alias("cluster_id")), {"method": "kmeans"})
    assert IO.load_clusters(spark, str(tmp_path / "c"))[1].count() == 90
    held = json.loads((tmp_path / "c/manifest.json").read_text())
    held["assignments"]["rows"] = 1
    IO.write_json(str(tmp_path / "c/manifest.json"), held)
    with pytest.raises(ValueError, match="do not agree"):
        IO.load_clusters(spark, str(tmp_path / "c"))


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "1", "_split": "dev"}\n\n{"id": "2", "split": "Test"}\n{"id": "3"}\n')
    assert {(r.id, r.split) for r in IO.read_split_jsonl(spark, str(path), "id string, _split string, split string").collect()} == {("1", "validation"), ("2", "test"), ("3", "all")}
    path.write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception, match="Invalid JSONL"):
        IO.read_jsonl(spark, str(path), "id int").collect()
    inputs = IO.prompt_inputs(spark.createDataFrame([("x", 4)], "prompt string, _pos long")).first()
    assert (inputs.example_id, inputs.split, inputs.references) == ("4", "custom", [])
    examples = spark.createDataFrame([("a", "train"), ("b", "validation"), ("c", "test")], "example_id string, split string")
    IO.write_splits(examples, str(tmp_path / "s"))
    assert IO.prepared(str(tmp_path / "s")) and spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_configuration(tmp_path):
    held = config.load(pairs=["data.split_seed=7", "clustering.strategy=random_balanced", "clustering.num_clusters=4"])
    assert held["data"]["split_seed"] == 7 and config.training_fingerprint(held) != config.training_fingerprint(config.load())
    assert config.training_fingerprint(config.load(pairs=["generation.top_k=5"])) == config.training_fingerprint(config.load())
    for wrong in ("data.price=1", "data.train_ratio=0.9", "clustering.method=x", "evaluation.bins=0", "evaluation.abstain_threshold=2"):
        with pytest.raises(ValueError):
            config.load(pairs=[wrong])
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"fingerprint": "0", "data": {"split_seed": 1}}))
    with pytest.raises(ValueError, match="fingerprint"):
        config.load(str(path))


def test_a_stream_is_routed_as_a_table(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 0.0])], "example_id string, v array<float>")
    centroids = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0])], "cluster_id int, centroid array<float>")
    vectors.write.parquet(str(tmp_path / "in"))
    stream = scoring.routed_stream(spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "in")), centroids)
    query = stream.writeStream.format("memory").queryName("routed_rows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert {(r.example_id, r.expert) for r in spark.table("routed_rows").collect()} == {("a", 0), ("b", 1)}


def test_seed_summary_and_table(spark):
    long = spark.createDataFrame([("x_s1", "brier", 0.1), ("x_s2", "brier", 0.3), ("y", "brier", 0.5)], "run string, metric string, value double")
    out = E.seed_summary(long, X.without_seed(F.col("run")))
    by = {r.run: r for r in out.collect()}
    assert math.isclose(by["x"]["mean"], 0.2) and by["x"].n == 2 and by["y"].std is None
    assert r"x & 0.2000 $\pm$ 0.1960 & -- \\" in IO.latex_table(out, ["brier", "other"])

"""Core queries over the given tables, and for each the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions import text as X
from .operators import calibrator as K
from .operators import clustering as C
from .operators import evaluation as E
from .operators import evaluator as V
from .operators import records as R
from .operators import routing as G
from .operators import semantic as S
from .sources import records as IO
from .streaming.scoring import drift

DIM, CENTROIDS = 24, 14
FEATURES = ["mean_token_log_probability", "relative_routing_margin", "normalized_first_token_entropy", "router_confidence"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _examples(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.first_delivery(_table(spark, d, "prompt_response").select("example_id", "ingested_at", "_pos", *columns), "example_id")


def _generations(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.first_delivery(_table(spark, d, "generated_response").select("generation_id", "ingested_at", "_pos", *columns), "generation_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "prompt_vector").filter(F.col("example_id").isNotNull() & N.finite_vector(F.col("v"), DIM)).dropDuplicates(["example_id"])


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _judged(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Generations with ``outcome``: equal in form to a reference of their example."""
    wanted = dict.fromkeys(["example_id", "response", "calibrated_confidence", *columns])
    refs = _examples(spark, d, "references").filter(F.col("references").isNotNull()).select("example_id", "references")
    rows = _generations(spark, d, *wanted).filter("response is not null").join(refs, "example_id")
    return rows.withColumn("outcome", F.coalesce(S.correct(F.col("response"), F.col("references")), F.lit(0.0)))


def _facts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    facts = _judged(spark, d, *columns).filter("calibrated_confidence is not null").withColumn("confidence", F.col("calibrated_confidence"))
    return E.checked(facts.select("_pos", "confidence", "outcome", *columns))


_EX = "ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY ingested_at, _pos) AS place FROM prompt_response WHERE example_id IS NOT NULL) WHERE place = 1)"
_GEN = "gen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY generation_id ORDER BY ingested_at, _pos) AS place FROM generated_response WHERE generation_id IS NOT NULL) WHERE place = 1)"
_FORM = r"regexp_replace(lower(trim({0})), '\s+', ' ', 'g')"
_JUDGED = f"""judged AS (SELECT gen.*, CASE WHEN len(list_filter(ex."references", lambda r: {_FORM.format('r')} = {_FORM.format('gen.response')})) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome
  FROM gen JOIN ex USING (example_id) WHERE gen.response IS NOT NULL AND ex."references" IS NOT NULL)"""
_FACTS = f"WITH {_EX}, {_GEN}, {_JUDGED}, facts AS (SELECT *, calibrated_confidence AS confidence FROM judged WHERE calibrated_confidence IS NOT NULL)"
_VEC = f"vec AS (SELECT example_id, any_value(v) AS v FROM prompt_vector WHERE example_id IS NOT NULL AND len(v) = {DIM} AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY 1)"
_DIST = f"{_VEC}, dist AS MATERIALIZED (SELECT example_id, cluster_id, list_distance(v::DOUBLE[], centroid::DOUBLE[]) AS d FROM vec CROSS JOIN cluster_centroids)"
_ROUTED = f"""{_DIST}, soft AS (SELECT *, exp(-d / avg(d) OVER (PARTITION BY example_id)) AS e, row_number() OVER (PARTITION BY example_id ORDER BY d, cluster_id) AS r FROM dist),
prob AS (SELECT *, e / sum(e) OVER (PARTITION BY example_id) AS p FROM soft),
routed AS (SELECT example_id, max(CASE WHEN r = 1 THEN cluster_id END) AS expert, max(CASE WHEN r = 1 THEN d END) AS distance, max(CASE WHEN r = 2 THEN d END) AS second_distance, max(CASE WHEN r = 2 THEN d END) - max(CASE WHEN r = 1 THEN d END) AS margin,
 -sum(p * ln(p)) / ln(count(*)) AS router_entropy, max(p) AS router_max_probability FROM prob GROUP BY 1)"""
_SPLIT = "CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'validation' THEN 'validation' WHEN 'valid' THEN 'validation' WHEN 'val' THEN 'validation' WHEN 'dev' THEN 'validation' WHEN 'test' THEN 'test' WHEN 'testing' THEN 'test' WHEN 'all' THEN 'all' WHEN 'unspecified' THEN 'all' WHEN '' THEN 'all' ELSE CASE WHEN split IS NULL THEN 'all' END END"
_STRIP = r"regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
_WHOLE_FORM = r"regexp_replace(regexp_replace(lower({0}), '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')"
_R6 = "round({0}, 6) AS {1}"


def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    """All measures of one confidence in one row; the facts are judged once and kept for all of them."""
    facts = _facts(spark, d).persist()
    out = E.scalar_metrics(facts)
    for part in (E.calibration_error(E.reliability_bins(facts)), E.calibration_error(E.reliability_bins(facts, adaptive=True)).withColumnRenamed("ece", "adaptive_ece"), E.auroc(facts), E.risk_area(E.risk_coverage(facts)), E.spearman(facts, "confidence", "outcome"), E.false_positives_at_recall(facts)):
        out = out.crossJoin(part)
    return _rounded(out, *[c for c in out.columns if c != "examples"])


def a1_scalar_metrics(spark, d):
    return _rounded(E.scalar_metrics(_facts(spark, d)), "accuracy", "mean_confidence", "brier", "log_loss")


def a3_reliability_bins(spark, d):
    return _rounded(E.reliability_bins(_facts(spark, d)), "mean_confidence", "accuracy", "gap")


def a4_adaptive_bins(spark, d):
    return _rounded(E.reliability_bins(_facts(spark, d), adaptive=True), "mean_confidence", "accuracy", "gap")


def a6_auroc(spark, d):
    return _rounded(E.auroc(_facts(spark, d)), "auroc")


def a8_seed_summary(spark, d):
    facts = _facts(spark, d, "expert_id", "source").withColumn("run", F.concat(F.coalesce("source", F.lit("none")), F.lit("_s"), "expert_id"))
    per = facts.groupBy("run").agg(F.avg((F.col("confidence") - F.col("outcome")) ** 2).alias("brier"), F.avg("outcome").alias("accuracy"))
    long = per.unpivot("run", ["brier", "accuracy"], "metric", "value")
    return _rounded(E.seed_summary(long, X.without_seed(F.col("run"))), "mean", "std", "ci95")


def a10_cluster_counts(spark, d):
    routed = G.routed(_vectors(spark, d), _table(spark, d, "cluster_centroids")).select("example_id", "expert")
    split = X.split_name(F.col("split"), strict=False)
    return G.cluster_counts(_examples(spark, d, "split").withColumn("split", split).join(routed, "example_id"), CENTROIDS)


def a11_distance_statistics(spark, d):
    return _rounded(G.distance_statistics(G.routed(_vectors(spark, d), _table(spark, d, "cluster_centroids")), CENTROIDS), "mean", "std", digits=5)


def a12_cluster_means(spark, d):
    routed = G.routed(_vectors(spark, d), _table(spark, d, "cluster_centroids"))
    return G.means_of(routed, DIM).select("cluster_id", F.posexplode("centroid").alias("place", "mean")).withColumn("mean", F.round("mean", 5))


def a16_semantic_entropy(spark, d):
    samples = _generations(spark, d, "example_id", "response", "sequence_log_probability").select("example_id", F.coalesce("response", F.lit("")).alias("text"), F.col("sequence_log_probability").alias("log_probability"), "_pos")
    return _rounded(S.semantic_rows(samples), "entropy", "weighted_entropy", "rao_entropy", "confidence")


def a18_entropy_by_position(spark, d):
    rows = _generations(spark, d, "example_id", "first_token_entropy").filter("example_id is not null")
    lists = rows.groupBy("example_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "first_token_entropy"))), lambda s: s["first_token_entropy"]).alias("entropies"))
    return _rounded(S.mean_entropy_by_position(lists), "mean")


def a21_min_max(spark, d):
    return _rounded(E.min_max(_generations(spark, d, "routing_distance").select("generation_id", "routing_distance"), "routing_distance", "scaled"), "routing_distance", "scaled")


def a22_token_totals(spark, d):
    rows = _generations(spark, d, "source", "generated_token_count", "sequence_log_probability")
    return _rounded(rows.groupBy("source").agg(F.count(F.lit(1)).alias("generations"), F.sum("generated_token_count").alias("tokens"), E.weighted_mean("sequence_log_probability", "generated_token_count").alias("weighted")), "weighted")


def a23_split_manifest(spark, d):
    return _examples(spark, d, "split").groupBy(X.split_name(F.col("split"), strict=False).alias("split")).agg(F.count(F.lit(1)).alias("examples"), F.min("example_id").alias("first_id"), F.max("example_id").alias("last_id"))


def c3_routing(spark, d):
    routed = G.routed(_vectors(spark, d), _table(spark, d, "cluster_centroids")).drop("v")
    return _rounded(routed, "distance", "second_distance", "margin", "router_entropy", "router_max_probability", digits=5)


def c9_silhouette(spark, d):
    routed = G.routed(_vectors(spark, d), _table(spark, d, "cluster_centroids")).select("example_id", "v", F.col("expert").alias("cluster"))
    return _rounded(C.silhouettes(C.silhouette_sample(routed)), "silhouette", digits=5)


def c7_fitted_clusters(spark, d):
    assigned, _, _ = C.fit_clusters(_vectors(spark, d))
    return assigned.select("example_id", "cluster")


def c10_balanced_partition(spark, d):
    return C.balanced_partition(_vectors(spark, d), 7).groupBy("cluster").agg(F.count(F.lit(1)).alias("examples"))


def c12_wrong_route(spark, d):
    return _generations(spark, d, "natural_expert_id").select("generation_id", G.wrong_route(F.col("natural_expert_id"), CENTROIDS).alias("forced_expert"))


def c13_distance_z(spark, d):
    routed = G.routed(_vectors(spark, d), _table(spark, d, "cluster_centroids")).select("example_id", "expert", "distance")
    return _rounded(G.distance_z(routed, G.distance_statistics(routed, CENTROIDS)), "distance", "distance_z", digits=4)


def d1_split(spark, d):
    rows = _examples(spark, d, "group_id").select("example_id", X.first_identifier(F.col("group_id"), F.col("example_id")).alias("group_id"), F.lit(None).cast("string").alias("split"))
    return R.deterministic_split(rows, {"train": 0.8, "validation": 0.1, "test": 0.1})


def f3_selective(spark, d):
    return _rounded(E.selective(_facts(spark, d), [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]), "coverage", "accuracy")


def f5_duplicate_ids(spark, d):
    return R.duplicate_ids(_table(spark, d, "prompt_response"))


def j1_assignments(spark, d):
    out = G.with_assignments(_vectors(spark, d), _table(spark, d, "train_assignments"), _table(spark, d, "cluster_centroids"))
    return _rounded(out, "distance", digits=5)


def j3_id_differences(spark, d):
    return G.id_differences(_examples(spark, d), _table(spark, d, "train_assignments").filter("example_id is not null"))


def j4_inconsistent(spark, d):
    return G.inconsistent_assignments(_examples(spark, d, "cluster_id"), _table(spark, d, "train_assignments"))


def k1_categorical_entropy(spark, d):
    h = N.categorical_entropy(F.transform("v", lambda x: x.cast("double")))
    return _rounded(_vectors(spark, d).select("example_id", h.alias("entropy"), N.entropy_confidence(h, F.lit(DIM), "bound").alias("confidence")), "entropy", "confidence", digits=5)


def k12_rouge_1(spark, d):
    refs = _examples(spark, d, "references").filter(F.size("references") > 0).select("example_id", "references")
    rows = _generations(spark, d, "example_id", "response").join(refs, "example_id")
    score = N.best_reference(N.rouge_1, X.tokens(F.col("response"), True), F.transform("references", lambda r: X.tokens(r, True)))
    return _rounded(rows.select("generation_id", score.alias("rouge_1")), "rouge_1")


def k13_rouge_l(spark, d):
    refs = _examples(spark, d, "references").filter(F.size("references") > 0).select("example_id", "references")
    rows = _generations(spark, d, "example_id", "response").join(refs, "example_id")
    score = N.best_rouge_l(X.tokens(F.col("response")), F.transform("references", lambda r: X.tokens(r)))
    return _rounded(rows.select("generation_id", score.alias("rouge_l")), "rouge_l")


def k17_features(spark, d):
    rows = _generations(spark, d, "routing_distance", "second_routing_distance", "sequence_log_probability", "generated_token_count", "router_entropy", "routing_distance_z")
    return _rounded(rows.select("generation_id", *[K.feature(f).alias(f) for f in K.DERIVED]), *K.DERIVED, digits=12)


def k18_calibrated(spark, d):
    """The calibrator fitted on the even positions and applied to all rows whose features are complete."""
    rows = _judged(spark, d, *[c for c in ("routing_distance", "second_routing_distance", "sequence_log_probability", "generated_token_count", "router_entropy", "routing_distance_z", "normalized_first_token_entropy")]).filter("sequence_log_probability is not null")
    model = K.fit_calibrator(rows.filter("_pos % 2 = 0"), "outcome", FEATURES)
    return _rounded(rows.select("generation_id", model.confidence().alias("confidence"), "outcome"), "confidence", digits=4)


def k20_confidences(spark, d):
    rows = _generations(spark, d, "calibrated_confidence", "non_special_first_token_confidence", "first_token_confidence", "sequence_log_probability", "generated_token_count")
    return _rounded(rows.select("generation_id", *[E.confidence_of(s).alias(s) for s in ("single_pass", "first_token_entropy", "sequence_probability")]), "single_pass", "first_token_entropy", "sequence_probability")


def k23_evaluation(spark, d):
    """All generations of an example are its samples, the first is the prediction."""
    refs = _examples(spark, d, "references").filter(F.size("references") > 0).select("example_id", "references")
    rows = _generations(spark, d, "example_id", "response").filter("response is not null and example_id is not null")
    sampled = rows.groupBy("example_id").agg(F.min("_pos").alias("_pos"), F.transform(F.array_sort(F.collect_list(F.struct("_pos", "response"))), lambda s: s["response"]).alias("samples"))
    out = V.evaluation_metrics(V.evaluated(sampled.join(refs, "example_id"), "frequency", "maximum_class_probability"))
    names = ["brier", "semantic_correctness_rate", "mean_confidence", "mean_semantic_entropy", "auroc"]
    return _rounded(out.select("num_examples", *names), *names)


def k24_out_of_distribution(spark, d):
    rows = _generations(spark, d, "source", "non_special_first_token_confidence", "routing_distance", "routing_margin").select("source", "_pos", F.col("non_special_first_token_confidence").alias("confidence"), F.col("routing_distance").alias("distance"), F.col("routing_margin").alias("margin"))
    out = E.out_of_distribution(rows.filter("source like 'coqa%'"), rows.filter("source like 'xsum%'"))
    return _rounded(out, *out.columns)


def w2_spearman(spark, d):
    rows = _generations(spark, d, "routing_distance", "first_token_entropy").filter("routing_distance is not null and first_token_entropy is not null")
    return _rounded(E.spearman(rows, "routing_distance", "first_token_entropy"), "spearman")


def w3_risk_coverage(spark, d):
    return _rounded(E.risk_coverage(_facts(spark, d)), "coverage", "risk", "confidence")


def w4_thinned_curve(spark, d):
    return _rounded(E.thinned(E.risk_coverage(_facts(spark, d))), "coverage", "risk", "confidence")


def w5_false_positives(spark, d):
    return _rounded(E.false_positives_at_recall(_facts(spark, d)), "fpr")


def w6_history(spark, d):
    rows = _examples(spark, d, "group_id", "metadata", "response").withColumn("turn", F.try_element_at("metadata", F.lit("turn")).cast("int")).filter("turn is not null and group_id is not null")
    return R.with_history_text(rows, "group_id", "turn").select("example_id", "group_id", "turn_number", "history")


def x1_canonical(spark, d):
    rows = R.canonical_examples(_examples(spark, d, "prompt", "response", "references", "split", "group_id", "cluster_id", "metadata").filter("response is not null and prompt is not null"))
    return rows.select("example_id", F.length("prompt").alias("prompt_length"), "group_id", F.size("references").alias("references"), F.array_join("references", "|").alias("joined"))


def x6_summaries(spark, d):
    rows = R.first_delivery(_table(spark, d, "toy_xsum"), "id", ("ingested_at",)).withColumn("split", F.lit("all"))
    return R.expand_xsum(rows).select("example_id", "prompt", "response", "group_id")


def x7_fallback_ids(spark, d):
    rows = _examples(spark, d, "prompt").filter("prompt is not null")
    return rows.select("example_id", X.fallback_id(F.lit("coqa"), F.lit("train"), F.col("_pos"), F.col("prompt")).alias("fallback_id"))


def x8_limited(spark, d):
    """The feature is the limit (500 examples in split order)."""
    rows = _examples(spark, d, "split").withColumn("split", X.split_name(F.col("split"), strict=False)).filter("split is not null")
    return R.limited(rows, 500).select("example_id", "split")


def v2_fingerprints(spark, d):
    parts = [IO.content_fingerprint(_table(spark, d, n), cols).select(F.lit(n).alias("table"), "rows", "fingerprint") for n, cols in (("train_assignments", ["example_id", "cluster_id"]), ("cluster_centroids", ["cluster_id", "centroid"]))]
    return parts[0].unionByName(parts[1])


def t5_sequence_nll(spark, d):
    p = N.softmax(F.transform("v", lambda x: x.cast("double")))
    lp, labels = F.transform(p, lambda x: F.ln(x)), F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.when(i % 3 == 0, F.lit(-100)).otherwise(i))
    return _rounded(_vectors(spark, d).select("example_id", N.sequence_nll(lp, labels).alias("nll"), N.kl_to_uniform(p).alias("kl"), N.kl_to_uniform(p, True).alias("reverse_kl")), "nll", "kl", "reverse_kl", digits=4)


def stream_drift(spark, d):
    rows = _generations(spark, d, "created_at", "calibrated_confidence", "routing_distance", "abstained")
    means = ("mean_confidence", "mean_distance", "abstained")
    out = drift(rows, window="7 days").withColumn("start", F.col("start").cast("date"))
    return _rounded(out.withColumns({c: F.col(c) + 1e-9 for c in means}), *means)  # means of short decimals lie on halves: both sides are moved off them alike


def queries() -> dict:
    """By name: the survey's tag of the operator, then what it gives."""
    all_of = (calibration_report, a1_scalar_metrics, a3_reliability_bins, a4_adaptive_bins, a6_auroc, a8_seed_summary, a10_cluster_counts, a11_distance_statistics, a12_cluster_means, a16_semantic_entropy, a18_entropy_by_position, a21_min_max, a22_token_totals, a23_split_manifest, c3_routing, c7_fitted_clusters, c9_silhouette, c10_balanced_partition, c12_wrong_route, c13_distance_z, d1_split, f3_selective, f5_duplicate_ids, j1_assignments, j3_id_differences, j4_inconsistent, k1_categorical_entropy, k12_rouge_1, k13_rouge_l, k17_features, k18_calibrated, k20_confidences, k23_evaluation, k24_out_of_distribution, w2_spearman, w3_risk_coverage, w4_thinned_curve, w5_false_positives, w6_history, x1_canonical, x6_summaries, x7_fallback_ids, x8_limited, v2_fingerprints, t5_sequence_nll, stream_drift)
    return {f.__name__: f for f in all_of}


_BINS = """agg AS (SELECT bin::INTEGER AS bin, count(*) AS count, avg(confidence) AS c, avg(outcome) AS a FROM binned GROUP BY 1)
SELECT bin, count, round(c, 6) AS mean_confidence, round(a, 6) AS accuracy, round(abs(c - a), 6) AS gap FROM agg"""
_FIXED = f"{_FACTS}, binned AS (SELECT *, least(least(15, (SELECT count(*) FROM facts)) - 1, floor(confidence * least(15, (SELECT count(*) FROM facts)))) AS bin FROM facts)"
_ADAPTIVE = f"{_FACTS}, n AS (SELECT count(*) AS n FROM facts), binned AS (SELECT facts.*, floor((row_number() OVER (ORDER BY confidence, _pos) - 1) * least(15, n) / n) AS bin FROM facts, n)"
_AUROC = "(sum(CASE WHEN {y} = 1 THEN r END) - sum({y}) * (sum({y}) + 1) / 2) / (sum({y}) * (count(*) - sum({y})))"
_CURVE = f"{_FACTS}, curve AS (SELECT row_number() OVER w AS place, row_number() OVER w / count(*) OVER () AS coverage, 1 - sum(outcome) OVER w / row_number() OVER w AS risk, confidence FROM facts WINDOW w AS (ORDER BY confidence DESC, _pos))"
_LOSS = "avg(-(outcome * ln(least(greatest(confidence, 1e-12), 1 - 1e-12)) + (1 - outcome) * ln(least(greatest(1 - confidence, 1e-12), 1 - 1e-12))))"
_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2)"


def _ood(score: str, name: str) -> str:
    return f"(SELECT round({_AUROC.format(y='y')}, 6) FROM (SELECT y, {_RANK.format(score)} AS r FROM both_of)) AS {name}"


def oracle_sql() -> dict[str, str]:
    fpr = "SELECT (place - hits) / (n - p) FROM (SELECT row_number() OVER w AS place, sum({y}) OVER w AS hits, sum({y}) OVER () AS p, count(*) OVER () AS n FROM {t} WINDOW w AS (ORDER BY {s} DESC, _pos)) WHERE hits >= p * 0.95 - 1e-12 ORDER BY place LIMIT 1"
    scalars = f"count(*) AS examples, {_R6.format('avg(outcome)', 'accuracy')}, {_R6.format('avg(confidence)', 'mean_confidence')}, {_R6.format('avg((confidence - outcome) * (confidence - outcome))', 'brier')}, {_R6.format(_LOSS, 'log_loss')}"
    tokens = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
    return {
        "calibration_report": f"""{_FACTS}, n AS (SELECT count(*) AS n FROM facts),
fixed AS (SELECT count(*) AS k, abs(avg(confidence) - avg(outcome)) AS gap FROM facts, n GROUP BY least(14, floor(confidence * 15))),
even AS (SELECT count(*) AS k, abs(avg(confidence) - avg(outcome)) AS gap FROM (SELECT *, floor((row_number() OVER (ORDER BY confidence, _pos) - 1) * 15 / n) AS bin FROM facts, n) GROUP BY bin),
ranked AS (SELECT outcome, {_RANK.format('confidence')} AS r, {_RANK.format('outcome')} AS ry FROM facts),
curve AS (SELECT 1 - sum(outcome) OVER w / row_number() OVER w AS risk FROM facts WINDOW w AS (ORDER BY confidence DESC, _pos))
SELECT {scalars}, (SELECT round(sum(k * gap) / sum(k), 6) FROM fixed) AS ece, (SELECT round(sum(k * gap) / sum(k), 6) FROM even) AS adaptive_ece, (SELECT round({_AUROC.format(y='outcome')}, 6) FROM ranked) AS auroc,
(SELECT round(avg(risk), 6) FROM curve) AS aurc, (SELECT round(corr(r, ry), 6) FROM ranked) AS spearman, round(({fpr.format(y='outcome', t='facts', s='confidence')}), 6) AS fpr FROM facts""",
        "a1_scalar_metrics": f"{_FACTS} SELECT {scalars} FROM facts",
        "a3_reliability_bins": f"{_FIXED}, {_BINS}",
        "a4_adaptive_bins": f"{_ADAPTIVE}, {_BINS}",
        "a6_auroc": f"{_FACTS} SELECT round({_AUROC.format(y='outcome')}, 6) AS auroc FROM (SELECT outcome, {_RANK.format('confidence')} AS r FROM facts)",
        "a8_seed_summary": f"""{_FACTS}, per AS (SELECT coalesce(source, 'none') AS run, expert_id, avg((confidence - outcome) ** 2) AS brier, avg(outcome) AS accuracy FROM facts GROUP BY 1, 2),
long AS (SELECT run, 'brier' AS metric, brier AS value FROM per UNION ALL SELECT run, 'accuracy', accuracy FROM per)
SELECT run, metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci95 FROM long GROUP BY 1, 2""",
        "a10_cluster_counts": f"""WITH {_EX}, {_ROUTED}, both_of AS (SELECT {_SPLIT} AS split, expert FROM ex JOIN routed USING (example_id)), splits AS (SELECT DISTINCT split FROM both_of)
SELECT s.split, k.cluster::INTEGER AS cluster, count(b.expert) AS examples FROM splits s CROSS JOIN range({CENTROIDS}) k(cluster) LEFT JOIN both_of b ON b.split IS NOT DISTINCT FROM s.split AND b.expert = k.cluster GROUP BY 1, 2""",
        "a11_distance_statistics": f"""WITH {_ROUTED}, stats AS (SELECT expert, avg(distance) AS m, stddev_pop(distance) AS s FROM routed GROUP BY 1)
SELECT k.e::INTEGER AS expert, round(coalesce(m, 0), 5) AS mean, round(CASE WHEN coalesce(s, 0) < 1e-8 THEN 1 ELSE s END, 5) AS std FROM range({CENTROIDS}) k(e) LEFT JOIN stats ON expert = k.e""",
        "a12_cluster_means": f"""WITH {_ROUTED}, places AS (SELECT expert, unnest(range({DIM})) AS place, unnest(v) AS x FROM routed JOIN vec USING (example_id))
SELECT expert AS cluster_id, place::INTEGER AS place, round(avg(x::DOUBLE), 5) AS mean FROM places GROUP BY 1, 2""",
        "a16_semantic_entropy": rf"""WITH {_GEN}, s AS (SELECT example_id, regexp_replace(regexp_replace(lower(coalesce(response, '')), '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g') AS form, sequence_log_probability AS lp FROM gen WHERE example_id IS NOT NULL),
t AS (SELECT example_id, count(*) AS n, bool_and(lp IS NOT NULL) AS all_lp, max(lp) AS top FROM s GROUP BY 1),
w AS (SELECT s.example_id, form, count(*) / any_value(n) AS p, CASE WHEN any_value(all_lp) THEN sum(exp(lp - top)) END AS e, CASE WHEN any_value(all_lp) THEN ln(sum(exp(lp - top))) + any_value(top) END AS l FROM s JOIN t USING (example_id) GROUP BY 1, 2),
x AS (SELECT *, e / sum(e) OVER (PARTITION BY example_id) AS q FROM w)
SELECT example_id, any_value(n)::INTEGER AS samples, count(*)::INTEGER AS classes, round(-sum(p * ln(p)) + 0.0, 6) AS entropy, round(-sum(CASE WHEN q > 0 THEN q * ln(q) WHEN q = 0 THEN 0 END) + 0.0, 6) AS weighted_entropy, round(-avg(l), 6) AS rao_entropy, round(max(p), 6) AS confidence FROM x JOIN t USING (example_id) GROUP BY 1""",
        "k23_evaluation": f"""WITH {_EX}, {_GEN}, s AS (SELECT example_id, gen._pos, {_WHOLE_FORM.format('gen.response')} AS form, ex."references" AS refs FROM gen JOIN ex USING (example_id) WHERE gen.response IS NOT NULL AND len(ex."references") > 0),
f AS (SELECT example_id, count(*) AS n, min_by(form, _pos) AS said, any_value(refs) AS refs FROM s GROUP BY 1), c AS (SELECT example_id, form, count(*) AS k FROM s GROUP BY 1, 2),
e AS (SELECT example_id, -sum(k / n * ln(k / n)) AS h, max(k / n) AS confidence FROM c JOIN f USING (example_id) GROUP BY 1),
facts AS (SELECT h, confidence, CASE WHEN len(list_filter(refs, lambda r: {_WHOLE_FORM.format('r')} = said)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome FROM e JOIN f USING (example_id)),
ranked AS (SELECT *, {_RANK.format('confidence')} AS r FROM facts)
SELECT count(*) AS num_examples, round(avg((confidence - outcome) * (confidence - outcome)), 6) AS brier, round(avg(outcome), 6) AS semantic_correctness_rate, round(avg(confidence), 6) AS mean_confidence, round(avg(h), 6) AS mean_semantic_entropy, round({_AUROC.format(y='outcome')}, 6) AS auroc FROM ranked""",
        "a18_entropy_by_position": f"""WITH {_GEN}, s AS (SELECT row_number() OVER (PARTITION BY example_id ORDER BY _pos) - 1 AS position, first_token_entropy AS h FROM gen WHERE example_id IS NOT NULL)
SELECT position::INTEGER AS position, round(avg(CASE WHEN isfinite(h) THEN h END), 6) AS mean, count(CASE WHEN isfinite(h) THEN 1 END) AS count FROM s GROUP BY 1""",
        "a21_min_max": f"WITH {_GEN} SELECT generation_id, round(routing_distance, 6) AS routing_distance, round((routing_distance - min(routing_distance) OVER ()) / (max(routing_distance) OVER () - min(routing_distance) OVER ()), 6) AS scaled FROM gen",
        "a22_token_totals": f"WITH {_GEN} SELECT source, count(*) AS generations, sum(generated_token_count)::BIGINT AS tokens, round(sum(sequence_log_probability * generated_token_count) / sum(generated_token_count), 6) AS weighted FROM gen GROUP BY 1",
        "a23_split_manifest": f"WITH {_EX} SELECT {_SPLIT} AS split, count(*) AS examples, min(example_id) AS first_id, max(example_id) AS last_id FROM ex GROUP BY 1",
        "c3_routing": f"WITH {_ROUTED} SELECT example_id, expert, round(distance, 5) AS distance, round(second_distance, 5) AS second_distance, round(margin, 5) AS margin, round(router_entropy, 5) AS router_entropy, round(router_max_probability, 5) AS router_max_probability FROM routed",
        "c12_wrong_route": f"WITH {_GEN} SELECT generation_id, ((natural_expert_id + 1) % {CENTROIDS})::INTEGER AS forced_expert FROM gen",
        "c10_balanced_partition": f"WITH {_VEC}, n AS (SELECT count(*) AS n FROM vec) SELECT k.c::INTEGER AS cluster, (n // 7 + CASE WHEN k.c < n % 7 THEN 1 ELSE 0 END)::BIGINT AS examples FROM range(7) k(c), n",
        "c13_distance_z": f"""WITH {_ROUTED}, stats AS (SELECT expert, avg(distance) AS m, CASE WHEN coalesce(stddev_pop(distance), 0) < 1e-8 THEN 1 ELSE stddev_pop(distance) END AS s FROM routed GROUP BY 1)
SELECT expert, example_id, round(distance, 4) AS distance, round((distance - m) / s, 4) AS distance_z FROM routed JOIN stats USING (expert)""",
        "c9_silhouette": f"""WITH {_ROUTED}, p AS (SELECT example_id, v::DOUBLE[] AS v, expert FROM routed JOIN vec USING (example_id)),
d AS (SELECT a.example_id, a.expert AS own, b.expert AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM p a CROSS JOIN p b GROUP BY 1, 2, 3),
m AS (SELECT example_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1)
SELECT example_id, round(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS silhouette FROM m""",
        "d1_split": f"""WITH {_EX}, e AS (SELECT example_id, coalesce(nullif(regexp_replace(group_id, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'), ''), example_id) AS group_id FROM ex),
u AS (SELECT group_id, row_number() OVER (ORDER BY sha256('2026:' || group_id), group_id) AS place FROM (SELECT DISTINCT group_id FROM e)), n AS (SELECT count(*) AS n FROM u),
f AS (SELECT n, floor(n * 0.8)::BIGINT AS t, floor(n * 0.1)::BIGINT AS v, floor(n * 0.1)::BIGINT AS s, n * 0.8 - floor(n * 0.8) AS rt, n * 0.1 - floor(n * 0.1) AS rv FROM n),
g AS (SELECT *, n - t - v - s AS more FROM f),
c AS (SELECT t + CASE WHEN more >= 1 AND (rt >= rv OR more >= 3) THEN 1 ELSE 0 END AS t, v + CASE WHEN (more >= 1 AND rv > rt) OR more >= 2 THEN 1 ELSE 0 END AS v FROM g)
SELECT example_id, group_id, CASE WHEN place <= t THEN 'train' WHEN place <= t + v THEN 'validation' ELSE 'test' END AS split FROM e JOIN u USING (group_id), c""",
        "f3_selective": f"{_FACTS} SELECT threshold::DOUBLE AS threshold, round(avg((confidence >= threshold)::INTEGER), 6) AS coverage, round(avg(CASE WHEN confidence >= threshold THEN outcome END), 6) AS accuracy FROM facts CROSS JOIN (VALUES (0.0), (0.25), (0.5), (0.75), (0.9), (1.0)) t(threshold) GROUP BY 1",
        "f5_duplicate_ids": "SELECT example_id, count(*) AS rows FROM prompt_response GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5",
        "j1_assignments": f"""WITH {_ROUTED}, fit AS (SELECT example_id, cluster_id AS fitted_cluster FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY fitted_at DESC, cluster_id DESC) AS place FROM train_assignments WHERE example_id IS NOT NULL) WHERE place = 1)
SELECT r.example_id, CASE WHEN d.d IS NOT NULL THEN fitted_cluster ELSE expert END AS cluster, d.d IS NOT NULL AS fitted, round(coalesce(d.d, distance), 5) AS distance FROM routed r LEFT JOIN fit USING (example_id) LEFT JOIN dist d ON d.example_id = r.example_id AND d.cluster_id = fitted_cluster""",
        "j3_id_differences": "SELECT (SELECT count(*) FROM (SELECT DISTINCT example_id FROM prompt_response WHERE example_id IS NOT NULL EXCEPT SELECT example_id FROM train_assignments)) AS only_left, (SELECT count(*) FROM (SELECT DISTINCT example_id FROM train_assignments WHERE example_id IS NOT NULL EXCEPT SELECT example_id FROM prompt_response)) AS only_right",
        "j4_inconsistent": f"""WITH {_EX}, fit AS (SELECT example_id, cluster_id AS fitted_cluster FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY fitted_at DESC, cluster_id DESC) AS place FROM train_assignments WHERE example_id IS NOT NULL) WHERE place = 1)
SELECT example_id, cluster_id, fitted_cluster FROM ex JOIN fit USING (example_id) WHERE cluster_id IS DISTINCT FROM fitted_cluster""",
        "k1_categorical_entropy": f"""WITH {_VEC}, x AS (SELECT example_id, unnest(v)::DOUBLE AS x FROM vec), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY example_id)) AS e FROM x), p AS (SELECT *, e / sum(e) OVER (PARTITION BY example_id) AS p FROM e), h AS (SELECT example_id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM p GROUP BY 1)
SELECT example_id, round(h, 5) AS entropy, round(least(greatest(1 - h / ln({DIM}), 0), 1), 5) AS confidence FROM h""",
        "k12_rouge_1": f"""WITH {_EX}, {_GEN}, pairs AS (SELECT generation_id, unnest(range(len(ex."references"))) AS i, {tokens.format('gen.response')} AS a, {tokens.format('unnest(ex."references")')} AS b FROM gen JOIN ex USING (example_id) WHERE len(ex."references") > 0),
ta AS (SELECT generation_id, i, t, count(*) AS n FROM (SELECT generation_id, i, unnest(a) AS t FROM pairs) GROUP BY 1, 2, 3), tb AS (SELECT generation_id, i, t, count(*) AS n FROM (SELECT generation_id, i, unnest(b) AS t FROM pairs) GROUP BY 1, 2, 3),
o AS (SELECT generation_id, i, sum(least(ta.n, tb.n)) AS o FROM ta JOIN tb USING (generation_id, i, t) GROUP BY 1, 2)
SELECT generation_id, round(max(CASE WHEN coalesce(o, 0) = 0 THEN 0 ELSE 2.0 * o / (len(a) + len(b)) END), 6) AS rouge_1 FROM pairs LEFT JOIN o USING (generation_id, i) GROUP BY 1""",
        "k17_features": f"""WITH {_GEN} SELECT generation_id, round(-ln(1 + greatest(routing_distance, 0)), 12) AS negative_log_routing_distance, round(sequence_log_probability / greatest(generated_token_count, 1), 12) AS mean_token_log_probability,
round(CASE WHEN second_routing_distance <= 1e-12 THEN 0 ELSE (second_routing_distance - routing_distance) / second_routing_distance END, 12) AS relative_routing_margin, round(1 - router_entropy, 12) AS router_confidence, round(-routing_distance_z, 12) AS negative_routing_distance_z FROM gen""",
        "k20_confidences": f"""WITH {_GEN}, c AS (SELECT generation_id, calibrated_confidence AS a, coalesce(non_special_first_token_confidence, first_token_confidence) AS b, exp(sequence_log_probability / greatest(generated_token_count, 1)) AS s FROM gen)
SELECT generation_id, CASE WHEN a IS NOT NULL THEN round(least(greatest(a, 0), 1), 6) END AS single_pass, CASE WHEN b IS NOT NULL THEN round(least(greatest(b, 0), 1), 6) END AS first_token_entropy, CASE WHEN s IS NOT NULL THEN round(least(greatest(s, 0), 1), 6) END AS sequence_probability FROM c""",
        "k24_out_of_distribution": f"""WITH {_GEN}, both_of AS (SELECT 1 - non_special_first_token_confidence AS doubt, routing_distance AS distance, -routing_margin AS closeness, CASE WHEN source LIKE 'xsum%' THEN 1.0 ELSE 0.0 END AS y, _pos + CASE WHEN source LIKE 'xsum%' THEN 1099511627776 ELSE 0 END AS _pos FROM gen WHERE source LIKE 'coqa%' OR source LIKE 'xsum%')
SELECT {_ood('doubt', 'confidence_auroc')}, round(({fpr.format(y='y', t='both_of', s='doubt')}), 6) AS confidence_fpr95, {_ood('distance', 'distance_auroc')}, {_ood('closeness', 'margin_auroc')}""",
        "w2_spearman": f"WITH {_GEN} SELECT round(corr(a, b), 6) AS spearman FROM (SELECT {_RANK.format('routing_distance')} AS a, {_RANK.format('first_token_entropy')} AS b FROM gen WHERE routing_distance IS NOT NULL AND first_token_entropy IS NOT NULL)",
        "w3_risk_coverage": f"{_CURVE} SELECT place, round(coverage, 6) AS coverage, round(risk, 6) AS risk, round(confidence, 6) AS confidence FROM curve",
        "w4_thinned_curve": f"{_CURVE} SELECT place, round(coverage, 6) AS coverage, round(risk, 6) AS risk, round(confidence, 6) AS confidence FROM curve WHERE (place - 1) % greatest(1, (SELECT count(*) FROM curve) // 100) = 0 OR place = (SELECT count(*) FROM curve)",
        "w5_false_positives": f"{_FACTS} SELECT round(({fpr.format(y='outcome', t='facts', s='confidence')}), 6) AS fpr",
        "w6_history": f"""WITH {_EX}, t AS (SELECT example_id, group_id, coalesce(response, '') AS response, try_cast(metadata['turn'] AS INTEGER) AS turn FROM ex WHERE group_id IS NOT NULL)
SELECT example_id, group_id, (row_number() OVER w - 1)::INTEGER AS turn_number, coalesce(string_agg(response, '|') OVER (PARTITION BY group_id ORDER BY turn, example_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM t WHERE turn IS NOT NULL WINDOW w AS (PARTITION BY group_id ORDER BY turn, example_id)""",
        "x8_limited": f"WITH {_EX}, s AS (SELECT example_id, _pos, {_SPLIT} AS split FROM ex) SELECT example_id, split FROM s WHERE split IS NOT NULL ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'test' THEN 5 ELSE 6 END, split, _pos LIMIT 500",
        "x7_fallback_ids": f"WITH {_EX} SELECT example_id, 'coqa-' || left(sha1('coqa' || chr(0) || 'train' || chr(0) || _pos || chr(0) || prompt), 16) AS fallback_id FROM ex WHERE prompt IS NOT NULL",
        "x6_summaries": rf"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS place FROM toy_xsum WHERE id IS NOT NULL), s AS (SELECT id, regexp_replace(document, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g') AS d, regexp_replace(summary, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g') AS s FROM f WHERE place = 1)
SELECT id AS example_id, 'Document: ' || d || chr(10) || 'Summary:' AS prompt, s AS response, id AS group_id FROM s WHERE d <> '' AND s <> ''""",
        "x1_canonical": rf"""WITH {_EX}, s AS (SELECT example_id, {_STRIP.format('prompt')} AS prompt, coalesce(nullif({_STRIP.format('group_id')}, ''), example_id) AS group_id, list_filter(list_transform([response] || coalesce("references", []), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS l FROM ex WHERE prompt IS NOT NULL AND response IS NOT NULL),
t AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS d FROM s) SELECT example_id, length(prompt)::INTEGER AS prompt_length, group_id, len(d)::INTEGER AS "references", coalesce(list_aggregate(d, 'string_agg', '|'), '') AS joined FROM t""",
        "stream_drift": f"""WITH {_GEN} SELECT time_bucket(INTERVAL '7 days', created_at, TIMESTAMP '1970-01-01')::DATE AS start, count(*) AS generations, round(avg(calibrated_confidence) + 1e-9, 6) AS mean_confidence, round(avg(routing_distance) + 1e-9, 6) AS mean_distance, round(avg(abstained::INTEGER) + 1e-9, 6) AS abstained FROM gen GROUP BY 1""",
        "t5_sequence_nll": f"""WITH {_VEC}, x AS (SELECT example_id, unnest(range({DIM})) AS i, unnest(v)::DOUBLE AS x FROM vec), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY example_id)) AS e FROM x), p AS (SELECT *, e / sum(e) OVER (PARTITION BY example_id) AS p FROM e)
SELECT example_id, round(-sum(CASE WHEN i % 3 <> 0 THEN ln(p) END), 4) AS nll, round(ln({DIM}) + sum(p * ln(p)), 4) AS kl, round(-ln({DIM}) - avg(ln(p)), 4) AS reverse_kl FROM p GROUP BY 1""",
    }

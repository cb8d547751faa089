"""Reading and writing of records and artifacts (survey S1-S13, V1-V4, U1)."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import split_name, stripped


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file or folder (S1, S2). Blank lines are skipped; a line that is no JSON object raises, or is a row of nulls where ``strict`` is false.

    The scan is a text scan, so files are split as Spark likes and only columns of ``schema`` are built.
    """
    lines = spark.read.text(path).filter(stripped(F.col("value")) != "")
    parsed = lines.withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("_ok", F.col("value").rlike(r"^\s*\{") & F.expr("try_parse_json(value) is not null"))
    if strict:
        parsed = parsed.withColumn("_r", F.when(F.col("_ok"), F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("Invalid JSONL: "), F.substring("value", 1, 80))).cast(parsed.schema["_r"].dataType)))
    return parsed.select("_r.*")


def read_split_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``read_jsonl`` with ``split`` from ``_split``, ``split`` or 'all' (S4). ``schema`` should name whichever it has."""
    rows = read_jsonl(spark, path, schema)
    names = [F.nullif(F.col(c), F.lit("")) for c in ("_split", "split") if c in rows.columns]
    return rows.withColumn("split", split_name(F.coalesce(*names, F.lit("all")))).drop("_split")


def prompt_inputs(rows: DataFrame) -> DataFrame:
    """Prompt-only rows made complete (S7): a blank or missing prompt raises; the id defaults to ``_pos``, the split to custom, references to none."""
    has = set(rows.columns)
    prompt = F.when(stripped(F.col("prompt")) != "", F.col("prompt")).otherwise(F.raise_error(F.lit("prompt must be a non-blank string")).cast("string"))
    default = lambda c, value: F.coalesce(F.col(c), value) if c in has else value
    return rows.select(default("example_id", F.col("_pos").cast("string")).alias("example_id"), prompt.alias("prompt"), default("split", F.lit("custom")).alias("split"), default("references", F.array().cast("array<string>")).alias("references"))


def write_splits(examples: DataFrame, path: str) -> None:
    """One folder per split (S10), through Spark's commit protocol; a split without rows gets an empty one."""
    examples.write.mode("overwrite").partitionBy("split").parquet(path)
    jvm, conf = examples.sparkSession._jvm, examples.sparkSession._jsc.hadoopConfiguration()
    for name in ("train", "validation", "test"):
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/split={name}")
        at.getFileSystem(conf).mkdirs(at)


def prepared(path: str) -> bool:
    return all((Path(path) / f"split={s}").exists() for s in ("train", "validation", "test"))


def write_json(path: str, value: Any) -> None:
    """Sorted keys, two blanks, written beside and moved into place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump(value, out, sort_keys=True, indent=2, ensure_ascii=False)
        out.flush()
        os.fsync(out.fileno())
    os.replace(name, target)


def fingerprint(value: Any) -> str:
    """SHA-256 of canonical JSON (V1)."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(``rows``, ``fingerprint``): a fingerprint that doesn't depend on order and is combined map-side (V2, V4): sum and exclusive or of row hashes. Differs from a sequential digest by design."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)), 256).alias("fingerprint"))


def save_clusters(path: str, centroids: DataFrame, assignments: DataFrame, details: dict) -> None:
    """Centroids, assignments and a manifest with their fingerprints."""
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    spark = centroids.sparkSession
    prints = {n: content_fingerprint(spark.read.parquet(f"{path}/{n}"), cols).first().asDict() for n, cols in (("centroids", ["cluster_id", "centroid"]), ("assignments", ["example_id", "cluster_id"]))}
    write_json(f"{path}/manifest.json", {"version": 2, **details, **prints})


def load_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """What ``save_clusters`` wrote, refused if its contents no longer agree with the manifest."""
    manifest = json.loads(Path(f"{path}/manifest.json").read_text())
    tables = []
    for name, cols in (("centroids", ["cluster_id", "centroid"]), ("assignments", ["example_id", "cluster_id"])):
        df = spark.read.parquet(f"{path}/{name}")
        if content_fingerprint(df, cols).first().asDict() != manifest[name]:
            raise ValueError(f"{name} do not agree with the manifest")
        tables.append(df)
    return tables[0], tables[1], manifest


def latex_table(summary: DataFrame, metrics: list[str]) -> str:
    """Runs by metrics, ``mean ± ci95`` to four decimals, ``--`` where missing (S13). For the few runs of a report."""
    cells: dict[str, dict[str, str]] = {}
    for r in summary.orderBy("run", "metric").collect():
        cells.setdefault(r.run, {})[r.metric] = f"{r['mean']:.4f}" + (f" $\\pm$ {r.ci95:.4f}" if r.ci95 is not None else "")
    lines = [" & ".join([run.replace("_", r"\_"), *(own.get(m, "--") for m in metrics)]) + r" \\" for run, own in cells.items()]
    head = " & ".join(["run", *(m.replace("_", r"\_") for m in metrics)]) + r" \\"
    return "\n".join([r"\begin{tabular}{l" + "c" * len(metrics) + "}", head, r"\hline", *lines, r"\end{tabular}"])

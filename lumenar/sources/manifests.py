"""Run folders and their manifests (survey L6, S13-S15, V3, V6, V7, F7, F8, H24). Small files only, read on the driver."""

from __future__ import annotations

import csv
import hashlib
import json
import re
from datetime import datetime
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import fingerprint, write_json

_STAMP = re.compile(r"^(?P<run>.+)__(?P<at>\d{8}T\d{6}Z)$")
#: What two stages must agree in to work together.
ROUTER_KEYS = ("embedding", "tokenization", "model", "revision")


def safe_relative(path: str) -> str:
    """``path`` if it is relative and stays below its root (H24), else an error."""
    plain = PurePosixPath(path.replace("\\", "/"))
    if not path.strip() or plain.is_absolute() or ".." in plain.parts or re.match(r"^[A-Za-z]:", path):
        raise ValueError(f"not a safe relative path: {path}")
    return str(plain)


def latest_run(folders: list[str], run: str | None = None) -> str:
    """The newest of folders named ``<run>__<UTC time>`` (L6, S14); other names are passed over, none left raises."""
    found = [(datetime.strptime(m["at"], "%Y%m%dT%H%M%SZ"), f) for f in folders if (m := _STAMP.match(PurePosixPath(f).name)) and run in (None, m["run"])]
    if not found:
        raise FileNotFoundError("no run folder")
    return max(found)[1]


def latest_runs(folders: DataFrame) -> DataFrame:
    """(``run``, ``folder``): the newest folder of each run in a table of names (``folder``)."""
    named = folders.select("folder", F.regexp_extract("folder", r"([^/]+)__(\d{8}T\d{6}Z)/?$", 1).alias("run"), F.regexp_extract("folder", r"__(\d{8}T\d{6}Z)/?$", 1).alias("at")).filter("run <> ''")
    return named.groupBy("run").agg(F.max_by("folder", F.struct("at", "folder")).alias("folder"))


def missing_files(root: str, single_pass: bool = True) -> list[str]:
    """Files that a finished run needs and ``root`` lacks (S15); uploading is left to the user."""
    needed = ["resolved_config.json", "data/manifest.json", "clusters/manifest.json", "evaluation/test_metrics.json", *(["calibrator.json"] if single_pass else [])]
    return [n for n in needed if not (Path(root) / n).is_file()]


def files_fingerprint(paths: list[str]) -> str:
    """SHA-256 of names and bytes, in the order of names (V3)."""
    digest = hashlib.sha256()
    for p in sorted(paths, key=lambda p: Path(p).name):
        name = Path(p).name.encode()
        digest.update(len(name).to_bytes(8, "big") + name + Path(p).stat().st_size.to_bytes(8, "big"))
        with open(p, "rb") as held:
            for block in iter(lambda: held.read(1 << 20), b""):
                digest.update(block)
    return digest.hexdigest()


def compatible(router: dict, config: dict, keys: tuple[str, ...] = ROUTER_KEYS) -> None:
    """Raises for the parts in which a fitted router and a configuration differ (F8)."""
    if differ := [k for k in keys if router.get(k) != config.get(k)]:
        raise ValueError(f"router and configuration differ in {', '.join(differ)}")


def consistent_experts(manifests: dict[int, dict], experts: int, method: str) -> None:
    """Raises unless each expert has a completed manifest of ``method`` and all agree in fingerprints and package versions (V7)."""
    if set(manifests) != set(range(experts)):
        raise ValueError("an expert's manifest is missing")
    for k, m in manifests.items():
        if m.get("expert_id") != k or m.get("method") != method or not m.get("completed"):
            raise ValueError(f"the manifest of expert {k} doesn't fit")
    for name in ("config_fingerprint", "data_fingerprint", "cluster_fingerprint", "packages"):
        if len({fingerprint(m.get(name)) for m in manifests.values()}) > 1:
            raise ValueError(f"experts differ in {name}")


def has_samples(rows: DataFrame, n: int, column: str = "semantic_samples") -> bool:
    """Every row has exactly ``n`` samples (F7); true for no rows."""
    return rows.filter(F.coalesce(F.size(column), F.lit(-1)) != n).limit(1).count() == 0


def cached(rows_path: str, identity: dict, make, spark, refuse: bool = False) -> tuple[DataFrame, bool]:
    """A table that is made once (V6): read again if the manifest beside it has the same ``identity`` (such as the fingerprints of source and configuration) and row count, else made by ``make()``.

    Returns the table and whether it was there. A broken or different table is made again, or refused if ``refuse`` says that it must not be made.
    """
    manifest = Path(f"{rows_path}.manifest.json")
    try:
        held = json.loads(manifest.read_text())
        table = spark.read.parquet(rows_path)
        if held["identity"] == fingerprint(identity) and held["rows"] == table.count():
            return table, True
    except Exception:  # noqa: BLE001 - whatever can't be read is made again
        pass
    if refuse:
        raise ValueError("the cached table does not fit and must not be made again")
    manifest.unlink(missing_ok=True)
    make().write.mode("overwrite").parquet(rows_path)
    table = spark.read.parquet(rows_path)
    write_json(str(manifest), {"identity": fingerprint(identity), "rows": table.count()})
    return table, False


def write_report(path: str, rows: list[dict[str, Any]]) -> None:
    """Rows of a report as JSON and, with the sorted union of their keys as columns, as CSV (S13): ``path`` without ending."""
    write_json(f"{path}.json", rows)
    with open(f"{path}.csv", "w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, sorted({k for r in rows for k in r}), restval="")
        writer.writeheader()
        writer.writerows(rows)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines through Spark's commit protocol (S9); nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

"""Pieces that several operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPLIT_ALIASES

#: Maximal runs of letters or digits are words.
NOT_WORD = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named in ``spark.checkpoint.dir``; one is made only where a session on one machine (a test's) names none."""
    if (given := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return given
    if (used := spark.sparkContext.getCheckpointDir()) is not None:
        return used
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lumenar-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, so that a lost executor costs no more than the work since.

    A written table is used rather than ``checkpoint()`` because its size is then known: the estimate that a checkpoint keeps from its plan is squared by each round of a loop that joins the
    last round with itself. ``instead_of``: a table of an earlier call that is now of no more use, deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None and (old := _written.pop(id(instead_of), None)):
        _delete(spark, old)
    table = spark.read.schema(df.schema).parquet(path)
    _written[id(table)] = path
    weakref.finalize(table, _written.pop, id(table), None)
    return table


_written: dict[int, str] = {}


def read_split(split: Column) -> Column:
    """train, validation or test by the aliases, ignoring case and outer blanks; null for any other name."""
    names = F.create_map(*[F.lit(x) for pair in SPLIT_ALIASES.items() for x in pair])
    return F.try_element_at(names, F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", "")))


def words(text: Column) -> Column:
    """The words of a text in lower case, in order; null text gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def canonical(text: Column) -> Column:
    """Lower case, with every run of punctuation and white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def overlap(a: Column, b: Column) -> Column:
    """Distinct values in both arrays by those in either; 0 for two empty ones. Both arrays must be free of repeats."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``rows`` rows; else it is joined by a shuffle. It is counted, so it should be a written table of few short columns."""
    return F.broadcast(df) if df.count() <= rows else df


def ordered_pair(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.select(F.least(a, b).alias(f"{name}_1"), F.greatest(a, b).alias(f"{name}_2"))

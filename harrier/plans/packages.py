"""Package jobs: from packages to findings, verdicts and their qualification; and packages made of the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, qualify
from .samples import PACKAGES, Sample

NOW = 1_700_000_000
#: Tasks that packages are dealt out to, for each core.
TASKS_PER_CORE = 4


def sample_packages(spark: SparkSession, samples: list[Sample] = PACKAGES) -> DataFrame:
    """The sample packages: sample (its number), and the columns of ``detectors.SCHEMA``."""
    return spark.createDataFrame([(k, *s.row()) for k, s in enumerate(samples)], "sample int, " + detectors.SCHEMA)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package per part, with the contents of the sample that its key falls on: package, sample, and the columns of ``detectors.SCHEMA``."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("package"), (F.col("p_partkey") % len(PACKAGES)).cast("int").alias("s_sample"))
    # a file of millions of keys is one split, and judging a package is work: keys are dealt out before they become packages
    parts = parts.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    own = sample_packages(spark)
    # as many rows as there are samples
    return parts.join(F.broadcast(own), F.col("s_sample") == F.col("sample")).drop("s_sample")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.detect(packages(spark, sf_dir), ["package", "sample"], NOW)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package, sample, malicious, path, reasons) of all packages: those without findings, too."""
    own = packages(spark, sf_dir)
    triggers = detectors.ownership_triggers(own, ["package", "sample"], bad=spark.createDataFrame([("Mallory ",)], "identifier string"))
    found = detectors.detect(own, ["package", "sample"], NOW).unionByName(triggers)
    return detectors.verdicts(found, ["package", "sample"])


def qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualify.qualify(findings(spark, sf_dir))

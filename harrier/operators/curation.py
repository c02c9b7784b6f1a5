"""Human decisions laid over findings: cleared packages, indicators that are false, actors that count less or not at all."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


@dataclass
class Curation:
    """Decisions as rows; ``tables`` gives them as DataFrames. Each method adds one and gives the object back."""

    packages: list[tuple[str, str, str]] = field(default_factory=list)  # ecosystem, name, version ("" for all)
    indicators: list[tuple[str, str]] = field(default_factory=list)  # type, value
    downgraded: list[str] = field(default_factory=list)
    allowed: list[str] = field(default_factory=list)

    def clear_package(self, ecosystem: str, name: str, version: str = "") -> Curation:
        self.packages.append((ecosystem, name, version))
        return self

    def false_positive(self, kind: str, value: str) -> Curation:
        self.indicators.append((kind, value))
        return self

    def downgrade_actor(self, actor: str) -> Curation:
        self.downgraded.append(actor)
        return self

    def allow_actor(self, actor: str) -> Curation:
        self.allowed.append(actor)
        return self

    @property
    def empty(self) -> bool:
        return not (self.packages or self.indicators or self.downgraded or self.allowed)

    @classmethod
    def of(cls, wire: dict) -> Curation:
        """From the decoded JSON document; what is missing is empty."""
        return cls(
            [(x.get("ecosystem", ""), x.get("name", ""), x.get("version", "")) for x in wire.get("clearedPackages") or []], [(x.get("type", ""), x.get("value", "")) for x in wire.get("falsePositiveIocs") or []],
            list(wire.get("downgradedActors") or []), list(wire.get("allowedActors") or []),
        )

    @classmethod
    def load(cls, path: str) -> Curation:
        """From a JSON file; no path or no file is an empty one."""
        return cls.of(json.loads(Path(path).read_text(encoding="utf-8"))) if path.strip() and Path(path).exists() else cls()

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        actors = [(x, False) for x in self.downgraded] + [(x, True) for x in self.allowed]
        return {
            "packages": spark.createDataFrame(self.packages, "ecosystem string, name string, version string"), "indicators": spark.createDataFrame(self.indicators, "type string, value string"), "actors": spark.createDataFrame(actors, "actor string, allowed boolean"),
        }


def _low(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def drop_cleared(found: DataFrame, cleared: DataFrame) -> DataFrame:
    """Rows (with ecosystem, name, version) whose package is not cleared; a cleared package without a version is cleared in all versions. Case does not count."""
    key = lambda version: F.struct(_low("ecosystem"), _low("name"), version)
    known = cleared.select(key(_low("version")).alias("c_key")).distinct()
    own = found.withColumn("c_one", key(_low("version"))).withColumn("c_all", key(F.lit("")))
    for c in ("c_one", "c_all"):
        own = own.join(known.withColumnRenamed("c_key", c), c, "left_anti")
    return own.select(*found.columns)


def drop_false_indicators(found: DataFrame, false: DataFrame, kind: str = "type", value: str = "value") -> DataFrame:
    """Indicators that were not found to be false; case and outer white space do not count."""
    key = lambda k, v: F.struct(text.trim(_low(k)), text.trim(_low(v)))
    known = false.select(key("type", "value").alias("c_key")).distinct()
    return found.withColumn("c_key", key(kind, value)).join(known, "c_key", "left_anti").select(*found.columns)


def judge_actors(found: DataFrame, actors: DataFrame, actor: str = "actor") -> DataFrame:
    """Adds actor_downgraded and actor_allowed; an actor that is allowed is downgraded, too."""
    known = actors.groupBy(text.trim(_low("actor")).alias("c_key")).agg(F.max("allowed").alias("c_allowed"))
    own = found.withColumn("c_key", text.trim(_low(actor))).join(known, "c_key", "left")
    return own.select(*[c for c in found.columns if c not in ("actor_downgraded", "actor_allowed")], F.col("c_allowed").isNotNull().alias("actor_downgraded"), F.coalesce("c_allowed", F.lit(False)).alias("actor_allowed"))

"""What a finding says about intent: its kind, its tactic, what is done, and what tells it from honest use."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By intent: what tells malicious from honest use.
DIFFERENCE = {
    "malicious": "honest packages have no use for it while they are built or installed",
    "exfiltration": "honest packages may read settings or reach a registry, but do not send what they read elsewhere",
    "persistence": "honest packages end with their installation and leave shells, schedulers and other packages alone",
    "obfuscation": "honest packages decode data, not commands, and have nothing to hide from their readers",
    "reconnaissance": "honest packages do not take stock of the machine and report it",
    "dual-use": "where it runs decides: by itself at build or install time, together with another signal, it is abuse",
    "reputation": "a risk, not a proof; it counts beside other signals only",
}
TACTICS = {
    "execution": "TA0002 Execution", "control": "TA0011 Command & Control", "exfil": "TA0010 Exfiltration", "credentials": "TA0006 Credential Access", "persistence": "TA0003 Persistence",
    "evasion": "TA0005 Defense Evasion", "impact": "TA0040 Impact", "access": "TA0001 Initial Access", "context": "context",
}
DEFAULT = ("dual-use", "TA0002 Execution", "meets a rule of the catalogue")


@cache
def registry() -> dict[str, tuple[str, str, str]]:
    """(intent, tactic, behaviour) by signal, from ``qualifications.txt``."""
    out = {}
    for line in Path(__file__).parents[1].joinpath("functions", "qualifications.txt").read_text(encoding="utf-8").splitlines():
        if line and not line.startswith("#"):
            signal, intent, tactic, behaviour = line.split(" ", 3)
            out[signal] = intent, TACTICS[tactic], behaviour
    return out


def table(df: DataFrame) -> DataFrame:
    """The registry as a table (signal, intent, tactic, behaviour, difference); its size is fixed."""
    return df.sparkSession.createDataFrame([(k, *v, DIFFERENCE[v[0]]) for k, v in registry().items()], "signal string, intent string, tactic string, behaviour string, difference string")


def base_signal(name: Column) -> Column:
    """The signal without the mark of the surface it was found on."""
    return F.regexp_replace(name, "^IS-", "")


def key_of(name: Column) -> Column:
    """The registry's entry for a signal: its own, or else the longest (then first by name) that is part of it; null if there is none."""
    base = base_signal(name)
    keys = F.lit(sorted(registry(), key=lambda k: (-len(k), k)))
    return F.coalesce(F.when(F.array_contains(keys, base), base), F.try_element_at(F.filter(keys, lambda k: F.contains(base, k)), F.lit(1)))


def qualify(found: DataFrame, name: str = "id") -> DataFrame:
    """Adds intent, tactic, behaviour and difference to findings; a signal without an entry has a double use."""
    own = found.withColumn("q_key", key_of(F.coalesce(F.col(name), F.lit(""))))
    known = table(found).select(F.col("signal").alias("q_key"), *[F.col(c).alias(f"q_{c}") for c in ("intent", "tactic", "behaviour", "difference")])
    own = own.join(F.broadcast(known), "q_key", "left")  # the registry, of fixed size
    last = dict(zip(("intent", "tactic", "behaviour", "difference"), (*DEFAULT, DIFFERENCE[DEFAULT[0]])))
    return own.select(*found.columns, *[F.coalesce(f"q_{c}", F.lit(x)).alias(c) for c, x in last.items()])

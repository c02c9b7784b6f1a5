"""Which detectors run for which ecosystem: JSON documents, one per ecosystem, laid over defaults."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detectors import CAPABILITIES

FOLDER_VARIABLE = "HARRIER_CONFIG_DIR"
ENDPOINTS = {
    "aur": "https://aur.archlinux.org/rpc/v5", "cargo": "https://crates.io/api/v1", "go": "https://proxy.golang.org", "homebrew": "https://formulae.brew.sh/api",
    "npm": "https://registry.npmjs.org", "nuget": "https://api.nuget.org/v3/index.json", "pypi": "https://pypi.org/pypi", "rubygems": "https://rubygems.org/api/v1",
}
_AUR = set(CAPABILITIES) - {"bad-actor-behaviors"}
_PACKAGES = set(CAPABILITIES) - {"registry-comments", "orphan-takeover", "bin-source", "checksum", "git-history"}
#: Capabilities switched on by default.
DEFAULTS: dict[str, set[str]] = {
    "aur": _AUR, "homebrew": _AUR - {"registry-comments", "bin-source"}, **{e: _PACKAGES for e in ("npm", "pypi", "rubygems", "nuget")}, "cargo": _PACKAGES - {"install-script"}, "go": _PACKAGES - {"install-script", "bad-actor-behaviors"},
}


def folder() -> str:
    return os.environ.get(FOLDER_VARIABLE) or str(Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "harrier")


def load(path: str, ecosystem: str) -> dict | None:
    """{ecosystem, registry_endpoint, capabilities} of an ecosystem's file in a folder; None if there is no file."""
    file = Path(path) / f"{ecosystem}.json"
    if not file.exists():
        return None
    own = json.loads(file.read_text(encoding="utf-8"))
    return {"ecosystem": own.get("ecosystem") or ecosystem, "registry_endpoint": own.get("registry_endpoint") or "", "capabilities": own.get("capabilities")}


def load_all(path: str) -> dict[str, dict]:
    """All of a folder's files by ecosystem; none if there is no folder."""
    own = [load(path, f.stem) for f in sorted(Path(path).glob("*.json"))]
    return {x["ecosystem"]: x for x in own}


def default(ecosystem: str) -> dict | None:
    if ecosystem not in DEFAULTS:
        return None
    return {"ecosystem": ecosystem, "registry_endpoint": ENDPOINTS[ecosystem], "capabilities": {c: True for c in sorted(DEFAULTS[ecosystem])}}


def resolve(ecosystem: str, path: str | None = None) -> dict:
    """The defaults with what the folder's file says laid over them, key by key."""
    base = default(ecosystem) or {"ecosystem": ecosystem, "registry_endpoint": "", "capabilities": None}
    over = load(folder() if path is None else path, ecosystem)
    if over:
        base["registry_endpoint"] = over["registry_endpoint"] or base["registry_endpoint"]
        if over["capabilities"] or base["capabilities"] is not None:
            base["capabilities"] = {**(base["capabilities"] or {}), **(over["capabilities"] or {})}
    return base


def enabled(config: dict | None, capability: str) -> bool:
    """A capability is on unless a config says it is off."""
    return ((config or {}).get("capabilities") or {}).get(capability, True)


def save(path: str, config: dict) -> str:
    Path(path).mkdir(parents=True, exist_ok=True)
    file = Path(path) / f"{config['ecosystem']}.json"
    file.write_text(json.dumps({k: config.get(k) for k in ("ecosystem", "registry_endpoint", "capabilities")}, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return str(file)


def write_defaults(path: str, over: bool = False) -> list[str]:
    """Writes the defaults of all ecosystems; files that are there stay unless they are to be written over."""
    return [save(path, default(e)) for e in sorted(DEFAULTS) if over or not (Path(path) / f"{e}.json").exists()]


def toggle_all(config: dict, on: bool) -> dict:
    return {**config, "capabilities": {c: on for c in CAPABILITIES}}


def match_ecosystem(query: str) -> str | None:
    """The ecosystem that is meant: by its whole name, or else the first that begins with the query, or that has it inside."""
    q = query.strip().lower()
    own = sorted(DEFAULTS)
    return next((e for test in (str.__eq__, str.startswith, str.__contains__) for e in own if q and test(e, q)), None)


def table(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    """(ecosystem, capabilities): one row per ecosystem."""
    return spark.createDataFrame([(e, c.get("capabilities")) for e, c in sorted(configs.items())], "ecosystem string, capabilities map<string,boolean>")


def apply(packages: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """Packages with the capabilities of their ecosystem; what a package says itself goes first."""
    own = table(packages.sparkSession, configs).select(F.col("ecosystem").alias("g_eco"), F.col("capabilities").alias("g_caps"))
    joined = packages.join(F.broadcast(own), F.col("ecosystem") == F.col("g_eco"), "left")  # one row per ecosystem
    none = F.expr("cast(map() as map<string,boolean>)")
    own_ = F.coalesce("capabilities", none)
    merged = F.map_concat(F.map_filter(F.coalesce("g_caps", none), lambda k, _: ~F.map_contains_key(own_, k)), own_)
    return joined.withColumn("capabilities", merged).drop("g_eco", "g_caps")

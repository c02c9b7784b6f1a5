"""Feeds of indicators: a cache of downloaded bundles, how old they may be, and what happens when a feed fails.

Fetching is a function the caller gives (url -> bytes, or an exception); the cache is a folder on the driver. What was loaded
becomes a DataFrame of bundles, one row each, which ``operators.indicators`` parses.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import indicators

Fetch = Callable[[str], bytes]
INDEX_SECONDS, TWEETS_SECONDS = 3600, 24 * 3600
TWEETS = "tweetfeed"


class FeedError(RuntimeError):
    """No feed could be had."""


@dataclass
class Cache:
    """Downloads by name, newest first; file names end in the time of the download in nanoseconds."""

    folder: str
    fetch: Fetch
    now: Callable[[], float] = time.time
    prefix: str = "stix-"

    def _stamp(self, path: Path, slug: str) -> int | None:
        found = re.fullmatch(rf"{re.escape(self.prefix + slug)}-(\d+)\.json", path.name)
        return int(found[1]) if found else None

    def newest(self, slug: str) -> tuple[Path, int] | None:
        own = [(s, p) for p in Path(self.folder).glob(f"{self.prefix}{slug}-*.json") if (s := self._stamp(p, slug)) is not None]
        stamp, path = max(own, default=(0, None))
        return (path, stamp) if path else None

    def _store(self, slug: str, data: bytes) -> None:
        """Written under another name first, so a reader never meets half a file; older downloads go."""
        target = Path(self.folder) / f"{self.prefix}{slug}-{int(self.now() * 1e9)}.json"
        handle, part = tempfile.mkstemp(prefix=f"{self.prefix}part-", dir=self.folder)
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        os.replace(part, target)
        for old in Path(self.folder).glob(f"{self.prefix}{slug}-*.json"):
            if old != target and self._stamp(old, slug) is not None:
                old.unlink()

    def get(self, slug: str, url: str, seconds: float, sha256: str = "", fresh: bool = False) -> tuple[bytes, dict | None]:
        """The bundle, and a warning if it is an old one. ``sha256`` is what a download must have; a cached bundle younger than ``seconds`` is taken as it is, unless a ``fresh`` one is wanted."""
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        held = self.newest(slug)
        if held and not fresh and self.now() - held[1] / 1e9 < seconds:
            return held[0].read_bytes(), None
        code = "stale-cache"
        try:
            data = self.fetch(url)
            if sha256 and hashlib.sha256(data).hexdigest() != sha256.lower():
                code = "checksum-mismatch"
                raise ValueError(f"{url} has another checksum")
        except Exception as error:  # whatever the caller's transport raises
            if not held:
                raise FeedError(f"{url} cannot be had, and there is no earlier download") from error
            age = int(self.now() - held[1] / 1e9)
            return held[0].read_bytes(), {"code": code, "feed": slug, "message": f"download of {age} s ago is used: {error}", "age_seconds": age}
        self._store(slug, data)
        return data, None


@dataclass
class Loaded:
    """Bundles by feed, in order; warnings; hashes come from the bundles, too."""

    bundles: list[tuple[int, str, str]] = field(default_factory=list)  # feed_seq, feed, content
    warnings: list[dict] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """(feed_seq, feed, content): a row per feed, of which there are as many as the index names."""
        return spark.createDataFrame(self.bundles, "feed_seq int, feed string, content string")

    def indicator_set(self, spark: SparkSession) -> DataFrame:
        return indicators.indicator_set(indicators.parse_bundles(self.table(spark)))

    def hashes(self, spark: SparkSession) -> DataFrame:
        return indicators.parse_hashes(self.table(spark).where(f"feed = '{TWEETS}'"))


def _is_bundle(data: bytes) -> bool:
    try:
        return isinstance(json.loads(data), dict)
    except ValueError:
        return False


def load(cache: Cache, index_url: str | None, ecosystems: Iterable[str] = (), tweets_url: str | None = None, everything: bool = False, fresh: bool = False) -> Loaded:
    """Loads the feeds that an index names for some ecosystems (and the generic ones), and the feed of hashes.

    Without an index there is nothing to scan by: that fails. A feed that cannot be had or read is a warning; if there are such
    feeds and nothing else, that fails too. The feed of hashes only ever warns.
    """
    out = Loaded()
    wanted = {"generic", *(e.strip().lower() for e in ecosystems)} - {""}
    failed = 0
    feeds: list[dict] = []
    base = ""
    if index_url:
        data, warning = cache.get("index", index_url, INDEX_SECONDS, fresh=fresh)
        out.warnings += [warning] if warning else []
        try:
            index = json.loads(data)
        except ValueError as error:
            raise FeedError("the index cannot be read") from error
        feeds, base = index.get("feeds") or [], index.get("base_url") or ""
    for feed in feeds:
        if not everything and feed.get("ecosystem") not in wanted:
            continue
        slug = f"{feed.get('ecosystem')}-{feed.get('kind')}"
        url = feed.get("url") or (f"{base.rstrip('/')}/{feed.get('ecosystem')}/{feed.get('kind')}.stix.json" if base else "")
        try:
            data, warning = cache.get(slug, url, INDEX_SECONDS, feed.get("sha256") or "", fresh)
        except FeedError as error:
            failed += 1
            out.warnings.append({"code": "feed-error", "feed": slug, "message": str(error), "age_seconds": 0})
            continue
        out.warnings += [warning] if warning else []
        if not _is_bundle(data):
            failed += 1
            out.warnings.append({"code": "parse-error", "feed": slug, "message": "no JSON", "age_seconds": 0})
            continue
        out.bundles.append((len(out.bundles), slug, data.decode("utf-8", "replace")))
    if tweets_url:
        try:
            data, warning = cache.get(TWEETS, tweets_url, TWEETS_SECONDS, fresh=fresh)
            out.warnings += [warning] if warning else []
            if not _is_bundle(data):
                raise FeedError("no JSON")
            out.bundles.append((len(out.bundles), TWEETS, data.decode("utf-8", "replace")))
        except FeedError as error:
            out.warnings.append({"code": "feed-error", "feed": TWEETS, "message": str(error), "age_seconds": 0})
    if not out.bundles and failed:
        raise FeedError(f"no feed could be loaded, {failed} failed")
    return out


def refresh(cache: Cache, index_url: str, ecosystems: Iterable[str] = (), tweets_url: str | None = None) -> list[dict]:
    """Downloads feeds whatever their age, all of them if no ecosystems are named; gives the warnings."""
    ecosystems = list(ecosystems)
    return load(cache, index_url, ecosystems, tweets_url, everything=not ecosystems, fresh=True).warnings

"""Blocklists in files: four sorted lists, one per kind, and the job that renews them from feeds."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import blocklists

FILES = {"ipv4": "bad-ipv4.txt", "ipv6": "bad-ipv6.txt", "domain": "bad-domains.txt", "email": "bad-emails.txt"}
TITLES = {"ipv4": "bad IPv4 addresses", "ipv6": "bad IPv6 addresses", "domain": "bad hosts", "email": "bad mail addresses"}
#: Lists younger than this are left alone, and bytes of a feed that are read.
FRESH_SECONDS, FEED_BYTES = 12 * 3600, 64 << 20

SET = "kind string, value string"


def feeds_config(source: str | None, fallback: Iterable[tuple[str, str, str]] = ()) -> list[tuple[str, str, str]]:
    """(feed, url, format) of a JSON document; feeds that are switched off or have no key or url are left out.

    A format that is not known, or no feed at all, is an error. With a ``fallback``, that is taken for a document that cannot be used.
    """
    try:
        out = []
        for x in json.loads(source or "")["feeds"]:
            if x.get("enabled") is False or not x.get("key") or not x.get("url"):
                continue
            if x.get("parser") not in blocklists.FORMATS:
                raise ValueError(f"feed {x['key']}: there is no parser {x.get('parser')!r}")
            out.append((x["key"], x["url"], x["parser"]))
        if not out:
            raise ValueError("no feed is switched on")
        return out
    except (ValueError, KeyError, TypeError):
        if fallback := list(fallback):
            return fallback
        raise


def fetched(spark: SparkSession, feeds: Iterable[tuple[str, str, str]], fetch: Callable[[str], bytes]) -> DataFrame:
    """(feed, format, body, error): the feeds' bodies, each fetched on its own; one that fails or is empty has no body but an error."""
    rows = []
    for feed, url, kind in feeds:
        try:
            body = fetch(url)[:FEED_BYTES].decode("utf-8", "replace")
            rows.append((feed, kind, body or None, None if body else "empty"))
        except Exception as error:  # whatever the caller's transport raises
            rows.append((feed, kind, None, str(error)))
    return spark.createDataFrame(rows, "feed string, format string, body string, error string")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, value) of the list files in a folder; files that are not there are empty."""
    there = [str(Path(folder) / name) for name in FILES.values() if (Path(folder) / name).exists()]
    return blocklists.of_lines(spark.read.text(there)) if there else spark.createDataFrame([], SET)


def write(blocklist: DataFrame, folder: str, sources: Iterable[str] = ()) -> int:
    """Writes the four files, sorted and with a head that names the sources and counts the values; gives how many changed. A file that would be the same is left alone.

    The files are for people and other tools, so they are single ones: values go through the driver one partition at a time.
    """
    Path(folder).mkdir(parents=True, exist_ok=True)
    changed = 0
    for kind, name in FILES.items():
        values = [r.value for r in blocklist.where(blocklist["kind"] == kind).select("value").distinct().orderBy("value").toLocalIterator()]
        text = "".join(f"{x}\n" for x in (f"# {TITLES[kind]}", "# made from public feeds; not to be edited", f"# sources: {', '.join(sorted(set(sources)))}", f"# count: {len(values)}", *values))
        path = Path(folder) / name
        if not path.exists() or path.read_text(encoding="utf-8") != text:
            path.write_text(text, encoding="utf-8")
            changed += 1
    return changed


def is_fresh(folder: str, seconds: float = FRESH_SECONDS, now: float | None = None) -> bool:
    """Whether all four files are there and young."""
    paths = [Path(folder) / x for x in FILES.values()]
    return all(p.exists() and (time.time() if now is None else now) - p.stat().st_mtime <= seconds for p in paths)


def renew(spark: SparkSession, folder: str, feeds: Iterable[tuple[str, str, str]], fetch: Callable[[str], bytes], force: bool = False, keep: bool = True, seconds: float = FRESH_SECONDS) -> DataFrame | None:
    """Renews the lists from feeds unless they are fresh; gives the counts by feed, or None. With ``keep``, what the lists held stays, so a feed that fails loses nothing."""
    if not force and is_fresh(folder, seconds):
        return None
    bodies = fetched(spark, feeds, fetch).cache()
    parsed = blocklists.parse(bodies).cache()
    held = spark.createDataFrame(load(spark, folder).collect(), SET) if keep else spark.createDataFrame([], SET)  # read before it is written over
    write(blocklists.merge(parsed, held), folder, [f for f, _, _ in feeds])
    counts = blocklists.counts(parsed, bodies)
    return counts


def main(argv: list[str] | None = None) -> None:
    own = argparse.ArgumentParser(prog="python -m harrier.sources.lists", description="Renews the blocklists in a folder.")
    own.add_argument("--out", required=True)
    own.add_argument("--feeds", required=True, help="JSON document of feeds")
    own.add_argument("--force", action="store_true")
    own.add_argument("--no-merge", action="store_true")
    own.add_argument("--max-age", type=float, default=FRESH_SECONDS, help="seconds")
    own.add_argument("--timeout", type=float, default=30)
    args = own.parse_args(argv)
    from urllib.request import urlopen

    spark = SparkSession.builder.appName("blocklists").getOrCreate()
    counts = renew(spark, args.out, feeds_config(Path(args.feeds).read_text(encoding="utf-8")), lambda url: urlopen(url, timeout=args.timeout).read(FEED_BYTES), args.force, not args.no_merge, args.max_age)
    if counts is None:
        print("the lists are fresh")
    else:
        counts.orderBy("feed").show(1000, truncate=False)


if __name__ == "__main__":
    main()

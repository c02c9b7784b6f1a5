"""Detectors over a package's metadata, name, history and texts, each a column: an array of findings.

Packages have the columns of ``SCHEMA``. ``detect`` concatenates what the rules, the shell analysers and all detectors find that
a package's capabilities allow, in one pass over the packages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.batches import small_batches
from ..functions.catalogue import cwe
from ..functions.regex import holds, to_java
from . import shell
from .rules import findings, hits, of_rule, rule_candidates

SCHEMA = (
    "name string, ecosystem string, capabilities map<string,boolean>, meta struct<name:string,url:string,num_votes:int,popularity:double,out_of_date:bigint,maintainer:string,submitter:string,first_submitted:bigint,license:array<string>,source:array<string>>, "
    "pkgbuild_content string, install_script_content string, prior_pkgbuild_content string, pkgbuild_executes boolean, git_log array<struct<author:string,email:string,ts:bigint,diff:string>>, "
    "maintainer_packages array<struct<name:string,first_submitted:bigint>>, github_stars int, github_not_found boolean, comments array<string>"
)
FINDING = "array<struct<id:string,category:string,class:string,cwe:string,points:int,description:string,matched_line:string>>"
DAY = 86400
BRANDS = "1password bitwarden blender brave chrome chromium code discord firefox gimp keepass librewolf mpv mullvad neovim nordvpn obsidian protonvpn signal slack spotify steam telegram thunderbird tor-browser vlc vscode zen-browser".split()
TAILS = "cracked custom fix fixed free hack lite mod modded patch patched plus premium pro secure updated".split()
POPULAR = (
    "blender brave-bin chromium discord downgrade emacs firefox gamemode gimp google-chrome librewolf-bin lutris mangohud mpv mullvad-vpn neovim nerd-fonts-complete nordvpn-bin obs-studio octopi pamac-aur paru proton-ge-custom protonvpn "
    "slack-desktop spotify steam teams thunderbird timeshift tor-browser ttf-ms-fonts vim visual-studio-code-bin vlc yay zen-browser-bin zoom"
).split()
WORRIES = "malware backdoor trojan keylogger cryptominer ransomware rootkit compromised virus suspicious malicious spyware unsafe dangerous phishing exploit".split()
NETWORK = r"(curl|wget|nc\s|ncat|socat|/dev/tcp|python.*socket|ruby.*socket)"
ONION = r"(?i)\b[a-z2-7]{16,56}\.onion\b|\.onion[/:]"
URL_HOST = "(?i)\\b(?:https?|ftp|git)://([^/\\s\"'`):]+)"
HOOK_KEYS = "preinstall install postinstall preprepare prepare postprepare prepublishOnly".split()


def _f(id_: str, category: str, kind: str, points: int, description: Column | str, line: Column | str = "", number: Column | str | None = None) -> Column:
    number = cwe(id_) if number is None else number
    return F.struct(
        F.lit(id_).alias("id"), F.lit(category).alias("category"), F.lit(kind).alias("class"), (number if isinstance(number, Column) else F.lit(number)).alias("cwe"), F.lit(points).alias("points"),
        (F.lit(description) if isinstance(description, str) else description).alias("description"), (F.lit(line) if isinstance(line, str) else F.coalesce(line, F.lit(""))).alias("matched_line"),
    )


def _list(*cases: tuple[Column, Column]) -> Column:
    """Findings of the cases that hold, in order."""
    return F.array_compact(F.array(*[F.when(when, finding) for when, finding in cases])).cast(FINDING)


def _has(value: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(value, F.lit(to_java(pattern))), F.lit(False))


def _all(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(to_java(pattern)), F.lit(group))


def _first_line(content: Column, pattern: str) -> Column:
    return text.trim(F.try_element_at(F.filter(text.lines(content), lambda x: F.rlike(x, F.lit(to_java(pattern)))), F.lit(1)))


def _s(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _commits() -> Column:
    return F.coalesce(F.size("git_log"), F.lit(0))


def _diff() -> Column:
    return F.coalesce(F.try_element_at("git_log", F.lit(1)).getField("diff"), F.lit(""))


def metadata() -> Column:
    known, votes = F.col("meta").isNotNull(), _n("meta.num_votes")
    c = lambda *a: _f(*a, number="")
    return _list(
        (known & (votes == 0), c("M-VOTES-ZERO", "metadata", "context", 30, "no votes")),
        (known & (votes != 0) & (votes < 5), c("M-VOTES-LOW", "metadata", "context", 20, F.concat(F.lit("few votes: "), votes.cast("string")))),
        (known & (F.coalesce(F.col("meta.popularity"), F.lit(0.0)) == 0), c("M-POP-ZERO", "metadata", "context", 25, "nobody uses it")),
        (known & (_s("meta.maintainer") == ""), c("M-NO-MAINTAINER", "metadata", "context", 20, "no maintainer")),
        (known & (_s("meta.url") == ""), c("M-NO-URL", "metadata", "context", 15, "no upstream url")),
        (known & (F.coalesce(F.size("meta.license"), F.lit(0)) <= 0), c("M-NO-LICENSE", "metadata", "context", 10, "no license")),
        (_n("meta.out_of_date") > 0, c("M-OUT-OF-DATE", "metadata", "context", 5, "flagged as out of date")),
    )


def _days(now: int, since: Column) -> Column:
    return ((F.lit(now) - since) / DAY).cast("bigint")


def maintainer(now: int) -> Column:
    packages = F.coalesce(F.col("maintainer_packages"), F.expr("array()").cast("array<struct<name:string,first_submitted:bigint>>"))
    known, age = F.col("meta").isNotNull(), _days(now, _n("meta.first_submitted"))
    recent = F.size(F.filter(packages, lambda p: F.coalesce(p.first_submitted, F.lit(0)) >= now - 2 * DAY))
    c = lambda *a: _f(*a, number="")
    return _list(
        (known & (F.size(packages) == 1) & (age < 30), c("B-MAINTAINER-NEW", "behavioral", "context", 30, F.concat(F.lit("only package, days old: "), age.cast("string")))),
        (known & (F.size(packages) == 1) & (age >= 30), c("B-MAINTAINER-SINGLE", "behavioral", "context", 15, "only package of its maintainer")),
        (known & (recent >= 3), c("B-MAINTAINER-BATCH", "behavioral", "context", 45, F.concat(F.lit("packages of its maintainer in 48 hours: "), recent.cast("string")))),
    )


def stars() -> Column:
    gone, n = F.coalesce(F.col("github_not_found"), F.lit(False)), F.col("github_stars")
    c = lambda *a: _f(*a, number="")
    return _list(
        (gone, c("M-GITHUB-NOT-FOUND", "metadata", "context", 25, "its repository does not exist", F.col("meta.url"))),
        (~gone & (n == 0), c("M-GITHUB-STARS-ZERO", "metadata", "context", 20, "its repository has no stars")),
        (~gone & (n != 0) & (n < 10), c("M-GITHUB-STARS-LOW", "metadata", "context", 10, F.concat(F.lit("stars of its repository: "), n.cast("string")))),
    )


def comments() -> Column:
    words = text.constants(WORRIES)
    first = F.try_element_at(F.filter("comments", lambda c: F.exists(words, lambda w: F.contains(F.lower(c), w))), F.lit(1))
    word = F.try_element_at(F.filter(words, lambda w: F.contains(F.lower(first), w)), F.lit(1))
    cut = F.when(F.octet_length(first) > 120, F.concat(F.decode(F.substring(F.encode(first, "utf-8"), 1, 120), "utf-8"), F.lit("..."))).otherwise(first)
    return _list((first.isNotNull(), _f("M-COMMENTS-SECURITY", "metadata", "context", 40, F.concat(F.lit("a comment says: "), word), cut, "")))


def onion() -> Column:
    pick = F.coalesce(*[F.when(_has(c, ONION), c) for c in (_s("pkgbuild_content"), _s("install_script_content"), _diff())])
    return _list((pick.isNotNull(), _f("P-ONION-C2", "source-url", "evidence", 65, "address of a Tor hidden service", _first_line(pick, ONION), "CWE-94")))


_SCRIPTS = (r"a-zA-Z\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsGreek}", r"\p{IsHan}", r"\p{IsHangul}", r"\p{IsHiragana}\p{IsKatakana}", r"\p{IsArabic}")


def scripts(label: Column) -> Column:
    """How many scripts the letters of a label are of."""
    other = rf"[\p{{L}}&&[^{''.join(_SCRIPTS)}]]"
    return sum((F.rlike(label, F.lit(p)).cast("int") for p in (*(f"[{s}]" for s in _SCRIPTS), other)), F.lit(0))


def url_hosts(content: Column) -> Column:
    return F.transform(_all(content, URL_HOST, 1), F.lower)


def homograph() -> Column:
    surfaces = F.concat_ws("\n", _s("pkgbuild_content"), _s("install_script_content"), _diff(), F.concat_ws("\n", F.col("meta.source")), _s("meta.url"))
    hosts = url_hosts(surfaces)
    puny = F.try_element_at(F.filter(hosts, lambda h: F.contains(h, F.lit("xn--"))), F.lit(1))
    mixed = F.try_element_at(F.filter(F.flatten(F.transform(hosts, lambda h: F.split(h, r"\."))), lambda x: scripts(x) > 1), F.lit(1))
    return _list(
        (puny.isNotNull(), _f("P-IDN-PUNYCODE-HOST", "source-url", "context", 0, "punycode host", puny, "CWE-1007")),
        (mixed.isNotNull(), _f("P-HOMOGRAPH-MIXED-SCRIPT", "source-url", "evidence", 60, "a host's label mixes scripts", mixed, "CWE-1007")),
    )


def array_entries(content: Column, name: str | Column) -> Column:
    """How many entries a shell array has; 0 if there is none or it is computed."""
    name = F.lit(name) if isinstance(name, str) else name
    body = F.call_function("regexp_extract", content, F.concat(F.lit(r"(?dms)^\Q"), name, F.lit(r"\E=\((.*?)\)")), F.lit(1))
    return F.when(_has(body, r"\$\(|`|\$\{[^}]*\[[@*]\]"), 0).otherwise(F.size(_all(body, "['\"][^'\"]*['\"]|[^\\s'\")()]+")))


def all_skip(content: Column) -> Column:
    """Whether there are checksums, all of them SKIP."""
    entries = F.flatten(F.transform(_all(content, r"(?ms)^(?:b2|md5|sha\d+)sums=\((.*?)\)", 1), lambda b: _all(b, "'([^']*)'", 1)))
    return (F.size(entries) > 0) & F.forall(entries, lambda e: e == "SKIP")


def checksums() -> Column:
    content = _s("pkgbuild_content")
    recipe = text.is_recipe(content) & (content != "")
    vcs = _has(F.col("name"), r"-(bzr|git|hg|svn)\z")
    found = _all(content, r"(?m)^source(_[a-zA-Z0-9_]+)?\s*=\s*\(", 1)
    kinds = text.constants(("md5sums", "sha256sums", "sha512sums", "b2sums"))
    pairs = F.flatten(F.transform(found, lambda s: F.transform(kinds, lambda k: F.struct(s.alias("s"), k.alias("k"), array_entries(content, F.concat(F.lit("source"), s)).alias("n"), array_entries(content, F.concat(k, s)).alias("m")))))
    wrong = F.try_element_at(F.filter(pairs, lambda p: (p.n > 0) & (p.m > 0) & (p.n != p.m)), F.lit(1))
    c = lambda *a: _f(*a, number="")
    return _list(
        (recipe & ~vcs & ~_has(content, r"(?m)^(b2|md5|sha1|sha224|sha256|sha384|sha512)sums(_[a-zA-Z0-9_]+)?\s*="), c("P-NO-CHECKSUMS", "pkgbuild", "context", 30, "no checksums")),
        (recipe & ~vcs & all_skip(content), c("P-SKIP-ALL", "pkgbuild", "context", 25, "all checksums are skipped")),
        (recipe & _has(content, r"(?m)^(md5|sha1)sums=") & ~_has(content, r"(?m)^(b2|sha(256|384|512))sums="), c("P-WEAK-CHECKSUMS", "pkgbuild", "context", 10, "weak checksums only")),
        (recipe & wrong.isNotNull(), c("P-CHECKSUM-MISMATCH", "pkgbuild", "context", 25, F.concat(wrong.k, wrong.s, F.lit(" has "), wrong.m.cast("string"), F.lit(" entries, not "), wrong.n.cast("string")))),
    )


def names() -> Column:
    """Impersonation of a brand, or a name one edit from (or around) a popular package's."""
    name, eco = _s("name"), _s("ecosystem")
    open_ = eco.isin("", "aur") & (_n("meta.num_votes") < 10)
    brand = F.regexp_extract(name, rf"^({'|'.join(sorted(BRANDS, key=len, reverse=True))})-({'|'.join(sorted(TAILS, key=len, reverse=True))})(-bin|-git)?$", 1)
    popular = text.constants(POPULAR)
    near = F.try_element_at(F.filter(popular, lambda p: F.levenshtein(name, p) == 1), F.lit(1))
    inside = F.try_element_at(F.filter(popular, lambda p: (F.octet_length(name) > F.octet_length(p)) & (F.startswith(name, p) | F.endswith(name, p))), F.lit(1))
    return _list(
        (open_ & (brand != ""), _f("B-NAME-IMPERSONATE", "name", "evidence", 65, F.concat(F.lit("reads like a version of "), brand))),
        (open_ & (brand == "") & near.isNotNull(), _f("B-TYPOSQUAT", "name", "evidence", 55, F.concat(F.lit("one edit from "), near))),
        (open_ & (brand == "") & inside.isNotNull(), _f("B-TYPOSQUAT", "name", "context", 55, F.concat(F.lit("has in it "), inside))),
    )


def domain_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return F.lower(F.regexp_extract(rest, r"^[^/:]*", 0))


def plain_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^(www|dl|download)\.", "")


def github_owner(url: Column) -> Column:
    return F.when(F.endswith(plain_domain(F.regexp_extract(url, r"(?s)^.*?://([^/]*)", 1)), F.lit("github.com")), F.lower(F.regexp_extract(url, r"(?s)^.*?://[^/]*/([^/]*)", 1))).otherwise("")


def source_urls(content: Column, upstream: Column) -> Column:
    bodies = _all(content, r"(?ms)^source(?:_[a-zA-Z0-9_]+)?\s*=\s*\((.*?)\)", 1)
    tokens = F.flatten(F.transform(bodies, lambda b: F.transform(_all(b, "['\"][^'\"]+['\"]|\\S+"), lambda t: F.regexp_replace(t, "^['\"](.*)['\"]$", "$1"))))
    tokens = F.transform(tokens, lambda t: F.regexp_replace(t, r"(?s)^.*?\+http", "http"))
    tokens = F.filter(F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit("${url}"), upstream), F.lit("$url"), upstream)), lambda t: ~F.rlike(t, F.lit(r"\$\{?\w+\}?")))
    return F.transform(tokens, lambda t: F.regexp_replace(t, r"(?s)^.*?::", ""))


def binary_sources() -> Column:
    up = _s("meta.url")
    applies = F.endswith(_s("name"), F.lit("-bin")) & (domain_of(up) != "")
    urls = F.filter(source_urls(_s("pkgbuild_content"), up), lambda u: domain_of(u) != "")
    both = lambda u: (plain_domain(domain_of(u)) == "github.com") & (plain_domain(domain_of(up)) == "github.com")
    owner = F.try_element_at(F.filter(urls, lambda u: both(u) & (github_owner(u) != "") & (github_owner(up) != "") & (github_owner(u) != github_owner(up))), F.lit(1))
    far = F.filter(urls, lambda u: ~both(u) & (plain_domain(domain_of(u)) != plain_domain(domain_of(up))))
    return F.when(applies, F.concat(
        _list((owner.isNotNull(), _f("B-BIN-GITHUB-ORG-MISMATCH", "behavioral", "evidence", 50, F.concat(F.lit("binaries of "), github_owner(owner)), owner))),
        F.transform(far, lambda u: _f("B-BIN-DOMAIN-MISMATCH", "behavioral", "evidence", 30, F.concat(F.lit("binaries from "), domain_of(u)), u)).cast(FINDING),
    )).otherwise(F.array().cast(FINDING))


def takeover(now: int) -> Column:
    sub, own = _s("meta.submitter"), _s("meta.maintainer")
    changed = (sub != "") & (own != "") & (sub != own)
    author = F.try_element_at("git_log", F.lit(1)).getField("author")
    earlier = F.transform(F.slice("git_log", 2, F.greatest(_commits(), F.lit(1))), lambda c: F.coalesce(c.author, F.lit("")))
    new = (_commits() >= 2) & (F.lit(now) - _n("meta.first_submitted") > 90 * DAY) & ~F.array_contains(earlier, F.coalesce(author, F.lit("")))
    return _list(
        (changed, _f("B-SUBMITTER-CHANGED", "behavioral", "context", 15, F.concat(F.lit("maintained by "), own, F.lit(", submitted by "), sub), number="")),
        (changed & F.coalesce(new, F.lit(False)), _f("B-ORPHAN-TAKEOVER", "behavioral", "evidence", 50, F.concat(F.lit("adopted, with a new author: "), F.coalesce(author, F.lit(""))))),
    )


def history(now: int) -> Column:
    oldest = F.try_element_at("git_log", F.lit(-1)).getField("ts")
    created = F.when(_n("meta.first_submitted") > 0, F.col("meta.first_submitted")).otherwise(F.coalesce(oldest, F.lit(0)))
    age = _days(now, created)
    authors = F.size(F.array_distinct(F.transform("git_log", lambda c: F.coalesce(c.author, F.lit("")))))
    c = lambda *a: _f(*a, number="")
    return _list(
        (_commits() == 1, c("T-SINGLE-COMMIT", "temporal", "context", 20, "one commit")),
        ((_commits() > 0) & (created > 0) & (created < now) & (age < 7), c("T-NEW-PACKAGE", "temporal", "context", 25, F.concat(F.lit("days old: "), age.cast("string")))),
        (_has(_diff(), r"\+.*" + NETWORK) & ~_has(_s("prior_pkgbuild_content"), NETWORK), _f("T-MALICIOUS-DIFF", "temporal", "evidence", 55, "the latest commit brings network code")),
        ((_commits() >= 2) & (authors > 1), c("T-AUTHOR-CHANGE", "temporal", "context", 25, "several authors")),
    )


def line_set(content: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(text.lines(content), text.trim), lambda x: x != ""))


def changed_percent(new: Column, old: Column) -> Column:
    """Of the larger revision's distinct lines, the percentage that both do not share, cut to an integer; null if the old one has none."""
    a, b = line_set(new), line_set(old)
    total = F.greatest(F.size(a), F.size(b))
    return F.when(F.size(b) > 0, ((total - F.size(F.array_intersect(a, b))) / total * 100).cast("int"))


def _only_skip(content: Column) -> Column:
    bodies = _all(content, r"(?m)^(?:b2|md5|sha1|sha224|sha256|sha384|sha512)sums(?:_[a-z0-9_]+)?=[^(]*\(([^)]*)\)", 1)
    words = F.transform(F.flatten(F.transform(bodies, lambda b: F.split(b, r"\s+"))), lambda w: F.regexp_replace(w, "^['\"]+|['\"]+$", ""))
    return F.forall(words, lambda w: w.isin("", "SKIP"))


def _source_domains(content: Column) -> Column:
    bodies = _all(content, r"(?m)^source(?:_[a-z0-9_]+)?\s*=\s*\(([^)]*)\)", 1)
    return F.array_distinct(F.filter(F.flatten(F.transform(bodies, lambda b: F.transform(_all(b, "https?://([^/\\s'\"]+)", 1), F.lower))), lambda d: ~F.contains(d, F.lit("$"))))


#: Points from which a rule that a new revision brings counts by itself.
NEW_RULE_POINTS = 60


def new_suspicious(new_found: Column, old_found: Column) -> Column:
    """The first strong rule for recipes that the new revision meets and the old one did not, given the candidates of both."""
    strong = lambda r: r.section == "recipe" and r.points >= NEW_RULE_POINTS
    new, old = _s("pkgbuild_content"), _s("prior_pkgbuild_content")
    k = F.try_element_at(F.array_except(hits(new, new_found, strong), hits(old, old_found, strong)), F.lit(1))
    fresh = F.array_compact(F.array(F.when((new != "") & (old != ""), k)))

    def finding(k: Column) -> Column:
        line = text.trim(F.try_element_at(F.filter(text.lines(new), lambda x: holds(x, of_rule(k, lambda r: to_java(r.pattern)))), F.lit(1)))
        return _f("T-DIFF-NEW-SUSPICIOUS", "temporal", "evidence", 40, F.concat(F.lit("new in this revision: "), of_rule(k, lambda r: r.id)), line, of_rule(k, lambda r: cwe(r.id)))

    return F.transform(fresh, finding).cast(FINDING)


def revision() -> Column:
    """What the latest revision of a recipe changed; new rule hits are ``new_suspicious``."""
    new, old = _s("pkgbuild_content"), _s("prior_pkgbuild_content")
    both = (new != "") & (old != "")
    sums = r"(?m)^(b2|md5|sha1|sha224|sha256|sha384|sha512)sums(_[a-z0-9_]+)?="
    had, has = _has(old, sums), _has(new, sums)
    added = F.array_sort(F.array_except(_source_domains(new), _source_domains(old)))
    percent = changed_percent(new, old)
    return _list(
        (both & had & ~has, _f("T-DIFF-CHECKSUM-REMOVED", "temporal", "evidence", 35, "checksums are gone")),
        (both & had & has & ~_only_skip(old) & _only_skip(new), _f("T-DIFF-CHECKSUM-REMOVED", "temporal", "evidence", 35, "checksums are skipped now")),
        (both & (F.size(_source_domains(old)) > 0) & (F.size(added) > 0), _f("T-DIFF-SOURCE-DOMAIN-CHANGED", "temporal", "evidence", 30, F.concat(F.lit("new source domains: "), F.array_join(added, ", ")))),
        (both & (percent > 50), _f("T-DIFF-MAJOR-REWRITE", "temporal", "context", 15, F.concat(percent.cast("string"), F.lit("% of lines changed")), number="")),
    )


def behaviours() -> Column:
    manifest, hooks = _s("pkgbuild_content"), _s("install_script_content")
    both = F.concat_ws("\n", F.nullif(manifest, F.lit("")), F.nullif(hooks, F.lit("")))
    eco = F.lower(_s("ecosystem"))
    hook = F.rlike(manifest, F.lit(rf"""(?:"({'|'.join(HOOK_KEYS)})"|'({'|'.join(HOOK_KEYS)})')"""))
    js, py = eco.isin("npm", "node", "") & hook, eco.isin("pypi", "python", "")
    e = lambda name, why, kind="evidence": _f(name, "behavioral", kind, 0, why)
    return _list(
        (eco.isin("rubygems", "gem", "") & _has(both, r"Gem\.(post|pre)_install_hooks\s*(?:\.push|\.unshift|<<)"), e("GEM-GLOBAL-INSTALL-HOOK", "registers a hook for every later gem")),
        (py & _has(both, r"(?m)^[^\n]*(\.pth[^\n]*\bimport\b|\bimport\b[^\n]*\.pth)"), e("PY-PTH-AUTOIMPORT-PERSISTENCE", "writes a .pth file that runs code")),
        (js & _has(both, r"(?:Buffer\.from|atob)\s*\(") & _has(both, r"(?:dgram\.|dns\.|fetch\s*\(|http\.(get|request)|https?://|net\.(Socket|connect|createConnection))"), e("JS-HOOK-DECODE-EGRESS-SEQ", "an install hook decodes and reaches the network", "trigger")),
        (js & _has(both, r"(?i)(?:import|require)\s*\(\s*['\"]https?://|import\s+[^'\"]*['\"]https?://"), e("JS-INSTALL-REMOTE-IMPORT", "an install hook imports from a url")),
        (py & _has(both, r"~/\.(aws/credentials|docker/config\.json|netrc|pypirc|ssh/id_(ecdsa|ed25519|rsa))") & _has(both, r"httpx\.(Client|get|post)|requests\.(get|post|put)|socket\.connect|urlopen"), e("PY-SETUP-CRED-EXFIL", "reads credentials and reaches the network")),
        (py & _has(both, r"(?i)(?:importlib|imp\b)[\s\S]{0,120}(?:compile\s*\(|eval\s*\(|exec(?:_module)?\s*\()"), e("PY-SETUP-IMPORTLIB-EXEC", "loads a module and runs it")),
        (eco.isin("cargo", "rust", "") & _has(both, r"\.cargo[/\\]config") & _has(both, r"File::create|OpenOptions|\.write\s*\(|fs::write|write_to_path"), e("CARGO-CONFIG-PERSISTENCE", "writes the cargo configuration")),
        (eco.isin("nuget", "dotnet", "") & _has(both, r"(?i)Assembly\.Load(?:File|From)?\s*\(|\[System\.Reflection\.Assembly\]::Load") & _has(both, r"(?i)HttpClient|Invoke-(RestMethod|WebRequest)|Net\.WebClient"), e("NUGET-ASSEMBLYLOAD-EGRESS", "loads an assembly and reaches the network")),
    )


def ownership(prior: Column, seen: Column, bad: Column) -> Column:
    """Triggers of a change of owner: the prior maintainer, whether the owner was seen before, and whether it is known as bad."""
    own, before, sub = text.trim(_s("meta.maintainer")), text.trim(F.coalesce(prior, F.lit(""))), text.trim(_s("meta.submitter"))
    t = lambda name, why: _f(name, "metadata", "trigger", 0, why, own, "CWE-506")
    return _list(
        ((before != "") & (own != "") & (F.lower(before) != F.lower(own)), t("MT-OWNERSHIP-TRANSFER", F.concat(F.lit("was maintained by "), before))),
        ((sub != "") & (own != "") & (F.lower(sub) != F.lower(own)), t("MT-ORPHAN-ADOPTION", F.concat(F.lit("was submitted by "), sub))),
        ((own != "") & ~F.coalesce(seen, F.lit(False)), t("MT-NEW-MAINTAINER", "the maintainer is new")),
        ((own != "") & F.coalesce(bad, F.lit(False)), t("MT-OWNER-KNOWN-BAD", "the maintainer is a known bad actor")),
    )


def enabled(key: str) -> Column:
    """A capability counts as enabled unless it is switched off."""
    return F.coalesce(F.try_element_at("capabilities", F.lit(key)), F.lit(True))


#: Capabilities of the detectors in ``detect``, of what runs beside it, and of the scan for indicators.
CAPABILITIES = (
    "manifest-patterns source-url-patterns gtfobins shell-obfuscation install-script onion-c2 homograph checksum name-typosquat bin-source orphan-takeover git-history manifest-diff "
    "metadata-reputation maintainer-batch github-stars registry-comments bad-actor-behaviors ownership-hijack badhash ioc-extract goodkeys ioc-scan"
).split()


def detectors(now: int) -> dict[str, Column]:
    """The detectors beside the rule and shell scans, by the capability that switches them, in order."""
    return {
        "onion-c2": onion(), "homograph": homograph(), "checksum": checksums(), "name-typosquat": names(), "bin-source": binary_sources(), "orphan-takeover": takeover(now), "git-history": history(now),
        "manifest-diff": F.concat(new_suspicious(F.col("d_recipe"), F.col("d_prior")), revision()), "metadata-reputation": metadata(), "maintainer-batch": maintainer(now), "github-stars": stars(), "registry-comments": comments(),
        "bad-actor-behaviors": behaviours(),
    }


def with_findings(packages: DataFrame, now: int, out: str = "findings") -> DataFrame:
    """Adds the array of all findings of a package, in order. ``now`` is the time in seconds to judge by.

    A detector runs unless its capability is switched off; ``install-script`` switches all that looks at install scripts. Null
    texts and metadata find nothing. Nothing is shuffled.
    """
    small_batches(packages.sparkSession)
    recipe, hooks, eco = _s("pkgbuild_content"), _s("install_script_content"), _s("ecosystem")
    runs, always = F.coalesce(F.col("pkgbuild_executes"), F.lit(False)), F.lit(True)
    own = packages.select("*", rule_candidates(recipe).alias("d_recipe"), rule_candidates(hooks).alias("d_hooks"), rule_candidates(_s("prior_pkgbuild_content")).alias("d_prior"))
    own = own.withColumn("d_text", F.when(enabled("shell-obfuscation"), recipe)).withColumn("d_hook_text", F.when(enabled("shell-obfuscation") & enabled("install-script"), hooks))
    own = shell.analyse(own, "d_text", "d_shell")
    own = shell.analyse(own, "d_hook_text", "d_hook_shell", "IS-", " (in install script)")
    scripts_ = enabled("install-script") & (hooks != "")
    in_recipe = findings(recipe, F.col("d_recipe"), ("recipe", "source", "binaries"), runs, eco, gates={"recipe": enabled("manifest-patterns"), "source": enabled("source-url-patterns"), "binaries": enabled("gtfobins")})
    in_hooks = findings(hooks, F.col("d_hooks"), ("hook", "binaries"), always, eco, {"binaries": "IS-"}, {"binaries": enabled("gtfobins")})
    parts = [(recipe != "", in_recipe), (always, F.col("d_shell")), (scripts_, in_hooks), (always, F.col("d_hook_shell")), *((enabled(capability), column) for capability, column in detectors(now).items())]
    none = F.array().cast(FINDING)
    return own.withColumn(out, F.concat(*[F.when(when, part.cast(FINDING)).otherwise(none) for when, part in parts])).drop("d_recipe", "d_hooks", "d_prior", "d_text", "d_hook_text", "d_shell", "d_hook_shell")


def detect(packages: DataFrame, keys: list[str], now: int) -> DataFrame:
    """All findings of ``with_findings``, one row each: the keys, seq in order, and the finding's fields."""
    return with_findings(packages, now, "d_all").select(*keys, F.posexplode("d_all").alias("seq", "f")).select(*keys, "seq", "f.*")


def judged(packages: DataFrame, keys: list[str], now: int) -> DataFrame:
    """(keys, malicious, path, reasons) of all packages by their own findings, without a shuffle: their first evidence decides."""
    proof = F.try_element_at(F.filter("d_all", lambda f: f["class"] == "evidence"), F.lit(1))
    own = with_findings(packages, now, "d_all").withColumn("d_proof", proof)
    return own.select(*keys, F.col("d_proof").isNotNull().alias("malicious"), F.when(F.col("d_proof").isNotNull(), "evidence").otherwise("").alias("path"), F.array_compact(F.array(described(F.col("d_proof.id"), F.col("d_proof.description")))).alias("reasons"))


def described(name: Column, why: Column) -> Column:
    return F.when(F.coalesce(why, F.lit("")) != "", F.concat_ws(": ", name, why)).otherwise(name)


def ownership_triggers(packages: DataFrame, keys: list[str], revisions: DataFrame | None = None, seen: DataFrame | None = None, bad: DataFrame | None = None) -> DataFrame:
    """Triggers of a change of owner, one row each like findings of ``detect``.

    ``revisions(keys, prior_maintainer)`` has the maintainer before; ``seen(identifier)`` and ``bad(identifier)`` are the owners
    that were met before and the known bad actors, compared without case and outer white space. What is not given is not
    judged. The tables are joined by owner, and by keys, with whatever join their size asks for.
    """
    own = packages.withColumn("o_owner", F.nullif(F.lower(text.trim(_s("meta.maintainer"))), F.lit("")))
    own = own.join(revisions.select(*keys, "prior_maintainer"), keys, "left") if revisions is not None else own.withColumn("prior_maintainer", F.lit(None).cast("string"))
    for name, table, without in (("o_seen", seen, True), ("o_bad", bad, False)):
        if table is None:
            own = own.withColumn(name, F.lit(without))
        else:
            known = table.select(F.lower(text.trim(F.col("identifier"))).alias("o_owner")).distinct().withColumn(name, F.lit(True))
            own = own.join(known, "o_owner", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    found = own.where(F.col("meta").isNotNull()).select(*keys, F.posexplode(ownership(F.col("prior_maintainer"), F.col("o_seen"), F.col("o_bad"))).alias("at", "f"))
    return found.select(*keys, (F.col("at") + 1_000_000).alias("seq"), "f.*")


IDENTITY = {"MT-OWNERSHIP-TRANSFER": "owner-change", "MT-ORPHAN-ADOPTION": "owner-change", "MT-CHANGED-EMAIL": "email", "MT-NEW-MAINTAINER": "new-maintainer", "MT-NEW-CONTRIBUTOR": "new-contributor", "MT-NEW-REPORTER": "new-reporter"}
PAYLOAD = shell.PAYLOAD


def verdicts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, malicious, path, reasons) of each package with findings, in one aggregation.

    The first evidence decides. Without any, a payload trigger together with a change of identity (or a known bad owner)
    does. Reasons are in order: payload, owner, then the last of each identity family by family name.
    """
    said = described(F.col("id"), F.col("description"))
    trigger = F.col("class") == "trigger"
    family = F.coalesce(*[F.when(F.col("id") == k, F.lit(v)) for k, v in IDENTITY.items()])
    f = findings.select(*keys, "seq", said.alias("said"), (F.col("class") == "evidence").alias("proof"), (trigger & (F.col("id") == PAYLOAD)).alias("payload"), (trigger & (F.col("id") == "MT-OWNER-KNOWN-BAD")).alias("owner"), F.when(trigger, family).alias("family"))
    g = f.groupBy(*keys).agg(
        F.min_by("said", F.when(F.col("proof"), F.col("seq"))).alias("proof"), F.max_by("said", F.when(F.col("payload"), F.col("seq"))).alias("payload"), F.max_by("said", F.when(F.col("owner"), F.col("seq"))).alias("owner"),
        *[F.max_by("said", F.when(F.col("family") == x, F.col("seq"))).alias(f"f_{k}") for k, x in enumerate(sorted(set(IDENTITY.values())))],
    )
    families = F.array_compact(F.array(*[F.col(f"f_{k}") for k in range(len(set(IDENTITY.values())))]))
    proved = F.col("proof").isNotNull()
    joint = F.col("payload").isNotNull() & ((F.size(families) > 0) | F.col("owner").isNotNull())
    reasons = F.when(proved, F.array("proof")).when(joint, F.concat(F.array_compact(F.array("payload", "owner")), families)).otherwise(F.array().cast("array<string>"))
    return g.select(*keys, (proved | joint).alias("malicious"), F.when(proved, "evidence").when(joint, "payload+identity").otherwise("").alias("path"), reasons.alias("reasons"))

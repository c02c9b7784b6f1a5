"""Analysers of shell scripts: commands put together from variables, hidden in data, or fetched and run.

All are array expressions over the lines of a script. ``analyse`` adds their findings as one array; steps that several
analysers share are columns of their own, so they are computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.catalogue import cwe
from ..functions.regex import to_java
from .rules import FINDING

#: Variables that build recipes and compilers define anyway; they are not followed.
STANDARD = (
    "arch b2sums backup changelog checkdepends conflicts depends epoch groups install license makedepends md5sums noextract optdepends options pkgdesc pkgname pkgrel pkgver provides replaces "
    "sha1sums sha224sums sha256sums sha384sums sha512sums source url validpgpkeys CFLAGS CGO_CFLAGS CGO_CPPFLAGS CGO_CXXFLAGS CGO_LDFLAGS CPPFLAGS CXXFLAGS GOFLAGS LDFLAGS MAKEFLAGS pkgdir srcdir startdir"
).split()
COMMANDS = "curl wget nc ncat bash sh python python3 python2 perl ruby php lua socat telnet".split()
PIPES = [(a, b) for a in ("curl", "wget") for b in ("bash", "sh", "python", "python3")]
BUILDERS = ("make", "cmake", "cargo", "gcc", "g++", "go build", "go install", "rustc", "javac", "mvn", "gradle", "meson", "ninja", "configure", "python setup.py", "pip install", "npm run build", "yarn build", "qmake", "scons", "waf")
NAME = "[A-Za-z_][A-Za-z0-9_]*"
ASSIGNMENT = rf"""(?:^|;)\s*({NAME})=(?:"([^"]*)"|'([^']*)'|([^;"'\s]*))"""
REFERENCE = rf"\$\{{?({NAME})\}}?"
ESCAPE = r"""['"]?\\+(x[0-9a-fA-F]{2}|[0-7]{3})['"]?\s*\)"""
SPELLED = (r"\$\(\s*printf\s+" + ESCAPE, r"\$\(\s*echo\s+-[Een]+\s+" + ESCAPE)
LONG_HEX = r"[0-9a-fA-F]{129,}"
LONG_BASE64 = r"[A-Za-z0-9+/]{100,}={0,3}"
SUMS_LINE = r"(?i)(b2|md5|sha\d+)sums"
SUMS_OPEN = r"(?i)(b2|md5|sha\d+)sums(_[a-zA-Z0-9_]+)?\s*=\s*\("
HEREDOC = r"""<<-?\s*['"]?(\w+)['"]?"""
TO_FILE = r"(curl\s+.*-[Oo]\s|curl\s+.*>\s|wget\s+.*-O\s)"
EXECUTABLE = r"chmod\s+\+x\s"
#: A here-document counts from so many bits a byte and so many bytes on.
HEREDOC_BITS, HEREDOC_BYTES = 5.0, 200
PAYLOAD = "SA-HIGH-ENTROPY-HEREDOC"


def _java(pattern: str) -> Column:
    return F.lit(to_java(pattern))


def _all(value: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(value, _java(pattern), F.lit(group))


def assignments(lines: Column) -> Column:
    """Array of (name, value) of all variables that are set, each once, with the value it is set to last."""

    def of_line(line: Column) -> Column:
        values = F.arrays_zip(_all(line, ASSIGNMENT, 1).alias("name"), _all(line, ASSIGNMENT, 2).alias("a"), _all(line, ASSIGNMENT, 3).alias("b"), _all(line, ASSIGNMENT, 4).alias("c"))
        return F.transform(values, lambda v: F.struct(v["name"].alias("name"), F.when(v["a"] != "", v["a"]).when(v["b"] != "", v["b"]).otherwise(v["c"]).alias("value")))

    found = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("="))), of_line))
    return F.filter(found, lambda v: ~F.array_contains(text.constants(STANDARD), v["name"]))


def environment(found: Column) -> Column:
    """A map of ``assignments``: the last value of each name."""
    names = F.transform(found, lambda v: v["name"])
    last = F.filter(found, lambda v, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), v["name"]))
    return F.map_from_entries(last)


def resolved(line: Column, env: Column) -> Column:
    """The line with known variables replaced, in one pass: values are not looked into."""
    parts, names, whole = F.split(line, to_java(REFERENCE), -1), _all(line, REFERENCE, 1), _all(line, REFERENCE, 0)
    values = F.zip_with(names, whole, lambda n, w: F.coalesce(F.try_element_at(env, n), w))
    return F.array_join(F.zip_with(parts, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def dangerous_pipe(line: Column) -> Column:
    """The first downloader and interpreter that the line joins by a pipe, as ``curl|sh``; null if there are none."""
    parts = F.split(F.lower(line), r"\|")
    met = lambda k: F.filter(text.constants(f"{a}|{b}" for a, b in PIPES), lambda p: F.contains(F.element_at(parts, k), F.substring_index(p, "|", 1)) & F.contains(F.element_at(parts, k + 1), F.substring_index(p, "|", -1)))
    return F.when(F.size(parts) > 1, _first(F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), met))))


def has_word(value: Column, word: Column) -> Column:
    """Whether a word stands in the value, not as a part of another one."""
    return F.contains(value, word) & F.rlike(value, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), word, F.lit(r"\E(?![A-Za-z0-9_])")))


def assembled_command(line: Column, as_resolved: Column, env: Column) -> Column:
    """The first dangerous command that only several variables together make up; null if there is none."""
    low, whole = F.lower(line), F.lower(as_resolved)
    held = lambda c: F.exists(F.map_values(env), lambda v: has_word(F.lower(v), c))
    return _first(F.filter(text.constants(COMMANDS), lambda c: has_word(whole, c) & ~has_word(low, c) & ~held(c)))


def _finding(name: str, kind: str, points: int, why: Column | str, line: Column | str = "") -> Column:
    return F.struct(
        F.lit(name).alias("id"), F.lit("shell").alias("category"), F.lit(kind).alias("class"), F.lit(cwe(name)).alias("cwe"), F.lit(points).alias("points"),
        (F.lit(why) if isinstance(why, str) else why).alias("description"), (F.lit(line) if isinstance(line, str) else F.coalesce(line, F.lit(""))).alias("matched_line"),
    ).cast(FINDING)


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _judged(x: Column, env: Column) -> Column:
    """A resolved line (at, line, now) with the dangerous pipe and the command that it became; not those that it names itself."""
    low = F.lower(x.line)
    own = lambda pipe: F.contains(low, F.substring_index(pipe, "|", 1)) & F.contains(low, F.substring_index(pipe, "|", -1))
    pipe = _let(dangerous_pipe(x.now), lambda p: F.when(~own(p), p))
    return F.struct(x["at"].alias("at"), x.line.alias("line"), pipe.alias("pipe"), assembled_command(x.line, x.now, env).alias("command"))


def _concatenations(lines: Column) -> Column:
    """Findings from the resolved lines (at, line, pipe, command)."""
    place = lambda x: (x["at"] + 1).cast("string")

    def both(run: Column, cmd: Column) -> Column:
        first = F.when(run.isNotNull(), _finding("SA-VAR-CONCAT-EXEC", "evidence", 85, F.concat(F.lit("variables make up "), run.pipe, F.lit(" on line "), place(run)), text.trim(run.line)))
        second = F.when(cmd.isNotNull(), _finding("SA-VAR-CONCAT-CMD", "evidence", 55, F.concat(F.lit("variables make up "), cmd.command, F.lit(" on line "), place(cmd)), text.trim(cmd.line)))
        return F.when(cmd["at"] < run["at"], F.array(second, first)).otherwise(F.array(first, second))

    found = _let(
        _first(F.filter(lines, lambda x: x.pipe.isNotNull())),
        lambda run: _let(_first(F.filter(lines, lambda x: x.command.isNotNull() & (run.isNull() | (x["at"] != run["at"])))), lambda cmd: both(run, cmd)),
    )
    return F.array_compact(found)


def _indirect(content: Column, lines: Column, env: Column) -> Column:
    """A variable that holds a dangerous command, where a command is expected; of several the first by name."""
    names = F.array_sort(F.map_keys(F.map_filter(env, lambda _, v: F.array_contains(text.constants(COMMANDS), F.lower(v)))))
    pattern = lambda n: F.concat(F.lit(r"(?dm)(?:^|\||\|\||&&|;)[\t\n\f\r ]*\$\{?\Q"), n, F.lit(r"\E\}?"))
    name = F.slice(F.filter(names, lambda n: F.rlike(content, pattern(n))), 1, 1)
    line = lambda n: _first(F.filter(lines, lambda x: F.rlike(x, pattern(n))))
    return F.transform(name, lambda n: _finding("SA-INDIRECT-EXEC", "evidence", 70, F.concat(F.lit("runs $"), n, F.lit(", which holds "), F.lower(F.element_at(env, n))), text.trim(line(n))))


def _spelled(lines: Column) -> Column:
    counts = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"), sum((F.size(_all(x, p, 0)) for p in SPELLED), F.lit(0)).alias("n")))
    found = F.slice(F.filter(counts, lambda x: x.n >= 3), 1, 1)
    return F.transform(found, lambda x: _finding("SA-CHARBYCHAR-CONSTRUCT", "evidence", 75, F.concat(x.n.cast("string"), F.lit(" characters are printed one by one on line "), (x["at"] + 1).cast("string")), text.trim(x.line)))


def _blobs(lines: Column) -> Column:
    """Long encoded data outside of checksum arrays."""
    nothing = F.lit(None).cast("string")

    def step(acc: Column, x: Column) -> Column:
        inside = acc.inside | F.rlike(x, _java(SUMS_OPEN))
        free = ~inside & ~F.rlike(x, _java(SUMS_LINE))
        hexadecimal = F.rlike(x, _java(LONG_HEX))
        by_hex = F.coalesce(acc.hex, F.when(free & hexadecimal, text.trim(x)))
        by_64 = F.coalesce(acc.b64, F.when(free & ~hexadecimal & F.rlike(x, _java(LONG_BASE64)), text.trim(x)))
        first = F.coalesce(acc["first"], F.when(by_hex.isNotNull(), "hex").when(by_64.isNotNull(), "b64"))
        return F.struct((inside & ~F.contains(x, F.lit(")"))).alias("inside"), by_hex.alias("hex"), by_64.alias("b64"), first.alias("first"))

    def both(last: Column) -> Column:
        a = F.when(last.hex.isNotNull(), _finding("SA-DATA-BLOB-HEX", "context", 50, "a long hexadecimal string", last.hex))
        b = F.when(last.b64.isNotNull(), _finding("SA-DATA-BLOB-BASE64", "context", 50, "a long base64 string", last.b64))
        return F.array_compact(F.when(last["first"] == "b64", F.array(b, a)).otherwise(F.array(a, b)))

    return F.aggregate(lines, F.struct(F.lit(False).alias("inside"), nothing.alias("hex"), nothing.alias("b64"), nothing.alias("first")), step, both)


def heredocs(lines: Column) -> Column:
    """The bodies of here-documents, each line with its line feed; one that is not ended runs to the last line."""
    empty = F.expr("cast(array() as array<struct<from:int,to:int>>)")
    state = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("word"), F.lit(0).alias("from"), empty.alias("ranges"))

    def step(acc: Column, x: Column) -> Column:
        word = F.nullif(F.regexp_extract(x, to_java(HEREDOC), 1), F.lit(""))
        ends = acc.word.isNotNull() & (text.trim(x) == acc.word)
        closed = F.concat(acc.ranges, F.array(F.struct(acc["from"].alias("from"), acc["at"].alias("to"))))
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(acc.word.isNull(), word).when(~ends, acc.word).alias("word"), F.when(acc.word.isNull(), acc["at"] + 1).otherwise(acc["from"]).alias("from"), F.when(ends, closed).otherwise(acc.ranges).alias("ranges")
        )

    last = F.aggregate(lines, state, step, lambda acc: F.when(acc.word.isNotNull(), F.concat(acc.ranges, F.array(F.struct(acc["from"].alias("from"), acc["at"].alias("to"))))).otherwise(acc.ranges))
    return F.transform(last, lambda r: F.concat(F.array_join(F.slice(lines, r["from"] + 1, r["to"] - r["from"]), "\n"), F.when(r["to"] > r["from"], "\n").otherwise("")))


def _noise(lines: Column) -> Column:
    bodies = F.transform(F.filter(heredocs(lines), lambda b: F.octet_length(b) > HEREDOC_BYTES), lambda b: F.struct(F.octet_length(b).alias("size"), text.byte_entropy(b).alias("bits")))
    found = F.slice(F.filter(bodies, lambda b: b.bits > HEREDOC_BITS), 1, 1)
    return F.transform(found, lambda b: _finding(PAYLOAD, "trigger", 55, F.concat(F.lit("a here-document of "), b["size"].cast("string"), F.lit(" bytes at "), F.format_number(b.bits, 1), F.lit(" bits a byte"))))


def _fetched(content: Column, lines: Column) -> Column:
    low = F.lower(content)
    builds = F.exists(text.constants(BUILDERS), lambda word: F.contains(low, word))
    hit = F.rlike(content, _java(TO_FILE)) & F.rlike(content, _java(EXECUTABLE)) & ~builds
    line = _first(F.filter(lines, lambda x: F.rlike(x, _java(TO_FILE))))
    return F.array_compact(F.array(F.when(hit, _finding("SA-BINARY-DOWNLOAD-NOCOMPILE", "evidence", 60, "fetches a file and makes it executable without building anything", text.trim(line)))))


def analyse(df: DataFrame, content: str, out: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """Adds the column ``out``: an array of findings in the script ``content``, in the analysers' order; empty for null.

    ``prefix`` and ``suffix`` go around ids and descriptions. Comments count like other lines. Of variables in loops or
    branches the last assignment in the text counts.
    """
    c, lines, env = F.coalesce(F.col(content), F.lit("")), F.col("s_lines"), F.col("s_env")
    none = F.expr(f"cast(array() as array<{FINDING}>)")
    # each step runs only on scripts that have what it needs
    own = df.select("*", text.lines(c).alias("s_lines"))
    own = own.select("*", F.when(F.contains(c, F.lit("$")) & F.contains(c, F.lit("=")), environment(assignments(lines))).otherwise(F.expr("cast(map() as map<string,string>)")).alias("s_env"))
    changed = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.when(F.contains(x, F.lit("$")), resolved(x, env)).alias("now"))), lambda x: x.now != x.line)
    own = own.select("*", F.when(F.size(env) > 0, F.transform(changed, lambda x: _judged(x, env))).alias("s_judged"))
    parts = [
        (F.size("s_judged") > 0, _concatenations(F.col("s_judged"))), (F.size(env) > 0, _indirect(c, lines, env)), (F.contains(c, F.lit("$(")), _spelled(lines)), (F.rlike(c, _java(LONG_BASE64)), _blobs(lines)),
        (F.contains(c, F.lit("<<")), _noise(lines)), (F.contains(c, F.lit("chmod")), _fetched(c, lines)),
    ]
    found = F.concat(*[F.when(when, part).otherwise(none) for when, part in parts])
    if prefix or suffix:
        found = F.transform(found, lambda f: F.struct(F.concat(F.lit(prefix), f["id"]).alias("id"), f["category"].alias("category"), f["class"].alias("class"), f["cwe"].alias("cwe"), f["points"].alias("points"), F.concat(f["description"], F.lit(suffix)).alias("description"), f["matched_line"].alias("matched_line")))
    return own.select(*df.columns, found.alias(out))

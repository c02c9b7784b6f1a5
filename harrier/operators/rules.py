"""The rule scan: which rules of the catalogue a text meets, of what class, and on which line.

A text's candidates come from one pass for all literals (``functions.literals``); only their expressions run. All of it is done
inside the row, so a text is never copied: what is exploded are findings without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import allow, text
from ..functions.batches import small_batches
from ..functions.catalogue import EVIDENCE_POINTS, SECTIONS, Rule, cwe, rules
from ..functions.literals import candidates
from ..functions.regex import holds, to_java

FINDING = "struct<id:string,category:string,class:string,cwe:string,points:int,description:string,matched_line:string>"


def rule_candidates(content: Column) -> Column:
    """Numbers (places in ``rules()``) of the rules that may match: a column to make once per text, before the scans of it."""
    return candidates(content, [r.pattern for r in rules()])


def of_rule(rule: Column, field: Callable[[Rule], object]) -> Column:
    """A field (a text, number or truth value) of the rule with a number."""
    values = [field(r) for r in rules()]
    kind = {bool: "boolean", int: "int"}.get(type(values[0]))
    own = F.element_at(text.constants(str(v).lower() if isinstance(v, bool) else str(v) for v in values), rule + 1)
    return own.cast(kind) if kind else own


def _java(rule: Column) -> Column:
    return of_rule(rule, lambda r: to_java(r.pattern))


def hits(content: Column, found: Column, keep: Callable[[Rule], bool], ecosystem: Column | None = None, gates: Mapping[str, Column] | None = None) -> Column:
    """Of the candidates in ``found``, the rules that match the content as a whole: ecosystem-bound ones only where they apply, those of a section only if its gate (if it has one) is open."""
    eco = F.coalesce(ecosystem, F.lit("")) if ecosystem is not None else F.lit("")

    def applies(k: Column) -> Column:
        own, section = of_rule(k, lambda r: r.ecosystem or ""), of_rule(k, lambda r: r.section)
        ok = (own == "") | (eco == "") | (F.lower(text.trim(eco)) == own)
        for name, gate in (gates or {}).items():
            ok = ok & ((section != name) | gate)
        return ok

    return F.filter(found, lambda k: of_rule(k, keep) & applies(k) & holds(content, _java(k)))


def findings(content: Column, found: Column, sections: Iterable[str], hook: Column, ecosystem: Column | None = None, prefixes: Mapping[str, str] | None = None, gates: Mapping[str, Column] | None = None) -> Column:
    """Findings of the rules of some sections in a text, in the catalogue's order; see ``scan``. ``prefixes`` go before the ids of a section."""
    sections, prefixes = set(sections), prefixes or {}
    matched = F.transform(hits(content, found, lambda r: r.section in sections, ecosystem, gates), lambda k: F.struct(k.alias("rule"), _reported(content, k, hook).alias("line")))

    def finding(x: Column) -> Column:
        k = x.rule
        outside = of_rule(k, lambda r: r.hook_only) & ~hook
        return F.struct(
            of_rule(k, lambda r: prefixes.get(r.section, "") + r.id).alias("id"), of_rule(k, lambda r: SECTIONS[r.section]).alias("category"), F.when(~outside & of_rule(k, lambda r: r.evidence), "evidence").otherwise("context").alias("class"),
            of_rule(k, lambda r: cwe(r.id)).alias("cwe"), of_rule(k, lambda r: r.points).alias("points"), of_rule(k, lambda r: r.description).alias("description"), x.line.alias("matched_line"),
        )

    return F.transform(F.filter(matched, lambda x: x.line.isNotNull()), finding)


def _reported(content: Column, k: Column, hook: Column) -> Column:
    """The line that a matching rule reports; null if it has no finding here."""
    weak = of_rule(k, lambda r: r.hook_only and r.points < EVIDENCE_POINTS) & ~hook
    bare = of_rule(k, lambda r: r.recipe_only) & ~hook & ~text.is_recipe(content)
    java = _java(k)
    lines = F.filter(text.lines(content), lambda x: holds(x, java))
    kept = F.filter(lines, lambda x: ~text.is_comment(x) & ~_suppressed(of_rule(k, lambda r: r.id), text.trim(x)))
    return F.when(~weak & ~bare, F.when(F.size(lines) == 0, "").otherwise(text.trim(F.try_element_at(kept, F.lit(1)))))


def _suppressed(rule: Column, line: Column) -> Column:
    """Lines that are known not to mean what their rule looks for."""
    address = F.nullif(F.regexp_extract(line, r"https?://(\d{1,3}(?:\.\d{1,3}){3})", 1), F.lit(""))
    return (
        F.when(rule == "P-RAW-IP-URL", F.coalesce(allow.benign_ipv4(address), F.lit(False)))
        .when(rule == "PHP-SHELL-EXEC-VAR", F.rlike(line, F.lit(to_java(text.PHP_DECLARATION))))
        .when(rule == "PHP-ASSERT-VAR", F.rlike(line, F.lit(to_java(text.PHP_BOOLEAN))))
        .otherwise(False)
    )


def scan(df: DataFrame, keys: list[str], content: str, sections: Iterable[str], hook: Column | bool = False, ecosystem: str | None = None, prefix: str = "") -> DataFrame:
    """Findings of the rules of some sections in a text column, one row each: the keys, seq, id, category, class, cwe, points, description, matched_line.

    ``hook`` says whether the text runs by itself at build or install time. A rule for hooks is context elsewhere, or nothing
    if it has few points; a rule for recipes needs a recipe or a hook. The line is the first that matches and is not a comment
    (nor suppressed for its rule); a rule that only comments match finds nothing, and one that matches across lines has an
    empty line. A null or empty text has no findings.
    """
    small_batches(df.sparkSession)
    in_hook = F.lit(hook) if isinstance(hook, bool) else hook
    base = df.where(F.col(content) != "").select(*keys, F.col(content).alias("s_text"), in_hook.alias("s_hook"), F.col(ecosystem).alias("s_eco") if ecosystem else F.lit("").alias("s_eco"))
    base = base.withColumn("s_found", rule_candidates(F.col("s_text"))).where(F.size("s_found") > 0)
    sections = list(sections)
    each = findings(F.col("s_text"), F.col("s_found"), sections, F.col("s_hook"), F.col("s_eco"), {s: prefix for s in sections})
    return base.select(*keys, F.posexplode(each).alias("seq", "f")).select(*keys, "seq", "f.*")

"""One pass over a text for the literals that the rules need.

A rule's expression runs only on texts that hold a literal it needs. All literals of all rules are looked for at once, by an
Aho-Corasick automaton over Arrow batches, so a text is read once however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .regex import required_literals


@cache
def plan(patterns: tuple[str, ...]) -> tuple[dict[str, list[int]], dict[str, list[int]], list[int]]:
    """Literals and the patterns that need one of them: as they are, in folded case, and the patterns that need none."""
    exact: dict[str, list[int]] = {}
    folded: dict[str, list[int]] = {}
    always: list[int] = []
    for k, pattern in enumerate(patterns):
        needed, fold = required_literals(pattern)
        if not needed or min(map(len, needed)) < 2:
            always.append(k)
            continue
        for literal in needed:
            (folded if fold else exact).setdefault(literal.casefold() if fold else literal, []).append(k)
    return exact, folded, always


def _automaton(literals: dict[str, list[int]]):  # noqa: ANN202
    import ahocorasick

    own = ahocorasick.Automaton()
    for literal, needs in literals.items():
        own.add_word(literal, tuple(needs))
    own.make_automaton()
    return own


def candidates(text: Column, patterns: Iterable[str]) -> Column:
    """Numbers of the RE2 patterns that may match the text, ascending: all that do, and few others. Null and empty texts have none."""
    patterns = tuple(patterns)

    @F.pandas_udf(ArrayType(IntegerType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        exact, folded, always = plan(patterns)
        by_case, by_fold = _automaton(exact), _automaton(folded) if folded else None

        def one(value: str | None) -> list[int]:
            if not value:
                return []
            met: set = {needs for _, needs in by_case.iter(value)} if exact else set()
            if by_fold is not None:
                met |= {needs for _, needs in by_fold.iter(value.casefold())}
            return sorted({*always, *(k for needs in met for k in needs)})

        for batch in batches:
            yield batch.map(one)

    return found(text)

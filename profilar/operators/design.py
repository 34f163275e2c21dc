"""Model terms, as objects rather than formula text.

A design column is a product of factor-level indicators and one numeric column.
Keeping the two parts apart lets every cross product be assembled from moments
grouped by factor cell, however many dummy columns the factors span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 2000


@dataclass(frozen=True)
class Term:
    """Product of factors and numeric atoms."""

    factors: tuple[str, ...] = ()
    atoms: tuple[tuple[str, str], ...] = ()  # (name, SQL expression)

    @property
    def label(self) -> str:
        return ":".join([*[a for a, _ in self.atoms], *self.factors]) or "1"

    def __mul__(self, other: "Term") -> "Term":
        return Term(
            tuple(dict.fromkeys(self.factors + other.factors)),
            tuple(sorted(self.atoms + other.atoms)),
        )


def num(column: str) -> Term:
    return Term(atoms=((column, f"`{column}`"),))


def squared(column: str) -> Term:
    return Term(atoms=((f"{column}^2", f"`{column}` * `{column}`"),))


def logged(column: str) -> Term:
    return Term(atoms=((f"log({column})", f"ln(`{column}`)"),))


def factor(column: str) -> Term:
    return Term(factors=(column,))


def crossed(*terms: Term) -> list[Term]:
    """Main effects and all interactions, lower orders first."""
    out: list[Term] = []
    for order in range(1, len(terms) + 1):
        for mask in product([0, 1], repeat=len(terms)):
            if sum(mask) == order:
                out.append(reduce(lambda a, b: a * b, [t for t, m in zip(terms, mask) if m]))
    unique = list(dict.fromkeys(out))
    return sorted(unique, key=lambda t: len(t.factors) + len(t.atoms))


@dataclass(frozen=True)
class DesignColumn:
    name: str
    levels: tuple[tuple[str, str], ...]  # (factor, level) indicators
    numeric: str | None  # name of the numeric product
    term: str


@dataclass
class Design:
    """Ordered terms with treatment contrasts against the first level of each factor."""

    terms: list[Term] = field(default_factory=list)
    intercept: bool = True
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def without(self, *labels: str) -> "Design":
        return Design([t for t in self.terms if t.label not in labels], self.intercept, self.levels)

    def plus(self, other: "Design") -> "Design":
        terms = list(dict.fromkeys([*self.terms, *other.terms]))
        return Design(terms, self.intercept or other.intercept, {**self.levels, **other.levels})

    @property
    def factors(self) -> list[str]:
        return list(dict.fromkeys(f for t in self.terms for f in t.factors))

    def numerics(self) -> dict[str, str]:
        """Numeric products used, as SQL expressions by name."""
        out = {}
        for t in self.terms:
            if t.atoms:
                out[":".join(n for n, _ in t.atoms)] = " * ".join(f"({e})" for _, e in t.atoms)
        return out

    def columns(self) -> list[DesignColumn]:
        cols = [DesignColumn("(Intercept)", (), None, "1")] if self.intercept else []
        full_used = self.intercept
        for t in self.terms:
            name = ":".join(n for n, _ in t.atoms) or None
            if not t.factors:
                cols.append(DesignColumn(name, (), name, t.label))
                continue
            for f in t.factors:
                if f not in self.levels:
                    raise ValueError(f"levels of factor {f} are not given")
            # Without an intercept the first pure factor keeps all its levels.
            full = not full_used and len(t.factors) == 1 and name is None
            full_used = full_used or full
            pools = [self.levels[f] if full else self.levels[f][1:] for f in t.factors]
            for combo in product(*pools):
                parts = [f"{f}[{v}]" for f, v in zip(t.factors, combo)]
                cols.append(DesignColumn(":".join(([name] if name else []) + parts),
                                         tuple(zip(t.factors, combo)), name, t.label))
        return cols

    def droppable(self) -> list[str]:
        """Terms not contained in a higher-order term."""
        def parts(t: Term) -> set:
            return set(t.factors) | {n for n, _ in t.atoms}

        return [t.label for t in self.terms
                if not any(parts(t) < parts(o) for o in self.terms)]


def level_text(value: object) -> str:
    """A factor level as the text that a cast of its column to string gives."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value and not 1e-3 <= abs(value) < 1e7:
        digits, _, power = f"{Decimal(repr(value)).normalize():E}".partition("E")
        return f"{digits if '.' in digits else digits + '.0'}E{int(power)}"
    return str(value)


def double_text(value: float) -> str:
    """A double literal in SQL text."""
    return f"({float(value)!r}D)"


def quoted_text(value: object) -> str:
    """A string literal in SQL text."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def column_text(col: DesignColumn, numerics: Mapping[str, str]) -> str:
    """A design column as SQL text: one parsed expression costs one call, however many dummies it spans."""
    value = f"CAST(({numerics[col.numeric]}) AS DOUBLE)" if col.numeric else "1D"
    if not col.levels:
        return value
    test = " AND ".join(f"CAST(`{f}` AS STRING) = {quoted_text(level_text(level))}" for f, level in col.levels)
    return f"CASE WHEN {test} THEN {value} ELSE 0D END"


def column_expression(col: DesignColumn, numerics: Mapping[str, str]) -> Column:
    """A design column as a row expression."""
    return F.expr(column_text(col, numerics))


def combination_text(columns: Sequence[DesignColumn], weights: Sequence[float], numerics: Mapping[str, str]) -> str:
    """Weighted sum of design columns as SQL text."""
    parts = [f"{double_text(w)} * {column_text(c, numerics)}" for c, w in zip(columns, weights) if float(w) != 0.0]
    return "(" + " + ".join(parts or ["0D"]) + ")"


def find_levels(df: DataFrame, *factors: str, first: Mapping[str, str] | None = None) -> dict[str, list[str]]:
    """Sorted levels of factors, the reference level in front; an error beyond ``MAX_LEVELS``."""
    out = {}
    for f in factors:
        rows = df.where(F.col(f).isNotNull()).select(F.col(f).cast("string")).distinct().limit(MAX_LEVELS + 1).collect()
        if len(rows) > MAX_LEVELS:
            raise ValueError(f"factor {f} has more than {MAX_LEVELS} levels")
        values = sorted(r[0] for r in rows)
        lead = (first or {}).get(f)
        if lead is not None:
            values = [lead] + [v for v in values if v != lead]
        out[f] = values
    return out

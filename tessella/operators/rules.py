"""Behavioural rules: predicates as Columns, and as SQL text."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.segments import identifier

OPERATORS = {">": ">", "<": "<", ">=": ">=", "<=": "<=", "=": "=", "==": "=", "!=": "!=", "<>": "!=", "in": "IN", "contains": "CONTAINS"}
LOGIC = ("AND", "OR", "NOT")
AGGREGATES = ("SUM", "AVG", "COUNT", "MIN", "MAX")
#: Numbers this near are equal.
NEAR = 1e-10


@dataclass(frozen=True)
class Condition:
    """``field operator value``, the field possibly aggregated over the last days."""

    field: str
    operator: str
    value: float | str | tuple
    aggregate: str | None = None
    window_days: int | None = None

    def __post_init__(self) -> None:
        identifier(self.field)
        if self.operator.lower() not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if self.aggregate and self.aggregate.upper() not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.aggregate!r}")

    @property
    def sign(self) -> str:
        return OPERATORS[self.operator.lower()]

    @property
    def column_name(self) -> str:
        """The column that holds the field's value; an aggregate has one of its own."""
        return "_".join(str(x).lower() for x in (self.aggregate, self.field, self.window_days) if x is not None)

    def column(self) -> Column:
        """Whether the condition holds; a null field, or a text against a number's operator, does not."""
        c, v = F.col(self.column_name), self.value
        if self.sign == "IN":
            out = c.isin(list(v) if isinstance(v, tuple) else [v])
        elif self.sign == "CONTAINS":
            out = c.cast("string").contains(str(v))
        elif isinstance(v, tuple) or isinstance(v, str):
            out = {"=": c == v, "!=": c != v}.get(self.sign, F.lit(False))
        else:
            gap = F.abs(c.cast("double") - float(v))
            out = {">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v, "=": gap < NEAR, "!=": gap >= NEAR}[self.sign]
        return F.coalesce(out, F.lit(False))

    def sql(self) -> str:
        text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(float(x)) if isinstance(x, float) else str(x)
        if self.sign == "IN":
            return f"{self.column_name} IN ({', '.join(map(text, self.value if isinstance(self.value, tuple) else (self.value,)))})"
        if self.sign == "CONTAINS":
            return f"{self.column_name} LIKE {text('%' + str(self.value) + '%')}"
        return f"{self.column_name} {self.sign} {text(self.value)}"


@dataclass(frozen=True)
class Rule:
    """Conditions under AND, OR or NOT (none of them)."""

    name: str
    conditions: tuple[Condition, ...] = ()
    logic: str = "AND"

    def __post_init__(self) -> None:
        if self.logic not in LOGIC:
            raise ValueError(f"unknown logic {self.logic!r}")

    def column(self) -> Column:
        parts = [c.column() for c in self.conditions]
        if self.logic == "AND":
            return reduce(Column.__and__, parts, F.lit(True))
        either = reduce(Column.__or__, parts, F.lit(False))
        return either if self.logic == "OR" else ~either

    def sql(self) -> str:
        if not self.conditions:
            return "1=1"
        if self.logic == "AND":
            return " AND ".join(c.sql() for c in self.conditions)
        either = " OR ".join(c.sql() for c in self.conditions)
        return f"({either})" if self.logic == "OR" else f"NOT ({either})"


@dataclass(frozen=True)
class Segment:
    """All of its rules must hold."""

    name: str
    rules: tuple[Rule, ...] = ()
    priority: int = 0

    def column(self) -> Column:
        return reduce(Column.__and__, [r.column() for r in self.rules], F.lit(True))

    def sql(self) -> str:
        return " AND ".join(f"({r.sql()})" for r in self.rules) if self.rules else "1=1"


@dataclass
class Segmenter:
    """Classifies rows by segments, in the order in which they were added."""

    segments: list[Segment] = field(default_factory=list)

    def add(self, segment: Segment) -> Segmenter:
        self.segments.append(segment)
        return self

    def all_of(self) -> Column:
        """Names of all segments that fit."""
        return F.array_compact(F.array(*[F.when(s.column(), F.lit(s.name)) for s in self.segments])) if self.segments else F.array().cast("array<string>")

    def primary(self) -> Column:
        """The segment of the highest priority that fits; of equals the last added."""
        order = sorted(enumerate(self.segments), key=lambda s: (-s[1].priority, -s[0]))
        out = None
        for _, s in order:
            out = F.when(s.column(), s.name) if out is None else out.when(s.column(), s.name)
        return F.lit(None).cast("string") if out is None else out

    def sql(self, name: str) -> str | None:
        return next((s.sql() for s in self.segments if s.name == name), None)

    def export(self, table: str = "customers") -> str:
        return "\n\n".join(f"-- {s.name}\nSELECT customer_id FROM {identifier(table)} WHERE {s.sql()};" for s in self.segments)

    def prepared(self, events: DataFrame, key: str, as_of: str, ts: str = "ts") -> DataFrame:
        """One row per key with a column for each aggregated condition: a filter on time inside one aggregation."""
        made = {}
        for c in (c for s in self.segments for r in s.rules for c in r.conditions if c.aggregate):
            recent = F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(c.window_days)) if c.window_days is not None else F.lit(True)
            f = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max}[c.aggregate.upper()]
            made[c.column_name] = f(F.when(recent, F.col(c.field))).alias(c.column_name)
        return events.groupBy(key).agg(*made.values())

"""Plans to DataFrames.

The plan is folded bottom up into lazy DataFrame operators and nothing else: a filter
over a cross product stays that, and Catalyst makes joins of it, pushes predicates and
columns into the scans and orders the joins.

Columns carry unique internal names beside their public ones, so repeated names, dots,
case and self joins need no special care. Public names return at the root.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import AmbiguousColumn, PlanError, UnknownColumn
from tidemark.functions.comparison import compare, literal
from tidemark.plans.ir import Col, Cross, Filter, Node, Predicate, Project, Query, Scan, Sort

#: Spark's join hints, for the right side of every cross product.
HINTS = ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl")


@dataclass(frozen=True)
class _Field:
    public: str
    internal: str
    kind: T.DataType


@dataclass(frozen=True)
class _Bound:
    """A DataFrame of internal names, and what they stand for."""

    df: DataFrame
    fields: tuple[_Field, ...]

    def find(self, name: str) -> _Field:
        found = [f for f in self.fields if f.public == name]
        if not found:
            raise UnknownColumn(f"no column {name!r}; there are {', '.join(f.public for f in self.fields)}")
        if len(found) > 1:
            raise AmbiguousColumn(f"{len(found)} columns are named {name!r}")
        return found[0]


class _Compiler:
    def __init__(self, lookup: Callable[[str], DataFrame], hint: str | None, strict_float: bool):
        if hint is not None and hint not in HINTS:
            raise PlanError(f"unknown join hint {hint!r}")
        self.lookup, self.hint, self.strict_float = lookup, hint, strict_float
        self.numbers = count()

    def fresh(self) -> str:
        return f"c{next(self.numbers)}"

    def condition(self, bound: _Bound, p: Predicate) -> Column:
        left = bound.find(p.column)
        if isinstance(p.value, Col):
            other = bound.find(p.value.name)
            right, kind = F.col(other.internal), other.kind
        else:
            right, kind = literal(p.value)
        return compare(F.col(left.internal), left.kind, p.op, right, kind, self.strict_float)

    def fold(self, node: Node) -> _Bound:
        match node:
            case Scan(table):
                df = self.lookup(table)
                fields = tuple(_Field(f.name, self.fresh(), f.dataType) for f in df.schema.fields)
                return _Bound(df.toDF(*[f.internal for f in fields]), fields)
            case Filter(predicates, child):
                bound = self.fold(child)
                if not predicates:
                    return bound
                return _Bound(bound.df.filter(reduce(Column.__and__, [self.condition(bound, p) for p in predicates])), bound.fields)
            case Project(columns, child):
                if not columns:
                    raise PlanError("a projection needs a column")
                bound = self.fold(child)
                taken = [bound.find(source) for source, _ in columns]
                fields = tuple(_Field(to, self.fresh(), f.kind) for f, (_, to) in zip(taken, columns, strict=True))
                return _Bound(bound.df.select(*[F.col(f.internal).alias(g.internal) for f, g in zip(taken, fields, strict=True)]), fields)
            case Cross(left, right):
                a, b = self.fold(left), self.fold(right)
                side = b.df.hint(self.hint) if self.hint else b.df
                return _Bound(a.df.crossJoin(side), a.fields + b.fields)
            case Sort(keys, child):
                bound = self.fold(child)
                if not keys:
                    return bound
                by = [F.col(bound.find(name).internal) for name, _ in keys]
                return _Bound(bound.df.orderBy(*[c.asc() if up else c.desc() for c, (_, up) in zip(by, keys, strict=True)]), bound.fields)
        raise PlanError(f"not a plan node: {node!r}")


def compile_plan(query: Query, lookup: Callable[[str], DataFrame], hint: str | None = None, strict_float: bool = False) -> DataFrame:
    """The lazy result of ``query``; ``lookup`` gives the DataFrame of a table name."""
    bound = _Compiler(lookup, hint, strict_float).fold(query.root)
    return bound.df.toDF(*[f.public for f in bound.fields])

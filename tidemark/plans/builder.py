"""Fluent construction of plans: ``scan("t").filter("c", "<", 5).project(c="d").build()``."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.errors import PlanError
from tidemark.plans.ir import Col, Cross, Filter, Literal, Node, Op, Predicate, Project, Query, Scan, Sort

_SIGNS = {op.value: op for op in Op} | {op.name: op for op in Op} | {"=": Op.EQ, "<>": Op.NE}


def _operand(value: object) -> Literal | Col:
    """Python constants get the widest literal of their kind, integers the narrowest that holds them."""
    if isinstance(value, (Literal, Col)):
        return value
    if isinstance(value, bool):
        raise PlanError("there is no boolean literal")
    if isinstance(value, int):
        return Literal("I32" if -(2**31) <= value < 2**31 else "I64", value)
    if isinstance(value, float):
        return Literal("F64", value)
    if isinstance(value, str):
        return Literal("String", value)
    raise PlanError(f"no literal for {value!r}")


def predicate(column: str, op: str | Op, value: object) -> Predicate:
    sign = op if isinstance(op, Op) else _SIGNS.get(op)
    if sign is None:
        raise PlanError(f"unknown comparison {op!r}")
    return Predicate(column, sign, _operand(value))


@dataclass(frozen=True)
class Rel:
    """A plan under construction; every call returns a new one."""

    node: Node

    def filter(self, column: str, op: str | Op, value: object) -> Rel:
        return self.filter_multiple((column, op, value))

    def filter_multiple(self, *predicates: tuple[str, str | Op, object]) -> Rel:
        return Rel(Filter(tuple(predicate(*p) for p in predicates), self.node))

    def project(self, source: str, name: str | None = None) -> Rel:
        return self.project_multiple((source, name or source))

    def project_multiple(self, *columns: str | tuple[str, str]) -> Rel:
        return Rel(Project(tuple((c, c) if isinstance(c, str) else tuple(c) for c in columns), self.node))

    def cross(self, right: Rel) -> Rel:
        return Rel(Cross(self.node, right.node))

    def sort(self, column: str, ascending: bool = True) -> Rel:
        return self.sort_multiple((column, ascending))

    def sort_multiple(self, *keys: str | tuple[str, bool]) -> Rel:
        return Rel(Sort(tuple((k, True) if isinstance(k, str) else tuple(k) for k in keys), self.node))

    def build(self) -> Query:
        return Query(self.node)


def scan(table: str) -> Rel:
    return Rel(Scan(table))

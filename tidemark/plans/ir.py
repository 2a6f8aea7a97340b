"""Plan nodes and their JSON form.

JSON tags each variant with its name: a scan is ``{"Scan": {"table_id": "t"}}``, a
literal ``{"I32": 5}`` and a column operand ``{"Column": "c"}``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from enum import Enum

from tidemark.errors import PlanError


class Op(Enum):
    EQ = "=="
    NE = "!="
    GT = ">"
    GTE = ">="
    LT = "<"
    LTE = "<="

    @property
    def ordered(self) -> bool:
        return self not in (Op.EQ, Op.NE)


@dataclass(frozen=True)
class Literal:
    """A typed constant; kind is one of I32, I64, F32, F64, String."""

    kind: str
    value: int | float | str


@dataclass(frozen=True)
class Col:
    name: str


def i32(value: int) -> Literal:
    return Literal("I32", value)


def i64(value: int) -> Literal:
    return Literal("I64", value)


def f32(value: float) -> Literal:
    return Literal("F32", value)


def f64(value: float) -> Literal:
    return Literal("F64", value)


def text(value: str) -> Literal:
    return Literal("String", value)


@dataclass(frozen=True)
class Predicate:
    column: str
    op: Op
    value: Literal | Col


@dataclass(frozen=True)
class Scan:
    table: str


@dataclass(frozen=True)
class Filter:
    """Rows for which all predicates hold; without predicates, all rows."""

    predicates: tuple[Predicate, ...]
    child: Node


@dataclass(frozen=True)
class Project:
    """Ordered (from, to) pairs; a column may be renamed, left out or repeated."""

    columns: tuple[tuple[str, str], ...]
    child: Node


@dataclass(frozen=True)
class Cross:
    left: Node
    right: Node


@dataclass(frozen=True)
class Sort:
    """(column, ascending) keys, the first one outermost."""

    keys: tuple[tuple[str, bool], ...]
    child: Node


Node = Scan | Filter | Project | Cross | Sort

_LITERALS = {"I32": int, "I64": int, "F32": float, "F64": float, "String": str}


def _operand_json(v: Literal | Col) -> dict:
    return {"Column": v.name} if isinstance(v, Col) else {v.kind: v.value}


def _node_json(node: Node) -> dict:
    match node:
        case Scan(table):
            return {"Scan": {"table_id": table}}
        case Filter(predicates, child):
            shown = [{"column_name": p.column, "operator": p.op.name, "value": _operand_json(p.value)} for p in predicates]
            return {"Filter": {"predicates": shown, "underlying": _node_json(child)}}
        case Project(columns, child):
            return {"Project": {"column_name_map": [list(c) for c in columns], "underlying": _node_json(child)}}
        case Cross(left, right):
            return {"Cross": {"left": _node_json(left), "right": _node_json(right)}}
        case Sort(keys, child):
            return {"Sort": {"sort_specs": [{"column_name": c, "ascending": a} for c, a in keys], "underlying": _node_json(child)}}
    raise PlanError(f"not a plan node: {node!r}")


def _tagged(obj: object) -> tuple[str, object]:
    if not isinstance(obj, dict) or len(obj) != 1:
        raise PlanError(f"expected an object with one tag, found {obj!r}")
    return next(iter(obj.items()))


def _operand(obj: object) -> Literal | Col:
    tag, value = _tagged(obj)
    if tag == "Column":
        return Col(str(value))
    if tag not in _LITERALS:
        raise PlanError(f"unknown operand {tag!r}")
    return Literal(tag, _LITERALS[tag](value))


def _node(obj: object) -> Node:
    tag, body = _tagged(obj)
    try:
        match tag:
            case "Scan":
                return Scan(body["table_id"])
            case "Filter":
                return Filter(tuple(Predicate(p["column_name"], Op[p["operator"]], _operand(p["value"])) for p in body["predicates"]), _node(body["underlying"]))
            case "Project":
                return Project(tuple((a, b) for a, b in body["column_name_map"]), _node(body["underlying"]))
            case "Cross":
                return Cross(_node(body["left"]), _node(body["right"]))
            case "Sort":
                return Sort(tuple((s["column_name"], bool(s["ascending"])) for s in body["sort_specs"]), _node(body["underlying"]))
    except (KeyError, TypeError) as e:
        raise PlanError(f"malformed {tag}: {e}") from e
    raise PlanError(f"unknown operator {tag!r}")


@dataclass(frozen=True)
class Query:
    root: Node

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps({"root": _node_json(self.root)}, indent=indent)

    @staticmethod
    def from_json(source: str) -> Query:
        obj = json.loads(source)
        if not isinstance(obj, dict) or set(obj) != {"root"}:
            raise PlanError("a query is an object with the one key root")
        return Query(_node(obj["root"]))

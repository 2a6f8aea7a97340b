"""Comparisons between columns and literals of any of the engine's types.

Numbers compare by value whatever their widths. A string and a number are never equal
and always unequal; ordering them is an error when the plan is compiled. A string
against a date or timestamp column is read as that type. Comparisons with null are
null, as in SQL. NaN follows Spark (equal to itself, above all numbers) unless
``strict_float`` is set, which makes it equal to nothing.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import TypeMismatch
from tidemark.plans.ir import Literal, Op

_APPLY = {Op.EQ: operator.eq, Op.NE: operator.ne, Op.GT: operator.gt, Op.GTE: operator.ge, Op.LT: operator.lt, Op.LTE: operator.le}
_KINDS = {"I32": T.IntegerType(), "I64": T.LongType(), "F32": T.FloatType(), "F64": T.DoubleType(), "String": T.StringType()}
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_FLOATS = (T.FloatType, T.DoubleType)


def literal(value: Literal) -> tuple[Column, T.DataType]:
    kind = _KINDS[value.kind]
    return F.lit(value.value).cast(kind), kind


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, _TIMES):
        return "time"
    return kind.simpleString()


def compare(left: Column, left_type: T.DataType, op: Op, right: Column, right_type: T.DataType, strict_float: bool = False) -> Column:
    a, b = _family(left_type), _family(right_type)
    if {a, b} == {"string", "time"}:
        left, right = (left, right.cast(left_type)) if a == "time" else (left.cast(right_type), right)
    elif a != b:
        if op.ordered or {a, b} != {"string", "number"}:
            raise TypeMismatch(f"{left_type.simpleString()} {op.value} {right_type.simpleString()}")
        known = left.isNotNull() & right.isNotNull()
        return F.when(known, F.lit(op is Op.NE))
    elif a not in ("number", "string", "time"):
        raise TypeMismatch(f"columns of type {a} can't be compared")
    result = _APPLY[op](left, right)
    if strict_float and a == "number":
        for side, kind in ((left, left_type), (right, right_type)):
            if isinstance(kind, _FLOATS):
                result = (result | F.isnan(side)) if op is Op.NE else (result & ~F.isnan(side))
    return result

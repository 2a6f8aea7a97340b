"""Logical plans: the five operators, a fluent builder and the JSON form."""

from tidemark.plans.builder import Rel, scan
from tidemark.plans.ir import Col, Cross, Filter, Literal, Op, Predicate, Project, Query, Scan, Sort, f32, f64, i32, i64, text

__all__ = ["Col", "Cross", "Filter", "Literal", "Op", "Predicate", "Project", "Query", "Rel", "Scan", "Sort", "f32", "f64", "i32", "i64", "scan", "text"]

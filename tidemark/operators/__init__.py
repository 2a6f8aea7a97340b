"""Operators over DataFrames: plan compilation and the column profiler."""

from tidemark.operators.compiler import compile_plan
from tidemark.operators.profiler import ProfileConfig, profile, profile_json

__all__ = ["ProfileConfig", "compile_plan", "profile", "profile_json"]

"""Column functions of the engine: typed comparisons."""

from tidemark.functions.comparison import compare

__all__ = ["compare"]

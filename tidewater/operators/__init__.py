"""The engine's operators on DataFrames, for use without SQL text."""

from .joins import count_pairs, natural_join, using_join
from .rows import limit_offset, one_row
from .statistics import grouped

__all__ = ["count_pairs", "grouped", "limit_offset", "natural_join", "one_row", "using_join"]

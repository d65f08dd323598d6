"""The 68 operators, each a builder of expressions."""

from tessera.operators import cross_section, elementwise, group, time_series
from tessera.operators.registry import OPERATORS

__all__ = ["OPERATORS", "cross_section", "elementwise", "group", "time_series"]

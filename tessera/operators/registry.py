"""Operators by name."""

from __future__ import annotations

from collections.abc import Callable

OPERATORS: dict[str, Callable] = {}


def operator(fn: Callable) -> Callable:
    OPERATORS[fn.__name__] = fn
    return fn

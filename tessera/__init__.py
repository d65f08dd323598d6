"""Panel analytics on Spark: formulas over one dense table of dates and symbols."""

from importlib import import_module

#: Where each public name lives; modules are loaded when a name is first used, so workers start light.
_WHERE = {
    "ColumnMismatchError": "plans.errors", "DateMismatchError": "plans.errors", "ExpressionError": "plans.errors", "PanelError": "plans.errors",
    "Expr": "plans.expr", "field": "plans.expr",
    "evaluate": "plans.language", "execute": "plans.language", "field_refs": "plans.language", "parse": "plans.language",
    "Panel": "plans.panel", "compute": "plans.run", "compute_all": "plans.run",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"tessera.{_WHERE[name]}"), name)
    raise AttributeError(name)

"""What can go wrong, by kind."""


class PanelError(Exception):
    """Any error of this library."""


class ExpressionError(PanelError):
    """A formula that the language does not allow, or an unknown name in one."""


class ColumnMismatchError(PanelError):
    """Operands with different symbols."""


class DateMismatchError(PanelError):
    """Operands with different dates."""


class ConfigurationError(PanelError):
    """A client that lacks a table it needs."""


class StorageError(PanelError):
    """A table or key that cannot be read or written."""


class NoSuchKeyError(StorageError):
    """A key that the object store does not hold."""


class SecurityNotFoundError(PanelError):
    """An identifier that resolves to no security."""


class UnknownFieldError(PanelError):
    """A field name that the registry does not hold."""

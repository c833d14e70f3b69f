"""Exceptions raised by the package."""


class SpecError(ValueError):
    """A mart spec that cannot be built: bad joins, duplicate names, unknown tables."""


class NotFound(LookupError):
    """An id, table or column that does not exist."""

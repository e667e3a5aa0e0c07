"""Errors that a caller can tell apart."""


class DumpError(ValueError):
    """The dump, or a request about it, can't be served as asked."""


class RefusedValue(DumpError):
    """A value that the declared type does not accept."""


class AmbiguousTable(DumpError):
    """A name that several tables of the dump have."""


class SourceChanged(DumpError):
    """The bytes are not those that the map was made from."""

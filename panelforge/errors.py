"""Errors raised on the driver."""


class EngineError(Exception):
    """Base of the engine's errors."""


class MissingArtifact(EngineError):
    """A stage's or a source's data isn't there."""


class RowMismatch(EngineError):
    """Keys of two tables that should agree don't."""


class ViewShapeMismatch(EngineError):
    """Vectors of a view differ in length."""


class NotSettled(EngineError):
    """An iteration used up its rounds before its values settled."""


class InvalidValue(EngineError, ValueError):
    """An argument or a column has a value it can't have."""

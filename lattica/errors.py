"""One exception for each way a call can be wrong; all are raised before a job runs unless said otherwise."""


class LatticaError(Exception):
    """Base of all."""


class UninitializedObject(LatticaError):
    """An operand is missing."""


class InvalidValue(LatticaError, ValueError):
    """A value is outside what the call takes."""


class IndexOutOfBounds(LatticaError, IndexError):
    """An index is not within the shape."""


class DimensionMismatch(LatticaError):
    """Shapes do not fit together."""


class DomainMismatch(LatticaError, TypeError):
    """A value type that the operation does not take."""


class OutputNotEmpty(LatticaError):
    """build() on an object that already has entries."""


class NoValue(LatticaError, KeyError):
    """No entry is stored at the index."""


class InsufficientSpace(LatticaError):
    """More entries than the caller allows."""


class InvalidObject(LatticaError):
    """Stored entries break an invariant; found by check(), which runs a job."""

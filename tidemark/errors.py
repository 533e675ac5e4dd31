"""Errors of the engine. All are raised before a new state exists, so a failed call changes nothing."""


class LogError(Exception):
    """Any refusal of the engine."""


class ConstraintError(LogError):
    """A unique key, a reference, a length, a domain or a null would be violated."""


class NotFoundError(LogError):
    """A namespace, topic or subscription that a call names doesn't exist."""


class ConflictError(LogError):
    """Another writer has published the version first."""

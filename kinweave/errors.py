"""Errors and warnings."""


class KinweaveError(Exception):
    """Base of all errors."""


class KinweaveWarning(UserWarning):
    """Base of all warnings."""


class SlowJoinError(KinweaveError):
    """A join would compare every left row with every right row."""


class SlowJoinWarning(KinweaveWarning):
    """As SlowJoinError, if only a warning is wanted."""


class UnsupportedEngineError(KinweaveError):
    """The session lacks what an operator needs."""

"""Errors of the memory log."""


class LogError(Exception):
    """Base of all of them."""


class Held(LogError, RuntimeError):
    """Another session has the lane or lease."""


class Fenced(LogError, RuntimeError):
    """A newer session took over; what was being written is not visible."""


class ChainBroken(LogError, RuntimeError):
    """A position names a lane without a chain up to it."""


class Unreadable(LogError, RuntimeError):
    """An object or payload of the own lane is missing or damaged."""

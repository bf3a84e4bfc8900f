"""Plan-time checks: a wrong algorithm, key or length fails before a job starts."""

from __future__ import annotations


class ParameterError(ValueError):
    """A parameter that no row could make right."""


def require(holds: bool, message: str) -> None:
    if not holds:
        raise ParameterError(message)

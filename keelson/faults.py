"""One-shot faults for tests of recovery."""

from __future__ import annotations

from keelson.errors import InjectedFault

POINTS = ("before_record_append", "before_manifest_save", "after_relocation_write")
_armed: set[str] = set()


def arm(point: str) -> None:
    """The next passage of a point fails."""
    if point not in POINTS:
        raise ValueError(point)
    _armed.add(point)


def hit(point: str) -> None:
    if point in _armed:
        _armed.discard(point)
        raise InjectedFault(point.replace("_", " "))


def clear() -> None:
    _armed.clear()

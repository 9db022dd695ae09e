"""Index versions of a knowledge base: building, active, retired and failed ones, as state transitions of plain rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

RETENTION = timedelta(hours=24)


@dataclass(frozen=True)
class Version:
    number: int
    state: str
    started_at: datetime
    completed_at: datetime | None = None
    retire_after: datetime | None = None
    error: str | None = None


def start(versions: list[Version], now: datetime) -> list[Version]:
    """A new build; one at a time, numbered after all there ever were."""
    if any(v.state == "building" for v in versions):
        raise ValueError("a build is running")
    return [*versions, Version(max((v.number for v in versions), default=0) + 1, "building", now)]


def activate(versions: list[Version], number: int, now: datetime) -> list[Version]:
    """The build becomes active, and what was active retires."""
    if not any(v.number == number and v.state == "building" for v in versions):
        raise ValueError(f"version {number} isn't being built")
    out = []
    for v in versions:
        if v.number == number:
            v = replace(v, state="active", completed_at=now)
        elif v.state == "active":
            v = replace(v, state="retired", retire_after=now + RETENTION)
        out.append(v)
    return out


def fail(versions: list[Version], number: int, error: str, now: datetime) -> list[Version]:
    """The build fails; the active version stays."""
    return [replace(v, state="failed", error=error, completed_at=now) if v.number == number and v.state == "building" else v for v in versions]


def expired(versions: list[Version], now: datetime) -> list[int]:
    return [v.number for v in versions if v.state == "retired" and v.retire_after is not None and v.retire_after < now]


def active(versions: list[Version]) -> int | None:
    return next((v.number for v in versions if v.state == "active"), None)

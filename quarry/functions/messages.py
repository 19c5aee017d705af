"""What a refused caller is told."""

from __future__ import annotations

import math


def wait_seconds(seconds: float | None) -> int:
    """Whole seconds from 1 to 300, 60 where nothing sensible is known."""
    return 60 if seconds is None or not math.isfinite(seconds) or seconds <= 0 else max(1, min(300, math.floor(seconds)))


def counted(n: int, one: str) -> str:
    return f"{n} {one}{'' if n == 1 else 's'}"


def rate_limited(limit: int, window_seconds: int, wait: float | None) -> dict[str, object]:
    return {"error": "rate_limited", "message": f"At most {counted(limit, 'request')} in {counted(window_seconds, 'second')}; try again in {counted(wait_seconds(wait), 'second')}.", "retry_after": wait_seconds(wait)}


def at_capacity(open_sessions: int, most: int) -> dict[str, object]:
    return {"error": "at_capacity", "message": f"All {counted(most, 'session')} are in use ({open_sessions} open).", "retry_after": wait_seconds(None)}

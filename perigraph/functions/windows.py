"""Window clauses as text, for expressions that exist in SQL only."""

from __future__ import annotations


def over(keys: list[str], order: list[str] | str | None = None, frame: str | None = None) -> str:
    """An OVER clause; frame is (preceding, following) text such as '3 preceding and 3 following'."""
    parts = []
    if keys:
        parts.append("partition by " + ", ".join(keys))
    if order:
        parts.append("order by " + (order if isinstance(order, str) else ", ".join(order)))
    if frame:
        parts.append("rows between " + frame)
    return "over (" + " ".join(parts) + ")"

"""Results as short texts: counts first, then rows, within a budget of characters."""

from __future__ import annotations

from datetime import UTC, datetime

from .failures import Failure
from .tools import Result

BUDGET = 12_000


def friendly_time(raw: str, now: datetime | None = None) -> str:
    """A stored timestamp with its age; what isn't one stays as it is."""
    try:
        when = datetime.fromisoformat(raw)
    except ValueError:
        return raw
    when = (when if when.tzinfo else when.replace(tzinfo=UTC)).astimezone(UTC)
    age = ((now or datetime.now(UTC)) - when).total_seconds()
    if age < 60:
        ago = "just now"
    elif age < 3600:
        ago = f"{int(age // 60)}m ago"
    elif age < 86_400:
        ago = f"{int(age // 3600)}h ago"
    elif age < 30 * 86_400:
        ago = f"{int(age // 86_400)}d ago"
    else:
        ago = when.strftime("%d %b %Y")
    return f"{when.strftime('%d %b %Y, %H:%M')} UTC — {ago}"


def cell(value) -> str:
    if value is None:
        return "?"
    if isinstance(value, (list, tuple)):
        return " -> ".join(map(cell, value))
    return str(value)


def render(result: Result | Failure, budget: int = BUDGET) -> str:
    """The text of a result; frames are small, as tools cap them."""
    if isinstance(result, Failure):
        return result.payload()
    lines = [result.text] if result.text else []
    cut = " or more, as the search was cut off" if result.lower_bound else ""
    lines += [f"{name}: {n}{cut}" for name, n in result.counts.items()]
    for name, frame in result.frames.items():
        rows = frame.collect()
        lines.append(f"{name} ({len(rows)}{'+' if result.more and frame is result.rows else ''}):")
        lines += ["  " + "  ".join(f"{cell(v)}" for v in row) for row in rows]
    out, used = [], 0
    for k, line in enumerate(lines):
        if used + len(line) + 1 > budget - 40:
            out.append(f"...and {len(lines) - k} more lines.")
            break
        out.append(line)
        used += len(line) + 1
    return "\n".join(out)

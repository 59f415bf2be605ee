"""Long ranges as full months from summaries plus daily edges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

LEAST_DAYS = 45


@dataclass(frozen=True)
class SummaryWindow:
    """``first`` and ``last`` are first days of the first and last full month."""

    first: date
    last: date
    edges: tuple[tuple[date, date], ...]

    @property
    def months(self) -> list[date]:
        out, at = [], self.first
        while at <= self.last:
            out.append(at)
            at = next_month(at)
        return out


def next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def month_end(day: date) -> date:
    return next_month(day) - timedelta(days=1)


def summary_window(start: date, end: date) -> SummaryWindow | None:
    """None for less than LEAST_DAYS days, or without a full month."""
    if (end - start).days + 1 < LEAST_DAYS:
        return None
    first = start if start.day == 1 else next_month(start)
    last = end.replace(day=1) if end == month_end(end) else (end.replace(day=1) - timedelta(days=1)).replace(day=1)
    if first > last:
        return None
    edges = [(start, first - timedelta(days=1)), (month_end(last) + timedelta(days=1), end)]
    return SummaryWindow(first, last, tuple(x for x in edges if x[0] <= x[1]))

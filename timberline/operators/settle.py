"""Deciding leaders of cascades inside one stretch of time, in order of confidence."""

from __future__ import annotations

from bisect import bisect_left, insort
from decimal import ROUND_HALF_UP, Decimal

LEADS, OPEN, ABSORBED = 0, 1, 2

_NEAR_MICROS = 120 * 1_000_000  # fixed value: no temporal relation beyond this pause


_similarities: dict[tuple[int, int], float] = {}  # by numbers of words; a dict is shipped with the tasks, lru_cache is not


def _similarity(shared: int, union: int) -> float:
    if (shared, union) not in _similarities:
        _similarities[shared, union] = _thousandths(shared / union * 0.3) if union else 0.0
    return _similarities[shared, union]


def _thousandths(x: float) -> float:
    """Half up on the decimal form, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))


class Event:
    """One event: times in microseconds, severity rank, set of words, whether it touches other stretches too."""

    __slots__ = ("name", "start", "end", "rank", "words", "shared")

    def __init__(self, name, start: int, end: int, rank: int, words: frozenset, shared: bool):
        self.name, self.start, self.end, self.rank, self.words, self.shared = name, start, end, rank, words, shared

    def absorbs(self, other: Event, least: float) -> bool:
        gap = max(self.start, other.start) - min(self.end, other.end)
        temporal = 1.0 if gap <= 0 else max(0.0, 1.0 - gap / 1e6 / 120) if gap <= _NEAR_MICROS else 0.0
        step = other.rank - self.rank
        escalation = min(0.5, step * 0.2) if step > 0 else 0.0
        alike = _similarity(len(self.words & other.words), len(self.words | other.words))
        score = temporal * 0.5 + escalation * 0.3 + alike * 0.2
        if abs(score - least) > 0.001:
            return score > least
        return _thousandths(score) >= least


class Timeline:
    """Events by their start; finds one that absorbs another."""

    def __init__(self):
        self.starts: list[tuple[int, int]] = []
        self.events: list[Event] = []
        self.longest = 0

    def add(self, event: Event) -> None:
        insort(self.starts, (event.start, len(self.events)))
        self.events.append(event)
        self.longest = max(self.longest, event.end - event.start)

    def absorbs(self, event: Event, reach: int, least: float) -> bool:
        at = bisect_left(self.starts, (event.start - reach - self.longest, -1))
        while at < len(self.starts) and self.starts[at][0] <= event.end + reach:
            if self.events[self.starts[at][1]].absorbs(event, least):
                return True
            at += 1
        return False


def settle(events: list[Event], reach: int, least: float) -> list[int]:
    """LEADS, ABSORBED or OPEN for each of the events, given in order of confidence.

    An event is absorbed if an earlier leader absorbs it, and leads if no earlier event that may lead does. One that
    touches other stretches may be absorbed there, so it counts as open for those after it even if nothing here absorbs it.
    """
    leaders, undecided, out = Timeline(), Timeline(), []
    for event in events:
        if leaders.absorbs(event, reach, least):
            out.append(ABSORBED)
        elif undecided.absorbs(event, reach, least):
            undecided.add(event)
            out.append(OPEN)
        else:
            (undecided if event.shared else leaders).add(event)
            out.append(LEADS)
    return out

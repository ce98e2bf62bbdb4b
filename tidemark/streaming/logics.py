"""What keyed processors do: firsts after a silence, the latest of a key once it has waited, flags of buyers."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime
from typing import Any

from .keyed import Logic, Timers, Value, Variable


class Firsts(Logic):
    """Rows that are a key's first after ``quiet_ms`` without any, and those that are its first in ``again_ms`` since one was told.

    The first kind reads a variable that lives from its last read or write, the second one that lives from its last write.
    Columns ``keep`` go before the flags.
    """

    def __init__(self, quiet_ms: int, again_ms: int, keep: tuple[str, ...]):
        self.keep = self.needs = keep
        self.variables = (Variable("seen", "at long", quiet_ms, on_read=True), Variable("told", "at long", again_ms))

    def on_row(self, key: tuple, row: Any, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        quiet, again = state["seen"].get(at) is None, state["told"].get(at) is None
        if quiet:
            state["seen"].set(at, at)
        if again:
            state["told"].set(at, at)
        if quiet or again:
            yield (*[getattr(row, c) for c in self.keep], int(quiet), int(again))


class LatestHeld(Logic):
    """The latest version of a key, given ``hold_ms`` after it was first seen; what comes then begins anew.

    ``version`` is a column of numbers; of equal ones the later row counts. Columns ``keep`` must be text; when the row was given, in ms, follows them.
    """

    def __init__(self, hold_ms: int, version: str, keep: tuple[str, ...]):
        self.hold_ms, self.version, self.keep, self.needs = hold_ms, version, keep, (version, *keep)
        self.variables = (Variable("best", "version double, kept array<string>"),)

    def on_row(self, key: tuple, row: Any, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        best, version = state["best"].get(at), float(getattr(row, self.version))
        if best is None:
            timers.at(at + self.hold_ms)
        if best is None or version >= best[0]:
            state["best"].set(at, version, [getattr(row, c) for c in self.keep])
        return ()

    def on_timer(self, key: tuple, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        if (best := state["best"].value) is not None:
            state["best"].clear()
            yield (*best[1], at)


class Buyers(Logic):
    """Every row with whether it is its key's first of the day, and the first ever; columns ``keep``, and with ``timed`` the time in ms and as a
    timestamp, go before the flags."""

    variables = (Variable("day", "day string"),)

    def __init__(self, keep: tuple[str, ...], timed: bool = False):
        self.keep, self.needs, self.timed = keep, keep, timed

    def on_row(self, key: tuple, row: Any, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        last, day = state["day"].get(at), datetime.fromtimestamp(at / 1000, UTC).strftime("%Y-%m-%d")
        if last is None or last[0] != day:
            state["day"].set(at, day)
        when = (at, datetime.fromtimestamp(at / 1000, UTC)) if self.timed else ()
        yield (*[getattr(row, c) for c in self.keep], *when, int(last is None or last[0] != day), int(last is None))

"""Patterns of rows of one key: steps that must follow each other, a time in which the whole must happen, and what was begun and not finished."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .keyed import Logic, Timers, Value, Variable, process


@dataclass(frozen=True)
class Step:
    """Rows for which the boolean column ``when`` holds, ``times`` of them. With ``next`` no other row may stand before them, else
    others are passed over."""

    when: str
    times: int = 1
    next: bool = False


class Pattern(Logic):
    """An automaton over the flattened steps. Its state is the begun matches of a key: when each began and which rows it has taken.

    Every row that the first step holds for begins a match, whatever others are open, as in matching without skipping.
    A match gives its rows' ids when the last step is done; one that is ``within_ms`` old and not done is given as timed out where
    ``timeouts`` asks for it. A row exactly ``within_ms`` after the begin is too late.
    """

    variables = (Variable("begun", "began array<long>, taken array<array<long>>"),)

    def __init__(self, steps: list[Step], within_ms: int, timeouts: bool, identifier: str):
        self.steps = [Step(s.when, 1, s.next) for s in steps for _ in range(s.times)]
        self.within_ms, self.timeouts, self.identifier = within_ms, timeouts, identifier
        self.needs = (identifier, *[s.when for s in self.steps])

    def on_row(self, key: tuple, row: Any, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        held = state["begun"].get(at)
        open_ = list(zip(*held, strict=True)) if held else []
        left = []
        for began, taken in open_:  # the ones that are too old went with their timers
            step = self.steps[len(taken)]
            if getattr(row, step.when):
                taken = [*taken, int(getattr(row, self.identifier))]
                if len(taken) == len(self.steps):
                    yield self._out(key, began, taken, True)
                    continue
            elif step.next:
                continue
            left.append((began, taken))
        if getattr(row, self.steps[0].when):
            taken = [int(getattr(row, self.identifier))]
            if len(self.steps) == 1:
                yield self._out(key, at, taken, True)
            else:
                left.append((at, taken))
                timers.at(at + self.within_ms)
        self._keep(state, left, at)

    def on_timer(self, key: tuple, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        held = state["begun"].value
        open_ = list(zip(*held, strict=True)) if held else []
        for began, taken in open_:
            if began + self.within_ms <= at and self.timeouts:
                yield self._out(key, began, taken, False)
        self._keep(state, [(b, t) for b, t in open_ if b + self.within_ms > at], at)

    def _out(self, key: tuple, began: int, taken: list[int], done: bool) -> tuple:
        return (*key, began, [int(t) for t in taken], done)

    def _keep(self, state: dict[str, Value], left: list[tuple], at: int) -> None:
        if left:
            state["begun"].set(at, [int(b) for b, _ in left], [[int(x) for x in t] for _, t in left])
        elif state["begun"].value is not None:
            state["begun"].clear()


def match(rows: DataFrame, key: str, steps: list[Step], within_ms: int, event_time: str, at: str = "ts", identifier: str = "seq", timeouts: bool = False, late: str = "1 millisecond") -> DataFrame:
    """Matches of a pattern in a stream: key, began (ms), taken (ids of the rows, in order) and done (false: timed out).

    ``at`` is the event time in ms and ``event_time`` the same as a timestamp; rows of equal times are taken by ``identifier``. Steps name boolean columns.
    """
    output = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("began", T.LongType()), T.StructField("taken", T.ArrayType(T.LongType())), T.StructField("done", T.BooleanType())])
    return process(rows, key, [at, identifier], output, Pattern(steps, within_ms, timeouts, identifier), event_time, late)

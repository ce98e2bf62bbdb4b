"""Keyed processors with named state variables that expire, and any number of timers for a key.

Spark keeps the variables and wakes the timers (``transformWithState``), both for a bucket of keys together. What a processor does is a :class:`Logic`: it sees
the rows of a key one by one in event order, with the timers that fall due between them, so its rows do not depend on how the input
is cut into micro-batches, as long as these come in order.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, DataType, DecimalType, FractionalType, IntegralType, StructType


@dataclass(frozen=True)
class Variable:
    """A state variable: its columns, how long a value lives after it was written, and whether reading it counts like writing."""

    name: str
    schema: str
    ttl_ms: int | None = None
    on_read: bool = False


class Value:
    """A variable of the key that is being handled."""

    def __init__(self, variable: Variable, held: Any):
        self.variable, self.held, self.changed = variable, held, False
        self.value, self.touched = (held[:-1], held[-1]) if held is not None else (None, 0)

    def get(self, now: int) -> tuple | None:
        ttl = self.variable.ttl_ms
        if self.value is not None and ttl is not None and now - self.touched >= ttl:
            self.clear()
        if self.value is not None and self.variable.on_read and now > self.touched:
            self.touched, self.changed = now, True
        return self.value

    def set(self, now: int, *value: Any) -> None:
        self.value, self.touched, self.changed = value, now, True

    def clear(self) -> None:
        self.value, self.changed = None, True


class Timers:
    """Times at which :meth:`Logic.on_timer` is asked for the key; they are kept between micro-batches.

    ``reached`` is the time that all rows have come up to, where a timer is due.
    """

    def __init__(self, due: Iterable[int], reached: int = 0):
        self.due, self.reached = set(due), reached

    def at(self, time: int) -> None:
        self.due.add(time)

    def cancel(self, time: int) -> None:
        self.due.discard(time)


class Logic:
    """What happens to the rows and timers of one key; both methods give rows of the output."""

    variables: tuple[Variable, ...] = ()
    #: Columns that it reads, besides the key and those that give the order; None stands for all.
    needs: tuple[str, ...] | None = None
    #: Whether timers fall due between rows; otherwise only the watermark wakes them.
    between_rows = True

    def on_row(self, key: tuple, row: Any, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        return ()

    def on_timer(self, key: tuple, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        return ()


class InOrder(Logic):
    """Holds rows back until the watermark has reached them, then hands them to ``inner`` in order: for inputs, such as joins, whose
    rows come later than their times.

    A key has one timer, for its earliest row; all rows that the watermark has reached by then go on together.
    """

    between_rows = False

    def __init__(self, inner: Logic, columns: list[str], order: list[str]):
        self.inner, self.columns, self.order = inner, columns, order
        self.variables, self.needs = (*inner.variables, Variable("waiting", "rows array<string>, earliest long")), tuple(columns)

    def on_row(self, key: tuple, row: Any, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        rows, earliest = state["waiting"].value or ([], None)
        body = json.dumps([row[c] for c in self.columns])
        if earliest is None or at < earliest:
            if earliest is not None:
                timers.cancel(earliest)
            timers.at(at)
            earliest = at
        state["waiting"].set(at, [*rows, body], earliest)
        return ()

    def on_timer(self, key: tuple, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        rows = [SimpleNamespace(**dict(zip(self.columns, json.loads(b), strict=True))) for b in (state["waiting"].value or ([],))[0]]
        rows.sort(key=lambda r: [getattr(r, c) for c in self.order])
        left, earliest, until = [], None, max(at, timers.reached)
        for r in rows:
            if (time := getattr(r, self.order[0])) <= until:
                yield from self.inner.on_row(key, r, time, state, timers)
            else:
                earliest = time if earliest is None else earliest  # rows are in order
                left.append(json.dumps([getattr(r, c) for c in self.columns]))
        if left:
            state["waiting"].set(at, left, earliest)
            timers.at(earliest)
        else:
            state["waiting"].clear()


class Record(SimpleNamespace):
    """A row of the input; its columns are attributes, or found by their names."""

    def __getitem__(self, column: str) -> Any:
        return self.__dict__[column]


def _reader(kind: DataType) -> Callable[[str], Any]:
    """A value of a type from Spark's text of it; what is no number and no boolean stays text."""
    for types, read in (((IntegralType,), int), ((DecimalType,), Decimal), ((FractionalType,), float), ((BooleanType,), "true".__eq__)):
        if isinstance(kind, types):
            return read
    return str


class _Processor(StatefulProcessor):
    """Runs a logic over the keys of a bucket. What they hold is one value of the store and their timers are one timer, the earliest, since each call
    of the store, of a timer or of this class takes a good part of a millisecond: a bucket pays for it once, whatever the number of its keys."""

    def __init__(self, logic: Logic, keys: list[str], given: StructType, columns: list[str], order: list[str], timed: bool):
        self.logic, self.columns, self.order, self.timed = logic, columns, order, timed
        self.names, self.readers = given.fieldNames(), [_reader(f.dataType) for f in given]
        self.key_at, self.order_at = [self.names.index(k) for k in keys], [self.names.index(c) for c in order]

    def _rows(self, frames: Iterable[pd.DataFrame]) -> Iterator[list]:
        for frame in frames:
            for texts in frame["keyed_row"].tolist():
                yield [None if x is None else read(x) for x, read in zip(texts.tolist(), self.readers, strict=True)]

    def _frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        """The output as it is, without pandas' own guess at types."""
        if out:
            yield pd.DataFrame({c: pd.Series(list(values), dtype=object) for c, values in zip(self.columns, zip(*out, strict=True), strict=True)})

    def init(self, handle) -> None:
        self.handle = handle
        # By key the values of the variables and the due times, as a pickled dict; and the timer that Spark has for the bucket.
        self.store = handle.getValueState("held", "held binary, woken_ms long")

    def _open(self) -> tuple[dict[tuple, tuple], int | None]:
        found = self.store.get()
        return (pickle.loads(found[0]), found[1]) if found is not None else ({}, None)

    def _close(self, held: dict[tuple, tuple], registered: int | None, woken: int | None = None) -> None:
        earliest = min((due[0] for _, due in held.values() if due), default=None)
        if earliest != registered:
            if registered is not None and registered != woken:  # Spark takes out the timer that it has woken
                self.handle.deleteTimer(registered)
            if earliest is not None:
                self.handle.registerTimer(earliest)
        if held:
            self.store.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL), earliest))
        else:
            self.store.clear()

    def _take(self, held: dict[tuple, tuple], key: tuple, reached: int = 0) -> tuple[dict[str, Value], Timers]:
        values, due = held.get(key) or ((None,) * len(self.logic.variables), ())
        return {v.name: Value(v, value) for v, value in zip(self.logic.variables, values, strict=True)}, Timers(due, reached)

    def _keep(self, held: dict[tuple, tuple], key: tuple, state: dict[str, Value], timers: Timers) -> None:
        if self.timed:  # a value that nobody asks for again is removed by a timer of its own
            for v in state.values():
                if v.value is not None and v.variable.ttl_ms is not None and v.changed:
                    timers.at(v.touched + v.variable.ttl_ms)
        values = tuple(None if v.value is None else (*v.value, v.touched) for v in state.values())
        due = tuple(sorted(timers.due)) if self.timed else ()
        if due or any(v is not None for v in values):
            held[key] = (values, due)
        else:
            held.pop(key, None)

    def _fire(self, key: tuple, until: int, state: dict[str, Value], timers: Timers) -> Iterator[tuple]:
        while timers.due and (t := min(timers.due)) <= until:
            timers.cancel(t)
            yield from self.logic.on_timer(key, t, state, timers)
            for v in state.values():
                if v.value is not None and v.variable.ttl_ms is not None and t - v.touched >= v.variable.ttl_ms:
                    v.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, registered = self._open()
        own: dict[tuple, list[list]] = {}
        for row in self._rows(rows):
            own.setdefault(tuple([row[i] for i in self.key_at]), []).append(row)
        out: list[tuple] = []
        for k, several in own.items():
            if len(several) > 1:
                several.sort(key=lambda r: [(r[i] is not None, r[i]) for i in self.order_at])
            state, timers = self._take(held, k)
            for values in several:
                row, at = Record(**dict(zip(self.names, values, strict=True))), values[self.order_at[0]]
                if self.logic.between_rows:
                    out += self._fire(k, at, state, timers)
                out += self.logic.on_row(k, row, at, state, timers)
            self._keep(held, k, state, timers)
        self._close(held, registered)
        return self._frames(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, registered = self._open()
        reached = timerValues.getCurrentWatermarkInMs() - 1  # timers are woken when they lie before the watermark
        ripe = [k for k, (_, due) in held.items() if due and due[0] <= reached]
        out: list[tuple] = []
        for k in ripe:
            state, timers = self._take(held, k, reached)
            out += self._fire(k, reached, state, timers)
            self._keep(held, k, state, timers)
        if ripe:
            self._close(held, registered, expiredTimerInfo.getExpiryTimeInMs())
        return self._frames(out)

    def close(self) -> None:
        pass


#: Buckets that the keys of a stream are dealt to: as many calls for each micro-batch at most, and a task holds what the keys of one of them have.
BUCKETS = 4096


def process(rows: DataFrame, key: str | list[str], order: list[str], output: StructType, logic: Logic, event_time: str | None = None, late: str | None = "1 millisecond", out_time: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Runs ``logic`` over a stream. ``order`` are columns, of which the first is the event time in ms; ``event_time`` is the same time
    as a timestamp, whose watermark is ``late`` behind (rows at or before it are dropped); without ``late`` the stream has its watermark already. ``out_time`` names the output's own event time for further stateful steps.

    Without ``event_time`` no row is late and there are no timers: a value that has expired is then removed when its key is seen again.
    Numbers, booleans and texts of the input are handed to the logic as such, all else as Spark's text of it. ``buckets`` is fixed for the life of a checkpoint; a micro-batch reads and writes what the buckets of its keys hold.
    """
    keys = [key] if isinstance(key, str) else key
    timed = event_time is not None
    marked = rows.withWatermark(event_time, late) if timed and late else rows
    given = StructType([rows.schema[c] for c in (rows.columns if logic.needs is None else dict.fromkeys((*keys, *order, *logic.needs)))])
    # A row goes to Python as one array of texts: each column more would cost as much as all the rest there, and numbers with nulls would come as floats.
    row = F.array(*[F.col(c).cast("string") for c in given.fieldNames()]).alias("keyed_row")
    dealt = marked.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("keyed_bucket"), row, *([event_time] if timed else []))
    processor = _Processor(logic, keys, given, output.fieldNames(), order, timed)
    return dealt.groupBy("keyed_bucket").transformWithStateInPandas(processor, output, "Append", "EventTime" if timed else "None", eventTimeColumnName=out_time or "")

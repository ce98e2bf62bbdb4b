"""Keyed state machines on streams: new-visitor repair, bounces, daily firsts and the latest of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86_400_000


def _day(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%d")


Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]


def machine(rows: DataFrame, key: str, order: tuple[str, ...], output: StructType, state: str, step: Step, forget_ms: int | None = None) -> DataFrame:
    """A state machine for each key: ``step`` gets the new rows in order and the state, None at first, and returns rows and the
    next state.

    A key that hasn't been seen for ``forget_ms`` of processing time is forgotten; by default none is. With it
    the query goes on looking for such keys, so it has no end under an availableNow trigger.
    """

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        own = pd.concat(list(frames), ignore_index=True).sort_values(list(order), kind="stable")  # a key's rows may come in several Arrow batches
        out, after = step(own, held.get if held.exists else None)
        held.update(after)
        if forget_ms:
            held.setTimeoutDuration(forget_ms)
        yield out[output.fieldNames()]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, output, state, "append", timeout)


def _with(schema: StructType, *flags: str) -> StructType:
    return StructType([*schema.fields, *[StructField(f, LongType()) for f in flags]])


def repair_new_visitors(pages: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """The stream form of the batch repair: a visitor's state is the day since when they are known."""

    def step(own: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        since = state[0] if state else _day(own.ts.iloc[0] if own.is_new.iloc[0] == "1" else own.ts.iloc[0] - DAY)
        late = (own.is_new == "1") & (own.ts.map(_day) != since)
        return own.assign(is_new=own.is_new.where(~late, "0")), (since,)

    return machine(pages, "mid", ("ts", "seq"), pages.schema, "since string", step, forget_ms)


def _firsts(own: pd.DataFrame, days: pd.Series, last: str | None) -> tuple[pd.Series, str | None]:
    """Which rows begin another day than the row before, and the last day."""
    return days != days.shift(fill_value=last or ""), (days.iloc[-1] if len(days) else last)


def unique_visitors(pages: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """The first entry page of each visitor on each day. Days that come out of order count again; the batch form sorts first."""

    def step(own: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        first, last = _firsts(own, own.ts.map(_day), state and state[0])
        return own[first], (last,)

    return machine(pages.where("last_page_id IS NULL"), "mid", ("ts", "seq"), pages.schema, "last string", step, forget_ms)


def home_detail_flags(pages: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Rows that are a visitor's first of the day on the home page or on a detail page; a day is kept for each of the two."""

    def step(own: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last, flags = list(state or (None, None)), []
        for i, page in enumerate(("home", "good_detail")):
            there = own[own.page_id == page]
            first, last[i] = _firsts(there, there.ts.map(_day), last[i])
            flags.append(first.reindex(own.index, fill_value=False).astype("int64"))
        out = own.assign(home_uv=flags[0], detail_uv=flags[1])
        return out[(out.home_uv + out.detail_uv) > 0], tuple(last)

    rows = pages.where(F.col("page_id").isin("home", "good_detail"))
    return machine(rows, "mid", ("ts", "seq"), _with(pages.schema, "home_uv", "detail_uv"), "home string, detail string", step, forget_ms)


def logins(pages: DataFrame, away_days: int = 8, forget_ms: int | None = None) -> DataFrame:
    """A user's first login of each day, and whether they come back after ``away_days`` or more."""

    def step(own: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        days = own.ts.map(_day)
        first, last = _firsts(own, days, state and state[0])
        before = pd.to_datetime(days.shift(fill_value=state[0] if state else None))
        away = (pd.to_datetime(days) - before).dt.days >= away_days
        return own.assign(back=away.astype("int64"))[first], (last,)

    rows = pages.where("uid IS NOT NULL AND (last_page_id IS NULL OR last_page_id = 'login')")
    return machine(rows, "uid", ("ts", "seq"), _with(pages.schema, "back"), "last string", step, forget_ms)


def cart_users(carts: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """The first row of each user (user_id, id, at as text) on each day."""

    def step(own: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        first, last = _firsts(own, own["at"].str.split(" ").str[0], state and state[0])
        return own[first], (last,)

    return machine(carts, "user_id", ("at", "id"), carts.schema, "last string", step, forget_ms)


def unique_and_new(rows: DataFrame, user: str, time: str = "ts", order: tuple[str, ...] = ("ts", "seq"), forget_ms: int | None = None) -> DataFrame:
    """Flags on every row of (user, time in ms): the user's first of the day, and the first ever.

    The state is the last day, so days that come out of order count again; the batch form sorts first.
    """

    def step(own: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        first, last = _firsts(own, own[time].map(_day), state and state[0])
        new = [int(state is None and i == 0) for i in range(len(own))]
        return own.assign(unique_user=first.astype("int64"), new_user=new), (last,)

    return machine(rows, user, order, _with(rows.schema, "unique_user", "new_user"), "last string", step, forget_ms)


def bounces(pages: DataFrame, within_seconds: int = 10, watermark: str = "2 seconds", keep: tuple[str, ...] = ()) -> DataFrame:
    """Entry pages of (mid, ts ms, seq, last_page_id, rt) that no other page follows within the time, with the text columns ``keep``.

    A page waits until the watermark is ``within_seconds`` past it; then its successor is known.
    """
    bound, names = within_seconds * 1000, ["ts", "seq", "entry", *keep]
    pages = pages.withWatermark("rt", watermark).select("mid", "ts", "seq", F.col("last_page_id").isNull().alias("entry"), *keep, "rt")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for f in frames:
                waiting += list(zip(*[f[c].tolist() for c in names], strict=True))
        waiting.sort(key=lambda r: r[:2])
        mark, out, done = state.getCurrentWatermarkMs(), [], 0
        for i, (ts, _, entry, *_) in enumerate(waiting):
            if ts + bound > mark:
                break
            following, done = waiting[i + 1 : i + 2], i + 1
            if entry and (not following or following[0][2] or following[0][0] - ts >= bound):
                out.append((key[0], *waiting[i][:2], *waiting[i][3:]))
        if waiting := waiting[done:]:
            state.update(tuple(list(x) for x in zip(*waiting, strict=True)))
            state.setTimeoutTimestamp(max(mark + 1, waiting[0][0] + bound))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["mid", "ts", "seq", *keep]).astype({"ts": "int64", "seq": "int64"})

    kept = "".join(f", {c} string" for c in keep)
    held = "".join(f", {c} array<string>" for c in keep)
    return pages.groupBy("mid").applyInPandasWithState(step, f"mid string, ts long, seq long{kept}", f"ts array<long>, seq array<long>, entry array<boolean>{held}", "append", GroupStateTimeout.EventTimeTimeout)


def daily_firsts(rows: DataFrame, key: str, time: str = "rt", watermark: str = "1 day") -> DataFrame:
    """The first row of a key on each day; days older than the watermark are forgotten, and rows as late are dropped."""
    return rows.withColumn("_day", F.to_date(time)).withWatermark(time, watermark).dropDuplicatesWithinWatermark([key, "_day"]).drop("_day")


def latest_of_key(rows: DataFrame, key: str, version: str, hold_seconds: int = 5) -> DataFrame:
    """The latest version of a key, emitted ``hold_seconds`` of processing time after it was first seen.

    What comes later is held and emitted anew, as an upsert.
    """
    schema = rows.schema
    names = schema.fieldNames()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([held], columns=names)
            return
        first = not state.exists
        held = [] if first else [pd.DataFrame([state.get], columns=names)]
        best = pd.concat([*held, *frames], ignore_index=True).sort_values(version, kind="stable").tail(1)  # of equal versions the later arrival
        state.update(tuple(best[names].itertuples(index=False, name=None))[0])
        if first:
            state.setTimeoutDuration(hold_seconds * 1000)
        yield pd.DataFrame(columns=names)

    return rows.groupBy(key).applyInPandasWithState(step, schema, schema, "append", GroupStateTimeout.ProcessingTimeTimeout)

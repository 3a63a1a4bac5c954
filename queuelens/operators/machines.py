"""State machines as functions of the state in which a slice of rows is entered.

A machine says, for the rows of one slice, which state follows from *any* state before them: ``summarise`` gives a
small description, ``follow`` applies it to a state. So all slices are summarised at once, the summaries of a key are
gone through in order, and then all slices run at once from their true state: two passes, whatever the data.

What makes the descriptions small: a machine soon comes to a row that alone decides what follows (an action, a tripped
breaker, a full bucket). From there the way through the slice is the same for all who come there, so it is found once,
with pointers from each such row to the next, and an entry state only decides where the way is joined.

Rows are given as NumPy arrays in scan order; times are whole microseconds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from typing import Any, Protocol

import numpy as np

State = Any
Columns = Sequence[np.ndarray]


class Machine(Protocol):
    """``fresh`` is the state before the first row of a key. States and summaries can be pickled."""

    fresh: State

    def summarise(self, columns: Columns) -> Any: ...

    def follow(self, summary: Any, state: State) -> State: ...

    def run(self, columns: Columns, state: State) -> list[np.ndarray]: ...


def ends(after: np.ndarray) -> np.ndarray:
    """The last stop on the way from each place; ``after`` points ahead, or to ``len(after)`` where a way ends."""
    n = len(after)
    last, step = np.arange(n + 1), np.append(after, n)
    while (going := step < n).any():
        last = np.where(going, last[np.minimum(step, n)], last)
        step = np.where(going, step[np.minimum(step, n)], step)
    return last[:n]


def way(start: int, after: Sequence[int], n: int) -> list[int]:
    """The stops from ``start`` on."""
    stops = []
    while start < n:
        stops.append(start)
        start = after[start]
    return stops


def _thinned(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a step function without those that change nothing: the last place of each run of equal values."""
    keep = np.ones(len(at), dtype=bool)
    keep[:-1] = value[1:] != value[:-1]
    return at[keep], value[keep]


@dataclass(frozen=True)
class Cooldown:
    """A row acts if none acted in the last ``span``. State: time of the last action, or None.

    The first action of a slice decides all others. It is one of the rows within ``span`` of the first row, so the
    summary is a step function over these: bounded by the slice, and short as ways soon meet.
    """

    span: int
    fresh: State = None

    def summarise(self, columns):
        (t,) = columns
        after = np.searchsorted(t, t + self.span)
        after = np.maximum(after, np.arange(1, len(t) + 1))  # a span of 0: every row
        reach = min(len(t), int(np.searchsorted(t, t[0] + self.span)) + 1)
        return _thinned(t[:reach], t[ends(after)][:reach])

    def follow(self, summary, state):
        at, last = summary
        first = 0 if state is None else int(np.searchsorted(at, state + self.span))
        return state if first == len(at) else int(last[first])

    def run(self, columns, state):
        (t,) = columns
        after = np.maximum(np.searchsorted(t, t + self.span), np.arange(1, len(t) + 1))
        first = 0 if state is None else int(np.searchsorted(t, state + self.span))
        acts = np.zeros(len(t), dtype=bool)
        acts[way(first, after.tolist(), len(t))] = True
        return [acts]


def _first_outside(x: np.ndarray, centre: np.ndarray, band: float) -> np.ndarray:
    """For each row i the first later row whose value is ``band`` or more away from ``centre[i]``; n if there is none."""
    n = len(x)
    highs, lows = [x], [x]
    while (1 << len(highs)) <= n:
        half = 1 << (len(highs) - 1)
        highs.append(np.maximum(highs[-1][:-half], highs[-1][half:]))
        lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
    at = np.arange(1, n + 1)
    for k in range(len(highs) - 1, -1, -1):
        fits = at + (1 << k) <= n
        here = np.minimum(at, len(highs[k]) - 1)
        calm = fits & (np.abs(highs[k][here] - centre) < band) & (np.abs(lows[k][here] - centre) < band)
        at = at + np.where(calm, 1 << k, 0)
    return at


@dataclass(frozen=True)
class Hysteresis:
    """A score less than ``band`` away from the kept one keeps it; scores are held within +-``bound``.

    A state is left at the first record high or low that is ``band`` away from it. The summary holds the records of
    the slice (few, unless scores keep rising) and where the way from each ends.
    """

    band: float
    bound: float = 2.0
    fresh: State = 0.0

    def _kept(self, x):
        return np.clip(x, -self.bound, self.bound)

    def summarise(self, columns):
        x = columns[0].astype(float)
        kept = self._kept(x)
        end = kept[ends(_first_outside(x, kept, self.band))]
        high = np.flatnonzero(np.r_[True, x[1:] > np.maximum.accumulate(x)[:-1]])
        low = np.flatnonzero(np.r_[True, x[1:] < np.minimum.accumulate(x)[:-1]])
        return x[high], high, end[high], x[low], low, end[low]

    def _leaves(self, summary, state):
        high, high_at, high_end, low, low_at, low_end = summary
        i = int(np.searchsorted(high - state, self.band))
        j = int(np.searchsorted(state - low, self.band))
        up = (high_at[i], high_end[i]) if i < len(high) else None
        down = (low_at[j], low_end[j]) if j < len(low) else None
        return min((p for p in (up, down) if p is not None), default=None)

    def follow(self, summary, state):
        found = self._leaves(summary, state)
        return state if found is None else float(found[1])

    def run(self, columns, state):
        x = columns[0].astype(float)
        kept, n = self._kept(x), len(x)
        after = _first_outside(x, kept, self.band)
        away = np.flatnonzero(np.abs(x - state) >= self.band)
        stops = way(int(away[0]) if len(away) else n, after.tolist(), n)
        last = np.zeros(n, dtype=np.int64)
        last[stops] = np.array(stops, dtype=np.int64) + 1
        last = np.maximum.accumulate(last)
        return [np.where(last > 0, kept[last - 1], state)]


class TokenBucket:
    """A request spends one token; tokens come back at ``rate`` a second, up to ``capacity``.

    Instead of a level that every row changes, the state is the time at which the bucket would be full: an allowed
    request puts it one token's time ahead (of now, if that is later), a refused one leaves it. A request is allowed
    if that time is not more than ``slack`` ahead. All times are whole numbers of ``1/unit`` microseconds, so nothing
    is rounded. A slice turns entry states into states by adding a token's time some number of times, or into one
    state where the bucket had filled up: the summary is those stretches of entry states.
    """

    def __init__(self, rate: float, capacity: float):
        cost, room = 1_000_000 / Fraction(str(rate)), Fraction(str(capacity))
        cost = cost.limit_denominator(1_000_000)
        slack = (room - 1) * cost
        self.unit = cost.denominator * room.denominator
        self.cost, self.slack = int(cost * self.unit), int(slack * self.unit)
        self.fresh: State = None

    def _times(self, columns) -> list[int]:
        t = columns[0]
        if self.unit == 1:
            return t.tolist()
        return [v * self.unit for v in t.tolist()]

    def _walk(self, t: list[int], full: int, start: int) -> tuple[int, list[int]]:
        """The state after all rows from ``start`` on, and the allowed ones."""
        n, cost, slack, allowed, i = len(t), self.cost, self.slack, [], start
        while i < n:
            if t[i] < full - slack:
                i = bisect_left(t, full - slack, i + 1)
                continue
            full = max(t[i], full) + cost
            allowed.append(i)
            i += 1
        return full, allowed

    def summarise(self, columns):
        t, cost, slack = self._times(columns), self.cost, self.slack
        if slack < 0:
            return []  # a bucket that holds less than a token allows nothing
        n, j = len(t), 0
        # (above, upto, shift, fixed): entry states in (above, upto] are at state + shift, or all at ``fixed``
        parts = [(None, t[0], None, t[0]), (t[0], t[0] + slack + cost, 0, None)]
        while j < n:
            least = min(f if f is not None else a + s + 1 for a, _, s, f in parts)
            j = bisect_left(t, least - slack, j)
            if j == n:
                break
            now, made = t[j], []
            for above, upto, shift, fixed in parts:
                if fixed is not None:
                    made.append((above, upto, None, max(now, fixed) + cost if fixed <= now + slack else fixed))
                    continue
                idle, open_ = min(upto, now - shift), min(upto, now + slack - shift)
                at = above
                if idle > at:
                    made.append((at, idle, None, now + cost))
                    at = idle
                if open_ > at:
                    made.append((at, open_, shift + cost, None))
                    at = open_
                if upto > at:
                    made.append((at, upto, shift, None))
            parts = made[:1]
            for part in made[1:]:
                before = parts[-1]
                if before[2:] == part[2:]:
                    parts[-1] = (before[0], part[1], *part[2:])
                else:
                    parts.append(part)
            j += 1
            if len(parts) == 1 and parts[0][3] is not None:  # one state is left: the rest is a single way
                full, _ = self._walk(t, parts[0][3], j)
                parts = [(None, parts[0][1], None, full)]
                break
        return [(upto, shift, fixed) for _, upto, shift, fixed in parts]

    def follow(self, summary, state):
        if not summary:
            return state
        if state is None:
            state = summary[0][0]  # a full bucket: like any state up to the first row
        for upto, shift, fixed in summary:
            if state <= upto:
                return fixed if fixed is not None else state + shift
        return state

    def run(self, columns, state):
        t = self._times(columns)
        allowed = np.zeros(len(t), dtype=bool)
        if self.slack >= 0:
            allowed[self._walk(t, t[0] if state is None else state, 0)[1]] = True
        return [allowed]


CLOSED, HALF_OPEN, OPEN = "closed", "half_open", "open"


def _spread(n: int, marks: list[tuple[int, str]], first: str) -> np.ndarray:
    """The state at each row from the rows at which it changes."""
    out, at, mode = np.empty(n, dtype=object), 0, first
    for row, new in marks:
        out[at:row] = mode
        at, mode = row, new
    out[at:] = mode
    return out


def _next_true(flags: np.ndarray) -> np.ndarray:
    """For each place (and the end) the first true one at or after it; n if there is none."""
    n = len(flags)
    at = np.where(flags, np.arange(n), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], n)


class StreakBreaker:
    """Opens for ``open_us`` after ``trip`` failures in a row; half open after that, ``successes`` close it.

    State: (mode, failures in a row, successes counted, time the breaker stays open until). The rows that open the
    breaker are the stops of a way: what follows one of them does not depend on anything before.
    """

    def __init__(self, trip: int = 5, open_us: int = 30_000_000, successes: int = 3):
        self.trip, self.open_us, self.successes = max(1, trip), open_us, max(1, successes)
        self.fresh: State = (CLOSED, 0, 0, 0)

    def _prepare(self, columns):
        t, ok = columns[0], columns[1].astype(bool)
        n = len(t)
        place = np.arange(n)
        last_ok = np.maximum.accumulate(np.where(ok, place, -1))
        run = place - last_ok  # failures in a row up to this row, 0 at a success
        self_opens = _next_true(run >= self.trip)
        oks = np.flatnonzero(ok)
        before = np.concatenate([[0], np.cumsum(ok)])
        return t, ok, n, run, self_opens, oks, before, _next_true(ok)

    def _closing(self, p, k, until, good=0):
        """The row that closes a breaker half open at row k: enough successes, and past its time."""
        t, _, n, _, _, oks, before, next_ok = p
        count = before[k] + max(1, self.successes - good) - 1
        by_count = np.where(count < len(oks), oks[np.minimum(count, max(0, len(oks) - 1))] if len(oks) else n, n)
        return np.maximum(by_count, next_ok[np.searchsorted(t, until, side="right")])

    def _from_half(self, p, k, until, good=0):
        """(row, True if it opens there, False if it closes) for a breaker half open at rows k without failures before."""
        _, _, n, _, opens, *_ = p
        shut, trip = self._closing(p, k, until, good), opens[k]
        return np.minimum(shut, trip), (trip < shut)

    def _ways(self, p):
        """For each row, if the breaker opened there: the row that opens it next (n: none in this slice)."""
        t, ok, n, _, opens, *_ = p
        until = t + self.open_us
        k = np.maximum(np.searchsorted(t, until), np.arange(1, n + 1))
        inside = np.minimum(k, n - 1)
        row, trips = self._from_half(p, inside, until)
        after = np.where(trips, row, opens[np.minimum(row + 1, n)])
        after = np.where(row == n, n, after)
        after = np.where(ok[inside], after, inside)  # a failure as the first try opens it again
        return np.where(k >= n, n, np.maximum(after, np.arange(1, n + 1)))

    def _tail(self, p, mode, start, until, fails, good):
        """The state at the end, from ``mode`` just before row ``start`` with no further opening."""
        t, ok, n, run, *_ = p
        if mode == OPEN:
            k = max(start, int(np.searchsorted(t, until)))
            if k >= n:
                return (OPEN, self.trip, 0, until)
            start, mode, fails, good = k, HALF_OPEN, self.trip, 0
        row = n
        if mode == HALF_OPEN:
            row = int(self._closing(p, start, until, good))
            if row >= n:
                seen = int(ok[start:].sum())
                streak = int(run[-1]) if seen else fails + n - start
                return (HALF_OPEN, min(self.trip, streak), min(self.successes, good + seen), until)
            start, fails = row + 1, 0
        if start >= n:
            return (CLOSED, fails, 0, 0)
        streak = int(run[-1]) if ok[start:].any() else fails + n - start
        return (CLOSED, streak, 0, 0)

    def _joins(self, p, state):
        """The first row that opens the breaker in this slice (n: none) from an entry state."""
        t, ok, n, run, opens, *_ = p
        mode, fails, good, until = state
        start = 0
        if mode == OPEN:
            start = int(np.searchsorted(t, until))
            if start >= n:
                return n
            fails, good, mode = self.trip, 0, HALF_OPEN
        lead = int(_leading_failures(ok, start))
        needed = max(1, self.trip - fails)
        if lead >= needed:
            return start + needed - 1
        if mode == CLOSED:
            return int(opens[start])
        row, trips = self._from_half(p, np.array([start + 0]), np.array([until]), good)
        if row[0] >= n:
            return n
        return int(row[0]) if trips[0] else int(opens[min(int(row[0]) + 1, n)])

    def summarise(self, columns):
        p = self._prepare(columns)
        t, ok, n = p[0], p[1], p[2]
        last = ends(self._ways(p))

        def exit_of(state):
            row = self._joins(p, state)
            if row >= n:
                return self._tail(p, state[0], 0, state[3], state[1], state[2])
            end = int(last[row])
            return self._tail(p, OPEN, end + 1, int(t[end]) + self.open_us, self.trip, 0)

        closed = [exit_of((CLOSED, f, 0, 0)) for f in range(self.trip)]
        # a half open breaker's time lies at or before the first row: whether it equals it, matters for closing
        half = {(f, g, late): exit_of((HALF_OPEN, f, g, int(t[0]) - (1 if late else 0)))
                for f in range(self.trip + 1) for g in range(self.successes + 1) for late in (True, False)}
        reach = int(np.searchsorted(t, t[0] + self.open_us, side="right")) + 1
        # an open one joins at the first row at or after its time; rows of one instant are one step, and so is the gap before
        # them unless the time equals the instant, which delays the closing
        at = np.unique(t[:reach])
        steps = []
        for when in at.tolist():
            steps.append((when - 1, _timeless(exit_of((OPEN, self.trip, 0, when - 1)), when - 1)))
            steps.append((when, _timeless(exit_of((OPEN, self.trip, 0, when)), when)))
        thin = [s for i, s in enumerate(steps) if i + 1 == len(steps) or steps[i + 1][1] != s[1]]
        return closed, half, int(t[0]), [s[0] for s in thin], [s[1] for s in thin]

    def follow(self, summary, state):
        closed, half, first, upto, exits = summary
        mode, fails, good, until = state
        if mode == CLOSED:
            return closed[min(fails, self.trip - 1)]
        if mode == HALF_OPEN:
            out = half[(min(fails, self.trip), min(good, self.successes), until < first)]
            return (*out[:3], until) if out[0] == HALF_OPEN and out[3] in (first, first - 1) else out
        i = bisect_left(upto, until)
        if i == len(upto):
            return state
        out = exits[i]
        return (*out[:3], until) if out[3] is None else out

    def run(self, columns, state):
        p = self._prepare(columns)
        t, ok, n = p[0], p[1], p[2]
        after = self._ways(p).tolist()
        stops = way(self._joins(p, state), after, n)
        marks: list[tuple[int, str]] = []
        allowed = np.ones(n, dtype=bool)

        def half_then(until: int, start: int, good: int, stop: int) -> None:
            row = int(self._closing(p, start, until, good))
            if row < stop:
                marks.append((row, CLOSED))

        def opened(until: int, start: int, stop: int) -> None:
            k = max(start, int(np.searchsorted(t, until)))
            allowed[start:k] = False
            if k < n:
                marks.append((k, HALF_OPEN))
                half_then(until, k, 0, stop)

        mode, _, good, until = state
        stop = stops[0] if stops else n
        if mode == OPEN:
            opened(until, 0, stop)
        elif mode == HALF_OPEN:
            half_then(until, 0, good, stop)
        for i, row in enumerate(stops):
            marks.append((row, OPEN if self.open_us > 0 else HALF_OPEN))
            opened(int(t[row]) + self.open_us, row + 1, stops[i + 1] if i + 1 < len(stops) else n)
        return [_spread(n, sorted(marks, key=lambda m: m[0]), mode), allowed]


def _leading_failures(ok: np.ndarray, start: int) -> int:
    rest = ok[start:]
    return int(rest.argmax()) if rest.any() else len(rest)


def _timeless(state, until):
    """A state that still carries the entry's own time, without it."""
    return (*state[:3], None) if state[3] == until and state[0] != CLOSED else state


class ShareBreaker:
    """Opens on ``threshold`` failures of the window with a share above ``share``; ``recover`` successes close it.

    The failures and successes of the trailing window come with each row. State: (mode, time of the opening). An open
    breaker closes at the first row with enough successes, whenever it opened, so few states come out of a slice.
    """

    fresh: State = (CLOSED, 0)

    def __init__(self, threshold: int, window_us: int, share: float = 0.7, recover: int = 10):
        self.threshold, self.window_us, self.share, self.recover = threshold, window_us, share, recover

    def _turns(self, columns):
        t, ok, fails, oks = columns[0], columns[1].astype(bool), columns[2], columns[3]
        trips = ~ok & (fails >= self.threshold) & (fails / np.maximum(1, fails + oks) > self.share)
        return t, len(t), _next_true(trips), _next_true(ok & (oks >= self.recover))

    def _walk(self, turns, state):
        t, n, trips, heals = turns
        mode, changed = state
        marks, at = [], 0
        while at < n:
            if mode == CLOSED:
                row = int(trips[at])
                if row == n:
                    break
                mode, changed, at = OPEN, int(t[row]), row + 1
                marks.append((row, OPEN))
            else:
                row = int(heals[at])
                if mode == OPEN:
                    late = int(np.searchsorted(t, changed + self.window_us, side="right"))
                    if max(late, at) <= min(row, n - 1):
                        marks.append((max(late, at), HALF_OPEN))
                        mode = HALF_OPEN
                if row == n:
                    break
                mode, changed, at = CLOSED, 0, row + 1
                marks.append((row, CLOSED))
        return (mode, changed if mode == OPEN else 0), marks

    def summarise(self, columns):
        turns = self._turns(columns)
        heals = int(turns[3][0]) < turns[1]
        half = self._walk(turns, (HALF_OPEN, 0))[0]
        return self._walk(turns, (CLOSED, 0))[0], half, heals, int(turns[0][-1])

    def follow(self, summary, state):
        closed, half, heals, last = summary
        if state[0] == CLOSED:
            return closed
        if state[0] == HALF_OPEN or heals or last > state[1] + self.window_us:
            return half
        return state

    def run(self, columns, state):
        turns = self._turns(columns)
        _, marks = self._walk(turns, state)
        t, n = turns[0], turns[1]
        modes = _spread(n, marks, state[0])
        # a row that closes the breaker was let through only if its time had passed before
        allowed = modes != OPEN
        mode, changed = state
        for row, new in marks:
            if new == OPEN:
                allowed[row] = True
                changed = int(t[row])
            elif new == CLOSED and mode == OPEN:
                allowed[row] = t[row] - changed > self.window_us
            mode = new
        return [modes, allowed]


class WindowBreaker:
    """Opens when ``threshold`` failures fall within ``window_us``; half open after that, one success closes it.

    State: (mode, time of the opening, failures since the last closing that may still count). A row that closes the
    breaker decides what follows, and a closed one opens at the first row whose ``threshold``-th last failure is
    recent and younger than the closing.
    """

    fresh: State = (CLOSED, 0, ())

    def __init__(self, threshold: int, window_us: int):
        self.threshold, self.window_us = max(1, threshold), window_us

    def _prepare(self, columns):
        t, ok = columns[0], columns[1].astype(bool)
        n = len(t)
        failures = np.flatnonzero(~ok)
        nth = np.full(len(failures), -1)
        back = self.threshold - 1
        if len(failures) > back:
            nth[back:] = failures[:len(failures) - back]
        recent = (nth >= 0) & (t[np.maximum(nth, 0)] >= t[failures] - self.window_us)
        trips, since = failures[recent], nth[recent]  # a trip row, and the failure that starts its streak
        next_ok = _next_true(ok)
        return t, ok, n, failures, trips, since, next_ok

    def _opens_after(self, p, closed_at):
        """The row that opens a breaker closed at rows ``closed_at``; n if there is none."""
        _, _, n, _, trips, since, _ = p
        i = np.searchsorted(since, closed_at, side="right")
        return np.append(trips, n)[i]

    def _closes_after(self, p, opened_us):
        """(first half open row, row that closes) of a breaker opened at the given times."""
        t, next_ok = p[0], p[6]
        k = np.searchsorted(t, opened_us + self.window_us, side="right")
        return k, next_ok[k]

    def _ways(self, p):
        t, n = p[0], p[2]
        _, shut = self._closes_after(p, t)
        return np.where(shut < n, self._opens_after(p, shut), n)

    def _joins(self, p, state):
        """The first row at which an entry state opens the breaker."""
        t, ok, n, failures, trips, _, next_ok = p
        mode, changed, old = state
        if mode != CLOSED:
            shut = int(next_ok[0]) if mode == HALF_OPEN else int(self._closes_after(p, changed)[1])
            return int(self._opens_after(p, np.array([shut]))[0]) if shut < n else n
        found = int(trips[0]) if len(trips) else n
        for m in range(1, min(self.threshold - 1, len(failures)) + 1):  # streaks begun before this slice
            if self.threshold - m <= len(old) and old[-(self.threshold - m)] >= t[failures[m - 1]] - self.window_us:
                return min(found, int(failures[m - 1]))
        return found

    def _recent(self, p, old, since):
        """Times of failures that may still count: the last ones after row ``since``, and older ones if there are too few."""
        t, failures = p[0], p[3]
        mine = t[failures[failures > since]].tolist()
        kept = ([*old, *mine] if since < 0 else mine)[-(self.threshold - 1):] if self.threshold > 1 else []
        return tuple(v for v in kept if v >= int(t[-1]) - self.window_us)

    def _tail(self, p, state, row):
        """The state at the end if the last opening in this slice is at ``row`` (n: none)."""
        t, n, next_ok = p[0], p[2], p[6]
        mode, changed, old = state
        if row < n:
            mode, changed = OPEN, int(t[row])
        if mode == OPEN:
            k, shut = (int(v) for v in self._closes_after(p, changed))
            if k >= n:
                return (OPEN, changed, ())
            mode = HALF_OPEN
        elif mode == HALF_OPEN:
            shut = int(next_ok[0])
        else:
            return (CLOSED, 0, self._recent(p, old, -1))
        return (HALF_OPEN, 0, ()) if shut >= n else (CLOSED, 0, self._recent(p, (), shut))

    def _exit(self, p, last, state):
        row = self._joins(p, state)
        return self._tail(p, state, int(last[row]) if row < p[2] else row)

    def summarise(self, columns):
        p = self._prepare(columns)
        t, n, failures, trips, next_ok = p[0], p[2], p[3], p[4], p[6]
        last = ends(self._ways(p))
        first = [int(f) for f in failures[:self.threshold - 1]]
        from_row = {row: self._tail(p, self.fresh, int(last[row])) for row in {*first, *trips[:1].tolist()}}
        reach = int(np.searchsorted(t, t[0] + self.window_us, side="right")) + 1
        joins = np.unique(t[:reach])
        steps = []  # an open one: by the first row after its time
        for when in joins.tolist():
            steps.append((when, self._exit(p, last, (OPEN, when - self.window_us - 1, ()))))
        thin = [s for i, s in enumerate(steps) if i + 1 == len(steps) or steps[i + 1][1] != s[1]]
        kept = (t[failures][-(self.threshold - 1):].tolist() if self.threshold > 1 else [])
        return {"half": self._exit(p, last, (HALF_OPEN, 0, ())), "first": [(f, int(t[f])) for f in first], "trip": int(trips[0]) if len(trips) else n,
                "from": from_row, "n": n, "end": int(t[-1]), "kept": kept, "upto": [s[0] for s in thin], "exits": [s[1] for s in thin]}

    def follow(self, summary, state):
        mode, changed, old = state
        if mode == HALF_OPEN:
            return summary["half"]
        if mode == OPEN:
            # half open from the first row later than changed + window on
            i = bisect_left(summary["upto"], changed + self.window_us + 1)
            return state if i == len(summary["upto"]) else summary["exits"][i]
        row = summary["trip"]
        for m, (at, when) in enumerate(summary["first"], 1):
            if self.threshold - m <= len(old) and old[-(self.threshold - m)] >= when - self.window_us:
                row = min(row, at)
                break
        if row < summary["n"]:
            return summary["from"][row]
        kept = [*old, *summary["kept"]][-(self.threshold - 1):] if self.threshold > 1 else []
        return (CLOSED, 0, tuple(v for v in kept if v >= summary["end"] - self.window_us))

    def run(self, columns, state):
        p = self._prepare(columns)
        t, n, next_ok = p[0], p[2], p[6]
        stops = way(self._joins(p, state), self._ways(p).tolist(), n)
        marks: list[tuple[int, str]] = []
        allowed = np.ones(n, dtype=bool)

        def opened(changed: int, start: int) -> None:
            k, shut = (int(v) for v in self._closes_after(p, changed))
            allowed[start:k] = False
            if k < n:
                marks.append((k, HALF_OPEN))
                if shut < n:
                    marks.append((shut, CLOSED))

        mode, changed, _ = state
        if mode == OPEN:
            opened(changed, 0)
        elif mode == HALF_OPEN and int(next_ok[0]) < n:
            marks.append((int(next_ok[0]), CLOSED))
        for row in stops:
            marks.append((row, OPEN))
            opened(int(t[row]), row + 1)
        return [_spread(n, sorted(marks, key=lambda m: m[0]), mode), allowed]

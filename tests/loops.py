"""The state machines as plain loops, one row at a time: what the sliced scans must equal.

Each maker returns a step (state, row) -> (state, outputs) and the state before the first row.
"""

from __future__ import annotations

from fractions import Fraction


def cooldown_step(span):
    def step(state, row):
        now, last = row[0], state[0]
        act = last is None or now - last >= span
        return [now if act else last], (act,)
    return step, [None]


def hysteresis_step(band):
    def step(state, row):
        kept = state[0] if abs(row[0] - state[0]) < band else row[0]
        kept = max(min(kept, 2.0), -2.0)
        return [kept], (kept,)
    return step, [0.0]


def bucket_step(rate, capacity):
    """In fractions, so that no level is rounded."""
    a_microsecond, room = Fraction(str(rate)) / 1_000_000, Fraction(str(capacity))

    def step(state, row):
        now, (tokens, last) = row[0], state
        if last is not None:
            tokens = min(room, tokens + (now - last) * a_microsecond)
        ok = tokens >= 1
        return [tokens - 1 if ok else tokens, now], (ok,)
    return step, [room, None]


def window_breaker_step(threshold: int, window_us: int):
    """Closed until ``threshold`` failures fall in the window; half open after it."""
    def step(state, row):
        now, ok = row
        mode, changed, fails = state
        if mode == "open" and now - changed > window_us:
            mode, changed = "half_open", None
        if mode == "open":
            return [mode, changed, fails], (mode, False)
        fails = [t for t in fails if t >= now - window_us][1 - threshold:] if threshold > 1 else []
        if ok:
            if mode == "half_open":
                mode, fails = "closed", []
        else:
            fails = fails + [now]
            if len(fails) >= threshold and mode == "closed":
                mode, changed = "open", now
        return [mode, changed, fails], (mode, True)
    return step, ["closed", None, []]


def share_breaker_step(threshold: int, window_us: int, share: float = 0.7, recover: int = 10):
    """Opens on many failures with a high share; enough successes close it.

    The failures and successes of the trailing window come with the row.
    """
    def step(state, row):
        now, ok, fails, oks = row
        mode, changed = state
        if mode == "open" and now - changed > window_us:
            mode, changed = "half_open", None
        allowed = mode != "open"
        if ok:
            if mode in ("open", "half_open") and oks >= recover:
                mode, changed = "closed", None
        elif fails >= threshold and fails / max(1, fails + oks) > share and mode == "closed":
            mode, changed = "open", now
        return [mode, changed], (mode, allowed)
    return step, ["closed", None]


def streak_breaker_step(trip: int = 5, open_us: int = 30_000_000, successes: int = 3):
    """Opens after failures in a row for a fixed time; successes then close it."""
    def step(state, row):
        now, ok = row
        fails, until, good = state
        if until and now < until:
            return state, ("open", False)
        if ok:
            fails, good = 0, good + 1
            if until and now > until and good >= successes:
                until, good = 0, 0
        else:
            fails += 1
            if fails >= trip:
                until, good = now + open_us, 0
        if not until:
            good = 0  # counts only towards closing
        mode = "open" if until and now < until else "half_open" if until else "closed"
        return [fails, until, good], (mode, True)
    return step, [0, 0, 0]

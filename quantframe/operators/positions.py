"""Positions of the spread backtest, block by block.

The position at a bar depends on all bars before it, but a block of bars acts on the state that
enters it as a small map: flat leads to one end state, a held position leads to an end state chosen
by the bar that closes it. ``block_maps`` computes these maps for all blocks at once, ``entering``
chains them over the few rows per series that they are, and ``mark_bars`` replays all blocks at once
from their true entering state.

A state is one long: 0 is flat, ``+(i + 1)`` long since row i, ``-(i + 1)`` short since row i.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd

REVERSION, STOP, MAX_HOLD, END_OF_DATA = 1, 2, 3, 4
EXIT_REASONS = {REVERSION: "reversion", STOP: "stop", MAX_HOLD: "max_hold", END_OF_DATA: "end_of_data"}

MAP_COLUMNS = ("first_index", "flat_to", "long_exit", "long_to", "short_exit", "short_to",
               "live_at", "live_to", "max_hold")
MAP_SCHEMA = ("first_index long, flat_to long, long_exit long, long_to long, short_exit long, "
              "short_to long, live_at array<long>, live_to array<long>, max_hold long")
MARK_SCHEMA = "held int, opened boolean, entry_index long, exit_code int"


def _next_at_or_after(mask: np.ndarray) -> np.ndarray:
    """For every position, and one past the end, the first true position from there; len if none."""
    n = len(mask)
    spots = np.append(np.where(mask, np.arange(n), n), n)
    return np.minimum.accumulate(spots[::-1])[::-1]


class _Block:
    """Look-ups over the consecutive bars of one block."""

    def __init__(self, bars: pd.DataFrame):
        self.n = len(bars)
        self.first = int(bars["row_index"].iloc[0])
        hold = bars["max_hold"].iloc[0]
        self.max_hold = None if pd.isna(hold) else int(hold)
        entry = bars["entry"].to_numpy()
        self.code = {1: bars["exit_long"].to_numpy(), -1: bars["exit_short"].to_numpy()}
        self.entries = np.flatnonzero(entry)
        self.sides = entry[self.entries]
        self.live = _next_at_or_after(bars["live"].to_numpy().astype(bool))
        self.closing = {side: _next_at_or_after(code > 0) for side, code in self.code.items()}

    def entry_after(self, position: int) -> int:
        """Number of the first entry bar later than ``position``."""
        return int(np.searchsorted(self.entries, position, side="right"))

    def exit_of(self, side: int, entry_index: int, start: int) -> int:
        """Position of the bar that closes the trade, looking from ``start``; ``n`` if none does."""
        found = int(self.closing[side][start])
        if self.max_hold is not None:
            due = min(max(entry_index + self.max_hold - self.first, start), self.n)
            found = min(found, int(self.live[due]))
        return found

    def state(self, k: int) -> int:
        return int(self.sides[k]) * (self.first + int(self.entries[k]) + 1)

    def end_states(self) -> list[int]:
        """End state of the block when flat right before entry bar k; one more for "no entry left"."""
        ends = [0] * (len(self.entries) + 1)
        for k in range(len(self.entries) - 1, -1, -1):
            at = int(self.entries[k])
            closed = self.exit_of(int(self.sides[k]), self.first + at, at + 1)
            ends[k] = self.state(k) if closed == self.n else ends[self.entry_after(closed)]
        return ends


def block_map(bars: pd.DataFrame) -> dict:
    """The block's map as one row. ``live_at``/``live_to`` list the bars at which a holding limit can
    fall due for a position from before the block: at most ``max_hold`` of them, plus the next."""
    block = _Block(bars)
    ends = block.end_states()

    def after(position: int) -> int:
        return ends[block.entry_after(position)] if position < block.n else 0

    long_exit, short_exit = int(block.closing[1][0]), int(block.closing[-1][0])
    live_at: list[int] = []
    if block.max_hold is not None:
        reach = min(block.max_hold, block.n)
        due = np.unique(block.live[: reach + 1])
        live_at = [int(p) for p in due if p < block.n]
    return {
        "first_index": block.first, "flat_to": ends[0],
        "long_exit": block.first + long_exit if long_exit < block.n else None, "long_to": after(long_exit),
        "short_exit": block.first + short_exit if short_exit < block.n else None,
        "short_to": after(short_exit),
        "live_at": [block.first + p for p in live_at], "live_to": [after(p) for p in live_at],
        "max_hold": block.max_hold,
    }


def apply_map(state: int, row: dict) -> int:
    """State after a block, given the state that enters it."""
    if state == 0:
        return row["flat_to"]
    side = "long" if state > 0 else "short"
    closing, to = row[f"{side}_exit"], row[f"{side}_to"]
    if row["max_hold"] is not None:
        due = abs(state) - 1 + row["max_hold"]
        k = bisect_left(row["live_at"], due)
        if k < len(row["live_at"]) and (closing is None or row["live_at"][k] < closing):
            closing, to = row["live_at"][k], row["live_to"][k]
    return state if closing is None else to


def entering(maps: pd.DataFrame) -> list[int]:
    """Entering state of each block, for the maps of one series in block order."""
    states, state = [], 0
    for record in maps.to_dict("records"):
        row = {k: (None if np.isscalar(v) and pd.isna(v) else v) for k, v in record.items()}
        for name in ("live_at", "live_to"):
            row[name] = list(row[name])
        states.append(state)
        state = int(apply_map(state, row))
    return states


def mark_bars(bars: pd.DataFrame, state: int, is_last_block: bool) -> pd.DataFrame:
    """Position held into each bar, bars that open a trade, and bars that close one with the reason."""
    block = _Block(bars)
    held = np.zeros(block.n, dtype="int32")
    opened = np.zeros(block.n, dtype=bool)
    exit_code = np.zeros(block.n, dtype="int32")
    entry_index = np.full(block.n, -1, dtype="int64")

    def close(position: int, since: int, code: int) -> None:
        exit_code[position] = code
        entry_index[position] = since

    start = 0
    while True:
        if state == 0:
            k = block.entry_after(start - 1)
            if k == len(block.entries):
                break
            state = block.state(k)
            start = int(block.entries[k]) + 1
            opened[start - 1] = True
        side, since = (1, state - 1) if state > 0 else (-1, -state - 1)
        closed = block.exit_of(side, since, start)
        held[start: closed + 1] = side
        if closed == block.n:
            break
        due = block.max_hold is not None and block.first + closed - since >= block.max_hold
        close(closed, since, MAX_HOLD if due else int(block.code[side][closed]))
        state, start = 0, closed + 1
    if is_last_block and state != 0:
        close(block.n - 1, abs(state) - 1, END_OF_DATA)
    return bars.assign(held=held, opened=opened, entry_index=entry_index, exit_code=exit_code)

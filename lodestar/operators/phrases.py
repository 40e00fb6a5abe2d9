"""Sloppy phrases: how often, and how closely, the words of a query stand in order in a field.

Each word of the query is a cursor over its positions in the field, less its own place in the query, so where all cursors agree the phrase
stands exactly, and their spread, from the last to the first, tells how far words are out of place. The cursors go through the field like this:

* They start at first positions; cursors of a word that the query repeats start at its first, second, ... position, as no two of them may
  stand on one position of the field.
* The cursor that is behind all others (of equal ones, that of the earlier word) moves on until it has passed the one that was next to it. The least
  spread on the way is a match if it is at most the slop, and counts 1 / (1 + spread).
* A cursor that comes to a position on which another one of the same word stands makes the later of the two words move on.
* All ends when a cursor has no further position; the spread until then may be a last match.

A query of one word matches at each of its positions. Each step moves a cursor on, so a field costs as much as the query's words have positions in it, times
the logarithm of their number.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import functions as F


def frequency(places: list[list[int]], positions: list[list[int]], slop: int) -> float:
    """Matches within ``slop``, each weighed by its spread.

    ``places`` has each different word's places in the query, ``positions`` its ascending positions in the field. A word without positions, or with
    fewer than it has places, makes it 0.
    """
    words = sorted((place, w, nth) for w, own in enumerate(places) for nth, place in enumerate(sorted(own)))
    if not words or any(len(positions[w]) <= nth for _, w, nth in words):
        return 0.0
    if len(words) == 1:
        return float(len(positions[0]))
    offset, at = [place for place, _, _ in words], [nth for _, _, nth in words]
    over = [positions[w] for _, w, _ in words]
    twins = [[c for c, (_, v, _) in enumerate(words) if v == w and c != k] for k, (_, w, _) in enumerate(words)]

    def stands(c: int) -> int:
        return int(over[c][at[c]]) - offset[c]

    waiting = [(stands(c), c) for c in range(len(words))]
    heapq.heapify(waiting)
    last = max(waiting)[0]
    total = 0.0
    first, current = heapq.heappop(waiting)
    spread, following = last - first, waiting[0][0]
    while True:
        moving, pushed = current, False
        while moving is not None:
            at[moving] += 1
            if at[moving] == len(over[moving]):
                return total + (1.0 / (1 + spread) if spread <= slop else 0.0)
            last = max(last, stands(moving))
            pushed |= moving != current
            on = over[moving][at[moving]]
            rival = next((c for c in twins[moving] if over[c][at[c]] == on), None)
            moving = None if rival is None else max(moving, rival)
        if pushed:
            waiting = [(stands(c), c) for c in range(len(words)) if c != current]
            heapq.heapify(waiting)
        if stands(current) > following:
            total += 1.0 / (1 + spread) if spread <= slop else 0.0
            first, current = heapq.heappushpop(waiting, (stands(current), current))
            spread, following = last - first, waiting[0][0]
        else:
            spread = min(spread, last - stands(current))


def frequencies(slop: int):
    """A column function of (places, positions), arrays of arrays by word: ``frequency`` of each row."""

    @F.pandas_udf("double")
    def each(places: pd.Series, positions: pd.Series) -> pd.Series:
        return pd.Series([frequency(a, b, slop) for a, b in zip(places, positions, strict=True)], dtype=float)

    return each

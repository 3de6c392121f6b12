"""Merging of sorted runs by a loser tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any


def merged(runs: list[Iterator[Any]], key: Callable[[Any], Any]) -> Iterator[Any]:
    """The rows of all runs in the order of key; equal keys come in the order of the runs.

    Inner node i holds the run that lost there; the winner of all stands apart. One path of about log2(k) nodes is played
    again for each row that is taken.
    """
    k = len(runs)
    heads: list[Any] = [next(r, None) for r in runs]
    keys: list[Any] = [None if h is None else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return keys[a] < keys[b] or (keys[a] == keys[b] and a < b)

    losers = [-1] * k
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while k and keys[top] is not None:
        yield heads[top]
        heads[top] = row = next(runs[top], None)
        keys[top] = None if row is None else key(row)
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                top, losers[node] = losers[node], top
            node //= 2

"""Re-Pair grammars of many token sequences at once.

In every round each sequence replaces, side by side, all pairs of neighbours that come more often in
it than the pairs that overlap them; a replaced pair is a rule. A sequence is done when no pair comes
twice in it. Pairs are counted by one sort over all sequences of a batch, so a round costs a few passes
over the tokens of the sequences that are not done, whatever their number.

A rule is named by a hash of the two symbols it replaces, down to the tokens: rules of different
sequences that bear one name stand for the same tokens.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = (a * _A) ^ ((b + _C) * _B)
    v ^= v >> np.uint64(29)
    v *= _C
    return v ^ (v >> np.uint64(32))


class Grammars(NamedTuple):
    """sizes: of each sequence, symbols left plus two for each rule; owner, rule, length: of each rule its sequence, name and tokens."""

    sizes: np.ndarray
    owner: np.ndarray
    rule: np.ndarray
    length: np.ndarray


def grammars(symbols: np.ndarray, owner: np.ndarray, count: int) -> Grammars:
    """symbols: hashes of all tokens, sequence after sequence; owner: the sequence of each, from 0 to count."""
    symbols, owner = symbols.astype(np.uint64), owner.astype(np.int64)
    length = np.ones(len(symbols), np.int64)
    rules, left = np.zeros(count, np.int64), np.zeros(count, np.int64)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(symbols) >= 2:
        n = len(symbols)
        inside = owner[1:] == owner[:-1]
        pair = mix(symbols[:-1], symbols[1:])
        keyed = mix(pair, owner[1:].astype(np.uint64))
        order = np.argsort(keyed)
        ranked = keyed[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.empty(n - 1, np.int64)
        group[order] = np.cumsum(new) - 1
        times = np.bincount(group[inside], minlength=int(new.sum()))[group]
        times[~inside] = 0
        # A pair is taken where it outweighs both pairs that overlap it; equal pairs count alike, ties go by hash.
        weight = times.astype(np.float64) + (pair >> np.uint64(12)).astype(np.float64) / 2.0**52
        weight[times < 2] = 0
        before, after = np.concatenate([[0.0], weight[:-1]]), np.concatenate([weight[1:], [0.0]])
        take = (weight > 0) & (weight > before) & (weight >= after)
        take[1:] &= ~(take[1:] & take[:-1])
        if not take.any():
            break
        at = np.flatnonzero(take)
        first = np.full(int(new.sum()), -1, np.int64)
        first[group[at]] = at
        first = first[first >= 0]
        rules += np.bincount(owner[first], minlength=count)
        made.append((owner[first], pair[first], length[first] + length[first + 1]))
        symbols, length = symbols.copy(), length.copy()
        symbols[at] = pair[at]
        length[at] += length[at + 1]
        keep = np.ones(n, bool)
        keep[at + 1] = False
        active = np.bincount(owner[at], minlength=count) > 0
        symbols, owner, length = symbols[keep], owner[keep], length[keep]
        # Of a sequence in which no pair was taken none comes twice but beside itself, and none ever will.
        rest = active[owner]
        if rest.sum() < 0.9 * len(rest):
            left += np.bincount(owner[~rest], minlength=count)
            symbols, owner, length = symbols[rest], owner[rest], length[rest]
    left += np.bincount(owner, minlength=count)
    if not made:
        empty = np.zeros(0, np.int64)
        return Grammars(left, empty, empty.view(np.uint64), empty)
    return Grammars(left + 2 * rules, *(np.concatenate(parts) for parts in zip(*made)))


def grammar_sizes(symbols: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Size of each sequence's grammar."""
    return grammars(symbols, owner, count).sizes

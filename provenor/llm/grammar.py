"""Re-Pair: sequences of ids as a grammar of pairs.

The most frequent pairs of neighbouring symbols are replaced by new symbols,
round after round. A round counts all pairs at once, takes the most frequent ones
and replaces their occurrences from left to right; where two chosen pairs share a
symbol the left one is replaced. No pair crosses the end of a document, so every
document is a run of whole symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from provenor.llm.words import U


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``starts[k] .. starts[k] + lengths[k] - 1`` of all k, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


@dataclass
class Grammar:
    """Symbols under ``terminals`` are ids; rule k is symbol ``terminals + k`` and stands for ``left[k] right[k]``.

    A rule only names symbols that were there before its round; ``rounds`` holds
    the number of rules after each round. ``last`` marks the last symbol of each document.
    """

    terminals: int
    left: np.ndarray
    right: np.ndarray
    rounds: list[int]
    symbols: np.ndarray
    last: np.ndarray

    def lengths(self) -> np.ndarray:
        """How many ids each rule stands for."""
        size = np.ones(len(self.left), np.int64)
        for a, b in zip([0, *self.rounds], self.rounds, strict=False):
            size[a:b] = symbol_lengths(self.left[a:b], self.terminals, size) + symbol_lengths(self.right[a:b], self.terminals, size)
        return size


def symbol_lengths(symbols: np.ndarray, terminals: int, rule_lengths: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    rules = symbols >= terminals
    out[rules] = rule_lengths[symbols[rules] - terminals]
    return out


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return (key * U(0x9E3779B97F4A7C15)) >> U(64 - bits)


def frequent_pairs(symbols: np.ndarray, last: np.ndarray, least: int, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to replace, the places of their occurrences and which pair each place has.

    Pairs are found by a hash table with one pair a slot; one whose slot a more frequent pair has waits for a later round.
    """
    small = int(symbols.max()) < 0xFFFF  # 32-bit keys sort faster
    width = np.uint32(16) if small else U(32)
    wide = symbols.astype(np.uint32 if small else U)
    key = (wide[:-1] << width) | wide[1:]
    none = ~key.dtype.type(0)
    key[last[:-1]] = none
    order = np.sort(key)
    order = order[: np.searchsorted(order, none)]
    if not len(order):
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1], [True]]))
    times = np.diff(edge)
    many = np.flatnonzero(times >= least)
    many = many[np.lexsort((many, -times[many]))[:most]]
    pairs = order[edge[many]]
    if not len(pairs):
        return pairs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(16, int(8 * len(pairs)).bit_length())
    slot = _slots(pairs.astype(U), bits)
    first = np.unique(slot, return_index=True)[1]  # the most frequent one of each slot
    table, number = np.full(1 << bits, none, key.dtype), np.zeros(1 << bits, np.int32)
    table[slot[first]], number[slot[first]] = pairs[first], first
    starts, ends = np.zeros((2, int(symbols.max()) + 1), bool)
    starts[pairs >> width] = True
    ends[pairs & key.dtype.type((1 << int(width)) - 1)] = True
    places = np.flatnonzero(starts[symbols[:-1]] & ends[symbols[1:]])
    near = key[places]
    at = _slots(near.astype(U), bits)
    hit = (table[at] == near) & (near != none)
    places, which = places[hit], number[at[hit]].astype(np.int64)
    fresh = np.concatenate([[True], np.diff(places) != 1])[: len(places)]  # overlapping occurrences: every second one of a chain
    chain = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
    keep = (np.arange(len(places)) - chain) % 2 == 0
    return pairs, places[keep], which[keep]


def compress(ids: np.ndarray, last: np.ndarray, terminals: int, least: int = 2, per_round: int | None = None, rounds: int | None = None, rules: int | None = None) -> Grammar:
    """The grammar of ``ids`` (all under ``terminals``), whose documents end where ``last`` is set.

    Rounds go on until no pair occurs ``least`` times (2 at least), or until
    ``rounds`` rounds or ``rules`` rules are made. The order of ids alone decides the result.
    """
    symbols, left, right, made = ids.astype(np.int32), [], [], [0]
    last = last.copy()
    while (rounds is None or len(made) <= rounds) and len(symbols) > 1:
        room = None if rules is None else rules - made[-1]
        most = per_round if room is None else room if per_round is None else min(per_round, room)
        pairs, places, which = frequent_pairs(symbols, last, max(2, least), most)
        used = np.bincount(which, minlength=len(pairs)) >= 2
        if not used.any():
            break
        keep = used[which]
        places, which = places[keep], (np.cumsum(used) - 1)[which[keep]]
        pairs = pairs[used]
        width = pairs.dtype.type(pairs.dtype.itemsize * 4)
        left.append((pairs >> width).astype(np.int64))
        right.append((pairs & pairs.dtype.type((1 << int(width)) - 1)).astype(np.int64))
        symbols[places] = terminals + made[-1] + which
        last[places] = last[places + 1]
        stay = np.ones(len(symbols), bool)
        stay[places + 1] = False
        symbols, last = symbols[stay], last[stay]
        made.append(made[-1] + len(pairs))
    none = [np.zeros(0, np.int64)]
    return Grammar(terminals, np.concatenate(left or none), np.concatenate(right or none), made[1:], symbols.astype(np.int64), last)


class Expander:
    """Turns symbols back into ids; all rules are written out once, level by level."""

    def __init__(self, terminals: int, left: np.ndarray, right: np.ndarray, rule_lengths: np.ndarray):
        self.length = np.concatenate([np.ones(terminals, np.int64), rule_lengths])
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.empty(int(self.length.sum()), np.int64)
        self.pool[:terminals] = np.arange(terminals)
        done = 0
        while done < len(left):  # the rules that only name symbols which are written out already
            known = terminals + done
            bad = np.flatnonzero((left[done:] >= known) | (right[done:] >= known))
            stop = done + int(bad[0]) if len(bad) else len(left)
            if stop == done:
                raise ValueError("a rule names a later rule")
            rules = np.arange(done, stop)
            for side, shift in ((left, 0), (right, self.length[left[rules]])):
                symbols = side[rules]
                to = ragged(self.start[terminals + rules] + shift, self.length[symbols])
                self.pool[to] = self.pool[ragged(self.start[symbols], self.length[symbols])]
            done = stop

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.start[symbols], self.length[symbols])]

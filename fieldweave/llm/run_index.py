"""A run-length index: run-compressed Burrows-Wheeler transform with samples at run ends.

Built over a block of fragments joined by separators.  For every run of equal letters
in the transform it keeps the first row, the row that its first letter maps to, and the
lengths of the common prefixes at both ends after that step.  That is enough to walk any
fragment from its end to its start and to know, at each place, how long a match starts
there with the neighbouring suffixes: inside a run a step lengthens the match by one,
at a run's end the sample says what is left.

A fragment that occurs twice or more stands in the index with a twin: its rows are doubled,
each twin's row right below the first one's.  They have the same letter, so the transform
gains no run, which is what makes it small for repetitive text.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed into a key (nine bits each).
_PACKED = 7
#: Where the first, second, ... symbol from the end of a key begins.
_PLACES = np.array([1 << 9 * i for i in range(1, _PACKED)], dtype=np.int64)


def packed(symbols: np.ndarray) -> np.ndarray:
    """The next seven symbols (0 to 510) at each place and at the end as one number, in the order of the symbols; 0: past the end."""
    n = len(symbols)
    padded = np.zeros(n + _PACKED, dtype=np.int16)
    padded[:n] = symbols + 1
    keys = np.zeros(n + 1, dtype=np.int64)
    for k in range(_PACKED):
        keys <<= 9
        keys |= padded[k : k + n + 1]
    return keys


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Suffix array of the text with these ``packed`` keys, by prefix doubling, sorting anew only what is still tied."""
    n = len(keys) - 1
    order = np.argsort(keys[:n])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    key, at, rows, depth = keys.take(order), order, np.arange(n), _PACKED
    while True:
        fresh = np.ones(len(rows) + 1, dtype=bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:-1])
        group = np.multiply(rows, fresh[:-1], out=key)
        np.maximum.accumulate(group, out=group)  # a row's rank: the first row of its group
        rank[at] = group
        tied = ~(fresh[:-1] & fresh[1:])
        if not tied.any():
            return order
        rows, at, key = rows[tied], at[tied], group[tied]
        del group, tied
        key *= n + 1
        key += rank.take(np.minimum(at + depth, n))
        inner = np.argsort(key)
        key, at = key.take(inner), at.take(inner)
        order[rows] = at
        depth *= 2


def common_prefix(keys: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix, up to ``most``, of the unlike suffixes at a and b (negative: none), one ``packed`` key at a time."""
    out = np.zeros(len(a), dtype=np.int64)
    open_ = np.flatnonzero((a >= 0) & (b >= 0))
    x, y = a[open_], b[open_]
    for depth in range(0, most, _PACKED):
        if not len(open_):
            break
        differ = keys.take(x) ^ keys.take(y)
        out[open_] = depth + _PACKED - 1 - np.searchsorted(_PLACES, differ, side="right")
        same = np.flatnonzero(differ == 0)  # none of these ends in the key, so another one follows
        open_ = open_.take(same)
        out[open_] = depth + _PACKED
        x, y = x.take(same) + _PACKED, y.take(same) + _PACKED
    return np.minimum(out, most)


class RunIndex:
    """Index over fragments, those flagged in ``twice`` with a twin; ``most`` caps the lengths of matches that are told apart."""

    def __init__(self, fragments: list[bytes], most: int, twice: np.ndarray | None = None):
        self.most = most
        sizes = np.array([len(f) for f in fragments], dtype=np.int64)
        self.symbols = np.zeros(int(sizes.sum()) + len(fragments), dtype=np.int16)
        self.stop = np.cumsum(sizes + 1) - 1  # places of the separators
        self.begin = self.stop - sizes
        inside = np.ones(len(self.symbols), dtype=bool)
        inside[self.stop] = False
        self.symbols[inside] = np.frombuffer(b"".join(fragments), dtype=np.uint8).astype(np.int16) + 1
        self._build(np.repeat(np.ones(len(sizes), dtype=np.int8) if twice is None else 1 + twice.astype(np.int8), sizes + 1))

    def _build(self, times: np.ndarray) -> None:
        """times: rows of the suffix at each place."""
        n = len(self.symbols)
        keys = packed(self.symbols)
        order = suffix_array(keys)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        first = np.zeros(n + 1, dtype=np.int64)  # row of each rank's first suffix, twins counted
        np.cumsum(times.take(order), out=first[1:])
        letters = self.symbols.take(order - 1)
        heads = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
        tails = np.concatenate([heads[1:], [n]]) - 1
        self.rows = int(first[n])
        self.heads, self.tails = first[heads], first[tails + 1] - 1
        before, after, entry = rank.take(order.take(heads) - 1), rank.take(order.take(tails) - 1), rank.take(self.stop)
        self.maps, self.entry = first.take(before), first.take(entry)
        del letters, heads, tails, first, rank

        def shared(rows: np.ndarray, by: int) -> np.ndarray:
            """Common prefixes with the suffixes so many ranks below."""
            other = order.take(rows + by, mode="clip")
            other[(rows + by < 0) | (rows + by >= n)] = -1
            return common_prefix(keys, order.take(rows), other, self.most)

        # Samples: the common prefixes of the mapped rows with the rows above and below.
        self.at_head, self.at_tail = shared(before, -1), shared(after, 1)
        # Entry rows: each fragment's separator, with its own neighbours; a twin stands below.
        self.entry_above, self.entry_below = shared(entry, -1), np.where(times[self.stop] == 1, shared(entry, 1), 0)

    def long_matches(self) -> np.ndarray:
        """Places of the joined text where a match of ``most`` or more with another place starts.

        Streams the matching statistics of all fragments backwards, one letter of each a step.
        A step looks up a row's run in a table of all rows and what the run keeps as one record.
        """
        kind = np.int32 if self.rows < 1 << 31 else np.int64
        run_of = np.repeat(np.arange(len(self.heads), dtype=kind), self.tails - self.heads + 1)
        kept = np.empty((len(self.heads), 5), dtype=kind)
        for i, values in enumerate((self.heads, self.tails, self.maps - self.heads, self.at_head, self.at_tail)):
            kept[:, i] = values
        long = np.zeros(len(self.symbols), dtype=bool)
        order = np.argsort(self.begin - self.stop, kind="stable")  # longest first
        place, row, above, below = (x[order].astype(kind) for x in (self.stop, self.entry, self.entry_above, self.entry_below))
        sizes = (self.stop - self.begin)[order]
        lives = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))))
        for step, live in enumerate(lives.tolist(), 1):
            r, up, down = row[:live], above[:live], below[:live]
            head, tail, shift, at_head, at_tail = kept.take(run_of.take(r), axis=0).T
            up += 1
            down += 1
            np.copyto(up, at_head, where=r == head)
            np.copyto(down, at_tail, where=r == tail)
            r += shift
            long[place[:live][np.maximum(up, down) >= self.most] - step] = True
        return long

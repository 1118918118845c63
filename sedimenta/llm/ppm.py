"""The model of prediction by partial matching: counts of byte contexts and the probabilities they give.

A symbol is a byte of the text or END; before the first stand ``ORDER`` bytes
START, so every symbol has a whole context. A context of j bytes with counts of n
in all over q different symbols gives (2 count - 1) / 2n to a seen symbol and
q / 2n to the escape to j - 1 bytes (method D), where the symbols it has seen are
excluded. Below the empty context, what is left is equally likely. The longest
contexts count occurrences; shorter ones, which are asked only after an escape,
count in how many different longer contexts the symbol came (update exclusion).

A model may be made of some contexts only, if with a context it has its suffixes
and with a suffix all symbols of it: what is excluded then follows from these.
"""

from __future__ import annotations

import numpy as np

ORDER = 5
START, END = b"\xfe", b"\xff"
SYMBOLS = 256
_HASH = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with their marks, where each begins)."""
    before = START * ORDER
    data = np.frombuffer(b"".join(before + t + END for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + ORDER + 1 for t in texts], dtype=np.int64)
    return data, np.cumsum(sizes) - sizes


def windows(texts: list[bytes], most: int):
    """(number of the first text, marked bytes, where texts begin in them): texts together up to ``most`` bytes, a longer one in parts that overlap by a context."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if len(text) > most:
            if at < i:
                yield at, *joined(texts[at:i])
            for first in range(0, len(text) + 1, most):
                before = text[max(0, first - ORDER) : first]
                part = START * (ORDER - len(before)) + before + text[first : first + most] + (END if first + most > len(text) else b"")
                yield i, np.frombuffer(part, dtype=np.uint8), np.zeros(1, dtype=np.int64)
            at, held = i + 1, 0
            continue
        held += len(text)
        if held >= most:
            yield at, *joined(texts[at : i + 1])
            at, held = i + 1, 0
    if at < len(texts):
        yield at, *joined(texts[at:])


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram) of each symbol: its context's bytes, oldest highest, and itself lowest."""
    keys = np.zeros(len(data) - ORDER, dtype=np.uint64)
    for back in range(ORDER, -1, -1):
        keys <<= np.uint64(8)
        keys |= data[ORDER - back : len(data) - back]
    real = data[ORDER:] != START[0]
    return np.flatnonzero(real) + ORDER, keys[real]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sum of their counts (of ones, if none are given)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    total = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], total.astype(np.int64)


def shortened(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * (order + 1)) - 1)


def by_order(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, counts, how often each gram's context occurred) for each order from 0 to ORDER, from the longest grams and their occurrences."""
    out, longer = [], None
    for j in range(ORDER, -1, -1):
        grams_j, occurred = summed(shortened(keys, j), counts)
        own = occurred if longer is None else summed(shortened(longer, j))[1]
        _, n = summed(grams_j >> np.uint64(8), occurred)
        _, q = summed(grams_j >> np.uint64(8))
        out.append((grams_j, own, np.repeat(n, q)))
        longer = grams_j
    return out[::-1]


class Model:
    """``tables``: for each order from 0 to ORDER the sorted grams and their counts."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.keys = [k for k, _ in tables]
        self.log_count = [np.log10(np.maximum(2 * c - 1, 1)) for _, c in tables]
        self.contexts, self.start, self.escape, self.left, self.escape_left = [], [], [], [], []
        for j, (keys, counts) in enumerate(tables):
            context, n = summed(keys >> np.uint64(8), counts)
            _, q = summed(keys >> np.uint64(8))
            self.contexts.append(context)
            self.start.append(np.log10(np.maximum(2 * n, 1)))
            self.escape.append(np.log10(np.maximum(q, 1) / np.maximum(2 * n, 1)))
            if j == 0:
                unseen = SYMBOLS - int(q.sum())
                self.floor = -np.log10(unseen) if unseen else -np.inf
                self.left.append(np.zeros(0))
                self.escape_left.append(np.zeros(0))
                sizes = n, q, context
                continue
            # What remains of the next shorter context once this one's symbols are excluded.
            lower_keys, lower_counts = tables[j - 1]
            taken = np.add.reduceat(lower_counts[np.searchsorted(lower_keys, shortened(keys, j - 1))], np.searchsorted(keys >> np.uint64(8), context)) if len(keys) else n
            lower_n, lower_q, lower_context = sizes
            at = np.searchsorted(lower_context, context & np.uint64((1 << 8 * (j - 1)) - 1))
            rest_n, rest_q = lower_n[at] - taken, lower_q[at] - q
            self.left.append(np.log10(np.maximum(2 * rest_n, 1)))
            self.escape_left.append(np.where(rest_q > 0, np.log10(np.maximum(rest_q, 1) / np.maximum(2 * rest_n, 1)), 0.0))
            sizes = n, q, context
        self._hash()
        # The longest grams are in the hash table, and what is not there is asked of shorter ones.
        self.keys[ORDER], self.log_count[ORDER] = self.keys[ORDER][:0], self.log_count[ORDER][:0]
        for table in (self.log_count, self.start, self.escape, self.left, self.escape_left):
            table[:] = [x.astype(np.float32) for x in table]

    def _hash(self) -> None:
        """A table of the longest grams with their log probabilities, by linear probing."""
        keys = self.keys[ORDER]
        values = self.log_count[ORDER] - self.start[ORDER][np.searchsorted(self.contexts[ORDER], keys >> np.uint64(8))]
        self.bits = max(4, int(1.3 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slots, self.values = np.full(size, _EMPTY), np.zeros(size, dtype=np.float32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.slots[at] == _EMPTY
            self.slots[at[free]] = keys[todo[free]]
            put = self.slots[at] == keys[todo]
            self.values[at[put]] = values[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol after the bytes before it."""
        at = self._home(keys)
        held = self.slots[at]
        out = self.values[at].astype(np.float64)
        todo = np.flatnonzero(held != keys)
        lost = [todo[held[todo] == _EMPTY]]
        todo = todo[held[todo] != _EMPTY]
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.slots[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            lost.append(todo[held == _EMPTY])
            on = ~hit & (held != _EMPTY)
            todo, at = todo[on], at[on]
        todo = np.concatenate(lost)
        if len(todo):
            out[todo] = self._escaped(keys[todo])
        return out

    def _find(self, table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return at, (table[at] == keys if len(table) else np.zeros(len(keys), dtype=bool))

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        """The same from the longest context that was seen down, for grams that the longest order lacks."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        above = np.full(len(keys), -1)  # the place of the context one longer, if it was seen
        for j in range(ORDER, -1, -1):
            key = shortened(keys[todo], j)
            gram, hit = self._find(self.keys[j], key)
            context, seen = self._find(self.contexts[j], key >> np.uint64(8))
            after = above[todo] >= 0
            if j < ORDER:
                step = np.where(after, self.left[j + 1][above[todo]] if len(self.left[j + 1]) else 0.0, self.start[j][context] if len(self.start[j]) else 0.0)
                leave = np.where(after, self.escape_left[j + 1][above[todo]] if len(self.left[j + 1]) else 0.0, self.escape[j][context] if len(self.escape[j]) else 0.0)
            else:
                step, leave = (self.start[j][context], self.escape[j][context]) if len(self.start[j]) else (np.zeros(len(todo)),) * 2
            out[todo[hit]] += self.log_count[j][gram[hit]] - step[hit]
            miss = ~hit
            out[todo[miss]] += np.where(seen, leave, 0.0)[miss]
            above[todo] = np.where(seen, context, -1)
            todo = todo[miss]
        out[todo] += self.floor
        return out

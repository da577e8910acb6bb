"""Token ids of texts through those of their distinct words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class KeptWords:
    """Encodes each distinct word once a batch and keeps the first words, up to ``memory`` bytes, for later batches.

    What is kept has no influence on results.  A word counts with the bytes of
    its text and ids and some hundred for its place in the table.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], memory: int = 40 << 20):
        self.encode, self.room = encode, memory
        self.kept: dict[str, int] = {}
        self.at = np.zeros(1, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)  # the kept ids, then those of the batch at hand

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and size of each word's ids); the ids are valid until the next call."""
        known = np.array([self.kept.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(known < 0)
        fresh, fresh_size = self.encode([words[k] for k in new])
        used, need = int(self.at[-1]), int(self.at[-1]) + len(fresh)
        if need > len(self.flat):
            grown = np.zeros(max(need, len(self.flat) * 3 // 2), np.uint32)
            grown[:used] = self.flat[:used]
            self.flat = grown
        self.flat[used:need] = fresh
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        old = known >= 0
        start[old], size[old] = self.at[known[old]], self.at[known[old] + 1] - self.at[known[old]]
        start[new], size[new] = used + np.cumsum(fresh_size) - fresh_size, fresh_size
        cost = sum(len(words[k]) for k in new) + 4 * len(fresh) + 120 * len(new)
        if cost <= self.room:
            self.room -= cost
            self.kept.update(zip([words[k] for k in new], range(len(self.kept), len(self.kept) + len(new)), strict=True))
            self.at = np.concatenate((self.at, used + np.cumsum(fresh_size)))
        return self.flat, start, size


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray, word: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that consist of the given words, ``per_text`` of them each, and the ids per text."""
    count = size[word]
    ends = np.cumsum(count)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[word] - (ends - count), count)
    total = np.concatenate(([0], ends))
    at = np.concatenate(([0], np.cumsum(per_text)))
    return flat[where], np.diff(total[at])

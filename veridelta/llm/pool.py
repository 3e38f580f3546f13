"""A bounded store of values (runs of ids) by text key, for workers that meet the same words again and again."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from .common import ragged


class Pool:
    """Runs of unsigned 32-bit ids by key; encode gives the runs of new keys one after the other, and their lengths. When it holds more than limit keys it keeps those met again since the last time."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.again: set[str] = set()
        self.flat, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _drop(self) -> None:
        keys = list(self.again) if len(self.again) <= self.limit // 2 else []
        at = np.fromiter((self.index[k] for k in keys), np.int64, len(keys))
        flat = self.flat[ragged(self.first[at], self.count[at])]
        self.index = {k: i for i, k in enumerate(keys)}
        self.count = self.count[at]
        self.flat, self.first, self.again = flat, np.cumsum(self.count) - self.count, set()

    def learn(self, keys: set[str]) -> None:
        """Makes sure that all keys are there."""
        if len(self.index) > self.limit:
            self._drop()
        known = keys & self.index.keys()
        self.again |= known
        new = list(keys - known)
        if new:
            flat, count = self.encode(new)
            self.index.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
            self.first = np.r_[self.first, len(self.flat) + np.cumsum(count) - count]
            self.count, self.flat = np.r_[self.count, count], np.r_[self.flat, flat.astype(np.uint32)]

    def places(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def runs(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lists of keys one after the other, and each list's number of ids."""
        self.learn(set().union(*lists))
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, int(size.sum()))
        count = self.count[at]
        total = np.r_[0, np.cumsum(count)]
        return self.flat[ragged(self.first[at], count)], np.diff(total[np.r_[0, np.cumsum(size)]])


def joined(runs: list) -> tuple[np.ndarray, np.ndarray]:
    """Runs one after the other, and their lengths."""
    count = np.fromiter(map(len, runs), np.int64, len(runs))
    return np.fromiter(chain.from_iterable(runs), np.uint32, int(count.sum())), count

"""Similarities of one set to many by the places of its members: exact, in memory, within one sample."""

from __future__ import annotations

import numpy as np


class Sets:
    """Sets of codes 0, 1, ..., one after another in `codes`; set i from bounds[i] to bounds[i + 1]."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        self.codes, self.bounds, self.sizes = codes, bounds, np.diff(bounds)
        self.held = np.bincount(codes, minlength=1) if len(codes) else np.zeros(1, np.int64)
        self._at = np.concatenate([[0], np.cumsum(self.held)]).tolist()
        self._rows = np.repeat(np.arange(len(self.sizes)), self.sizes)[np.argsort(codes, kind="stable")]

    def __len__(self) -> int:
        return len(self.sizes)

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.bounds[i] : self.bounds[i + 1]]

    def holding(self, codes: np.ndarray) -> np.ndarray:
        """The sets that hold each of the codes, one code after another."""
        at = self._at
        places = [self._rows[at[c] : at[c + 1]] for c in codes.tolist()]
        return np.concatenate(places) if places else np.zeros(0, np.int64)

    def similarity(self, codes: np.ndarray, size: int | None = None) -> np.ndarray:
        """Jaccard similarity to each set; 0 if either is empty. size: of the asking set, if some of its members have no code."""
        common = np.bincount(self.holding(codes), minlength=len(self))
        return common / np.maximum(1, (len(codes) if size is None else size) + self.sizes - common)


def from_values(values: np.ndarray, lengths: np.ndarray) -> Sets:
    """Sets of any numbers, one after another."""
    codes = np.unique(values, return_inverse=True)[1].reshape(-1) if len(values) else np.zeros(0, np.int64)
    return Sets(codes, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))


def replaced(sets: Sets, moment: np.ndarray, known: np.ndarray, marked: np.ndarray, t: float) -> np.ndarray:
    """Which sets have a t-similar one (t above 0) that is marked and of a later moment. known: whether the moment is."""
    out = np.zeros(len(sets), bool)
    for b in np.flatnonzero(known & marked):
        open_ = known & (moment < moment[b]) & ~out
        if open_.any():
            out |= open_ & (sets.similarity(sets.of(b)) >= t)
    return out


def any_repeats(sets: Sets, among: np.ndarray, t: float) -> bool:
    """Whether one of `among` is t-similar (t above 0) to a set before it.

    A t-similar set holds one of any n - ceil(t n) + 1 of its n members; the rarest are asked.
    """
    for a in np.flatnonzero(among & (sets.sizes > 0)):
        own = sets.of(a)
        n = len(own)
        rare = own[np.argsort(sets.held[own], kind="stable")[: n - int(np.ceil(round(t * n, 9))) + 1]]
        if sets.held[rare].max() < 2:
            continue
        near = sets.holding(rare)
        near = near[near < a]
        for b in np.unique(near[np.minimum(sets.sizes[near], n) >= round(t * n, 9)]) if len(near) else ():
            common = len(np.intersect1d(own, sets.of(b), assume_unique=True))
            if common / (n + sets.sizes[b] - common) >= t:
                return True
    return False

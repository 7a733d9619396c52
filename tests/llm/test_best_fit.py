"""Packing against the quadratic best fit."""

import numpy as np
import pytest

from parcelwise.llm import packing


@pytest.mark.parametrize("capacity", [1, 7, 64, 1024])
def test_windows_are_those_of_the_quadratic_best_fit(capacity):
    rng = np.random.default_rng(capacity)
    for n in (0, 1, 5, 700):
        lengths = rng.integers(1, capacity + 1, n) if n != 5 else np.full(5, capacity)
        rooms: list[int] = []
        for length in sorted(lengths.tolist(), reverse=True):
            fitting = [k for k, room in enumerate(rooms) if room >= length]
            if fitting:
                rooms[min(fitting, key=lambda k: rooms[k])] -= length
            else:
                rooms.append(capacity - length)
        window, offset = packing.best_fit_decreasing(lengths, capacity)
        filled = np.bincount(window, lengths, minlength=0).astype(int) if n else np.zeros(0, int)
        # windows of equal room are alike, so the rooms left are the same whichever was taken
        assert sorted(capacity - filled) == sorted(rooms)
        for w in np.unique(window):
            own = np.flatnonzero(window == w)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]

"""Windows of a sequence grouped by their minimisers."""

from __future__ import annotations

import numpy as np

_ODD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * _TURN
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position on: a polynomial built by doubling, spread at the end."""
    n = len(symbols) - k + 1
    h, have, base = symbols.astype(np.uint64) + np.uint64(1), 1, int(_ODD)
    out, covered = None, 0
    while True:
        if k & have:  # this power of two is part of k
            part = h[covered : covered + n]
            out = part if out is None else out * np.uint64(base) + part
            covered += have
        if have * 2 > k:
            return mixed(out)
        h = h[:-have] * np.uint64(base) + h[have:]
        base = base * base % (1 << 64)
        have *= 2


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest hash among ``width`` ones from each position on; of equal ones the last.

    Blocks of ``width`` positions hold running minima from both sides; a window is the end of one block and the start of the next.
    """
    n = len(h)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(blocks, width)
    index = np.arange(blocks * width).reshape(blocks, width)

    def running(values: np.ndarray, places: np.ndarray, or_equal: bool) -> np.ndarray:
        low = np.minimum.accumulate(values, axis=1)
        fresh = np.empty(values.shape, bool)
        fresh[:, 0] = True
        fresh[:, 1:] = values[:, 1:] <= low[:, :-1] if or_equal else values[:, 1:] < low[:, :-1]
        step = np.where(fresh, np.arange(values.shape[1]), 0)
        return np.take_along_axis(places, np.maximum.accumulate(step, axis=1), axis=1)

    ahead = running(grid, index, True).ravel()
    behind = running(grid[:, ::-1], index[:, ::-1], False)[:, ::-1].ravel()
    left, right = behind[: n - width + 1], ahead[width - 1 : n]
    return np.where(padded[right] <= padded[left], right, left)


def super_windows(symbols: np.ndarray, window: int, k: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: ``(key, place, first, last)``, the minimiser's hash and position and the windows' starts.

    Long sequences go block by block, which bounds the memory; a run that crosses a block's end becomes two.
    """
    none = np.empty(0, np.int64)
    parts = [(none.view(np.uint64), none, none, none)]
    for at in range(0, len(symbols) - window + 1, block):
        h = gram_hashes(symbols[at : at + block + window - 1], k)
        place = window_minima(h, window - k + 1)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        parts.append((h[place[first]], place[first] + at, first + at, last + at))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))

"""Content-chosen samples of windows: the same window gets the same sample wherever it occurs."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xBF58476D1CE4E5B9)
FINAL = np.uint64(0x94D049BB133111EB)


def scrambled(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit numbers without visible order."""
    x = (x ^ (x >> np.uint64(30))) * SPREAD
    x = (x ^ (x >> np.uint64(27))) * FINAL
    return x ^ (x >> np.uint64(31))


def rolled(symbols: np.ndarray, n: int, factor: np.uint64 = MIX) -> np.ndarray:
    """Hash of the ``n`` symbols that start at each place (64-bit numbers), in log n steps."""
    if len(symbols) < n:
        return np.zeros(0, np.uint64)
    size = len(symbols) - n + 1
    done, have, block, width, power = None, 0, symbols, 1, factor
    while True:  # binary digits of n: blocks double, the needed ones are put side by side
        if n & width:
            part = block[have : have + size]
            done = part.copy() if done is None else done * power + part
            have += width
        if width * 2 > n:
            return scrambled(done)
        block = block[:-width] * power + block[width:]
        power, width = power * power, width * 2


def lowest(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost lowest value in each run of ``w`` values."""
    at, width = np.arange(len(g)), 1
    while width < w:
        step = min(width, w - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        width += step
    return at


BLOCK = 1 << 19


def samples(symbols: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Samples of all windows of texts laid end to end.

    Returns ``(gram hash, text number, first window, number of windows, place of the gram)``: of every window the
    ``gram`` symbols with the lowest hash are taken; neighbours that take the same ones share a sample.  Windows never
    cross texts; places are counted from the start of a text.  Long texts are handled block by block, which may split
    a sample in two.
    """
    starts = np.concatenate([[0], ends[:-1]])
    text_of = np.repeat(np.arange(len(ends)), ends - starts)
    parts = []
    for at in range(0, max(0, len(symbols) - window + 1), BLOCK):
        g = rolled(symbols[at : at + BLOCK + window - 1], gram)
        pick = lowest(g, window - gram + 1)
        text = text_of[at : at + len(pick)]
        inside = np.flatnonzero(np.arange(at, at + len(pick)) + window <= ends[text])
        pick, text = pick[inside], text[inside]
        fresh = np.flatnonzero((np.diff(pick, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        own = starts[text[fresh]]
        parts.append((g[pick[fresh]], text[fresh], inside[fresh] + at - own, np.diff(np.append(fresh, len(pick))), pick[fresh] + at - own))
    if not parts:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    return tuple(map(np.concatenate, zip(*parts)))

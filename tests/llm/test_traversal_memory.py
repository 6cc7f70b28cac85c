"""What a traversal of signature trees holds at once, for bitmaps of any width."""

import tracemalloc

import numpy as np
import pytest

from tidegrid.llm import ngram_join


@pytest.mark.parametrize("width", [8, 64, 512])
def test_traversal_memory_does_not_follow_the_width(width):
    rng = np.random.default_rng(width)
    n = 256 if width == 512 else 700
    base = rng.integers(0, 1 << 62, width).astype(np.uint64)
    maps = np.repeat(base[None], n, axis=0)
    maps[np.arange(n), rng.integers(0, width, n)] ^= np.uint64(1) << rng.integers(0, 62, n).astype(np.uint64)
    sizes = np.bitwise_count(maps).sum(1).astype(np.int64)
    tracemalloc.start()
    held, found = tracemalloc.get_traced_memory()[0], 0
    for pairs in ngram_join.candidate_chunks(sizes, maps, np.arange(n), 90, exact=True):
        found += len(pairs)
    most = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert found == n * (n - 1) // 2
    assert most < 40_000_000 + 3 * maps.nbytes

"""Window minima of line hashes against a plain search."""

import random

import pytest

from milemark.llm import lines as L


def plain(own, least):
    """First line, length, hashes, place of the last smallest hash and how many lines around have fewer words than a window."""
    for a in range(len(own)):
        for b in range(a, len(own)):
            if sum(x[2] for x in own[a : b + 1]) >= least:
                hashes = [x[1] for x in own[a : b + 1]]
                left = max(n for n in range(a + 1) if n == 0 or sum(x[2] for x in own[a - n : a]) < least)
                right = max(n for n in range(len(own) - b) if n == 0 or sum(x[2] for x in own[b + 1 : b + 1 + n]) < least)
                place = max(k for k in range(a, b + 1) if own[k][1] == min(hashes))
                yield a, b - a + 1, hashes, place, left, right
                break


@pytest.mark.parametrize("least", [1, 10, 50])
def test_fingerprints(least):
    for seed in range(500):
        r = random.Random(seed)
        own = [(k, r.randrange(6), r.choice([1, 2, 5, 12, 60])) for k in range(r.randrange(30))]
        got, places = [], []
        for minimum, first, kept, windows in L.fingerprints(own, least):
            assert kept == [x[1] for x in own[first : first + len(kept)]]
            for at, size, left, right in windows:
                assert at >= left and at + size + right <= len(kept) and min(kept[at : at + size]) == minimum
                got.append((first + at, size, kept[at : at + size], left, right))
            places.append(len(windows))
        want = list(plain(own, least))
        assert got == [w[:3] + w[4:] for w in want]
        # Each place that is a minimum is given once.
        assert len(places) == len({w[3] for w in want})


def test_fewer_fingerprints_than_windows():
    r = random.Random(1)
    own = [(k, r.getrandbits(60), 5) for k in range(5000)]
    found = list(L.fingerprints(own))
    assert sum(len(f[3]) for f in found) == 4991
    # A window has ten lines; random minima change about every fifth or sixth of them.
    assert len(found) < 4991 * 0.25
    assert max(len(f[2]) for f in found) <= 10 + 9 + 2 * 9

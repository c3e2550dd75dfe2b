"""Leaks of every length with as many changes as their length allows."""

import random

import numpy as np
import pytest

from prosarium.llm import leakage


def word(rng):
    return "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))


def made(rng, part, e, kind):
    """part with e changes of single words, spread evenly, none at its ends."""
    at = {(c + 1) * len(part) // (e + 1) for c in range(e)}
    assert len(at) == e and all(0 < c < len(part) - 1 for c in at)
    out = []
    for k, w in enumerate(part):
        out += {"changed": [word(rng) + "x"], "added": [word(rng) + "x", w], "missing": []}[kind] if k in at else [w]
    return out


@pytest.mark.parametrize("n", [20, 34, 48, 50, 60, 61, 85, 110])
def test_leaks_with_one_word_in_five_changed(n):
    rng = random.Random(n)
    items = leakage.Items([0, 1], [[word(rng) for _ in range(n)] for _ in range(2)])
    m = -(-2 * n // 5)
    docs, what = [], []
    for k in [*range(m, m + 6), n]:
        for kind in ("changed", "added", "missing"):
            a = rng.randint(0, n - k)
            part = made(rng, items.words[1][a : a + k], k // 5, kind)
            docs.append([*[word(rng) for _ in range(40)], *part, *[word(rng) for _ in range(40)]])
            what.append((k, kind))
    found = {d for d, i in leakage.Scanner(items).scan(docs) if i == 1}
    assert [w for d, w in enumerate(what) if d not in found] == []


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 14, 23, 60, 77])
def test_bounds_hold_for_all_lengths(n):
    w = leakage.run_width(n)
    for k in range(max(1, -(-2 * n // 5)), n + 1):
        e = k // 5
        runs = [min(w - 1, k)] * e  # runs a window short, the rest in the last
        assert -(-(k - e) // (e + 1)) >= w
        assert max(0, k - e - sum(runs) - w + 1) >= leakage.least_hits(n)


def test_leak_beside_a_better_but_more_changed_copy():
    rng = random.Random(3)
    words = [word(rng) for _ in range(60)]
    leak = made(rng, words[:25], 5, "changed")
    copy = [word(rng) + "x" if k % 3 == 2 else w for k, w in enumerate(words)]  # one in three changed
    before, after = ([word(rng) for _ in range(40)] for _ in range(2))
    docs = [[*before, *leak, *copy, *after], [*before, *copy, *after], [*before, *leak, *after]]
    assert leakage.Scanner(leakage.Items([0], [words])).scan(docs) == [(0, 0), (2, 0)]


def holds(a, b):
    """Brute force: the fewest changes of every chain between two matches."""
    n = len(a)
    for i in range(n):
        for j in range(len(b)):
            if a[i] != b[j]:
                continue
            best = {(i, j): 0}  # fewest changes of a chain that ends with this match
            for p in range(i, n):
                for q in range(j, len(b)):
                    if a[p] == b[q]:
                        ways = [c + max(p - r, q - s) - 1 for (r, s), c in best.items() if r < p and s < q]
                        best[p, q] = min(ways + ([0] if (p, q) == (i, j) else [])) if ways or (p, q) == (i, j) else 99
                        if p - i + 1 >= 0.4 * n - 1e-9 and best[p, q] <= 0.2 * (p - i + 1) + 1e-9:
                            return True
    return False


def test_any_stretch_matches_brute_force():
    rng = random.Random(5)
    seen = []
    for _ in range(1500):
        a, b = ([rng.randint(1, rng.choice([4, 9])) for _ in range(rng.randint(1, 16))] for _ in range(2))
        want = holds(a, b)
        pair = (np.array(a, np.int32), np.array(b, np.int32))
        assert leakage._any_stretch(*pair) == want == leakage.hold_stretches([pair])[0], (a, b)
        seen.append(want)
    assert 100 < sum(seen) < 1400


def test_item_sized_windows_find_changed_leaks_by_their_radius(monkeypatch):
    """With the runs switched off the fingerprints alone find nearly all leaks with changes at random places; with radius 0, few of them."""
    rng = random.Random(9)
    items = [[word(rng) for _ in range(n)] for n in rng.choices(range(42, 189), k=40)]
    docs = []
    for i, ws in enumerate(items * 3):
        k = rng.randint(len(ws) // 2, len(ws))
        a = rng.randint(0, len(ws) - k)
        part = [word(rng) + "x" if rng.random() < 0.12 else w for w in ws[a : a + k]]
        docs.append([*[word(rng) for _ in range(30)], *part, *[word(rng) for _ in range(30)]])

    def scan(runs, radius):
        monkeypatch.setattr(leakage, "RADIUS", radius)
        known = leakage.Items(list(range(40)), items)
        if not runs:
            known.runs = {}
        return set(leakage.Scanner(known).scan(docs))

    every, sized, equal = scan(True, leakage.RADIUS), scan(False, leakage.RADIUS), scan(False, 0)
    assert sized <= every and len(sized) > 0.9 * len(every) > 90
    assert len(equal) < 0.6 * len(sized)

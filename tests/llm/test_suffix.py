"""Suffix arrays, common prefixes and maximal repeats against their definitions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm.suffix import covered, maximal_repeats, suffix_array

strings = st.lists(st.integers(0, 3), max_size=60)


@settings(deadline=None, max_examples=150)
@given(strings)
def test_suffix_array(s):
    sa, common = suffix_array(np.array(s, np.int64))
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    for i in range(1, len(s)):
        a, b = s[sa[i - 1] :], s[sa[i] :]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[i] == n


@settings(deadline=None, max_examples=150)
@given(strings, st.integers(1, 4))
def test_maximal_repeats(s, least):
    sa, common = suffix_array(np.array(s, np.int64))
    got = {(n, tuple(sorted(sa[a:b].tolist()))) for n, a, b in maximal_repeats(sa, common, np.array([-1, *s[:-1]] if s else [], np.int64), least)}
    where = {}
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            where.setdefault(tuple(s[i:j]), []).append(i)
    want = set()
    for u, at in where.items():
        left = {s[i - 1] if i else None for i in at}
        right = {s[i + len(u)] if i + len(u) < len(s) else None for i in at}
        if len(at) > 1 and len(u) >= least and len(left) > 1 and len(right) > 1:
            want.add((len(u), tuple(at)))
    assert got == want


def test_covered():
    assert covered(np.array([1, 2]), np.array([3, 4]), 6).tolist() == [False, True, True, True, False, False]
    assert covered(np.zeros(0, int), np.zeros(0, int), 0).tolist() == []

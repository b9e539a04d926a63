import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from registrum.llm.run_index import RunIndex


def joined(pieces):
    return [(k, i, p[i:]) for k, p in enumerate(pieces) for i in range(len(p))]


def shared(a, b):
    return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


texts = st.binary(max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b))
index_of = lambda pieces: RunIndex([np.frombuffer(p, np.uint8) for p in pieces])


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=6))
def test_statistics_are_longest_matches(pieces):
    index, places = index_of(pieces), joined(pieces)
    found = index.statistics()
    for k, i, rest in places:
        assert found[index.starts[k] + i] == max((shared(rest, other) for n, j, other in places if (n, j) != (k, i)), default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=6), st.integers(1, 8))
def test_late_are_all_but_the_first(pieces, length):
    index, seen, want = index_of(pieces), set(), []
    for k, i, rest in joined(pieces):
        if len(rest) >= length:
            if rest[:length] in seen:
                want.append(index.starts[k] + i)
            seen.add(rest[:length])
    assert index.late(length).tolist() == want


def test_the_index_grows_with_the_runs():
    """Ten times the text, by slightly changed copies, takes little more than the text once."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 20_000).astype(np.uint8)
    copies = [base.copy() for _ in range(10)]
    for c in copies:
        c[rng.integers(0, len(c), 5)] = 32
    one, ten, fresh = RunIndex([base]).stored, RunIndex(copies).stored, RunIndex([rng.integers(97, 123, 20_000).astype(np.uint8) for _ in range(10)]).stored
    assert ten < 1.2 * one and fresh > 8 * one

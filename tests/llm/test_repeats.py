import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from registrum.llm import repeats as R
from registrum.llm.run_index import RunIndex


def brute(rows):
    first, texts = {}, {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t or "")
    torn = {None} | {d for d, x in texts.items() if len(x) > 1}
    for d, t in sorted({(d, t) for d, t in rows if d not in torn}, key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - R.LENGTH + 1):
            first.setdefault(b[i : i + R.LENGTH], (d, i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - R.LENGTH + 1) if d not in torn else ():
            if first[b[i : i + R.LENGTH]] != (d, i):
                gone[i + 1 : i + 1 + R.LENGTH] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        gone = gone[1:-1]
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage, line, half = text(300), text(120), text(70)
    rows = [(k, text(int(rng.integers(0, 400)))) for k in range(20)]
    rows += [(20 + k, text(150) + passage[k * 9 :] + text(50)) for k in range(12)]
    rows += [(40 + k, text(90) + line + text(90) + line + text(30)) for k in range(10)]
    rows += [(60 + k, passage[:99]) for k in range(3)] + [(70 + k, passage[:100]) for k in range(3)]
    rows += [(80, "the " * 100), (81, "x" * 150), (82, "x" * 99), (83, half + half), (84, None), (85, ""), (86, passage), (86, passage), (87, "ab" * 300), (None, passage), (-5, passage + line), (90, passage + half), (90, line + half), (91, passage), (91, passage)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"hot": 3}, {"hot": 1, "bucket": 500}, {"bucket": 2000}])
def test_equals_brute_force(spark, sizes):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    got = R.cut(R.marked(docs, **sizes)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert all(r.left_text == (r.kept.decode(errors="ignore") if r.n_removed else None) for r in got)


def test_nothing_to_remove(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "y" * 120)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in R.digests(docs).collect()) == [(1, 0, 0), (2, 119, 1)]
    assert R.digests(docs.limit(0)).collect() == []


def test_segments_cover_every_window_once():
    t = b"".join(bytes([97 + i * i % 7]) for i in range(1000))
    at = np.array([0, 50, 50, 400, 1000])
    row, start, many, _, _ = R.segments(np.frombuffer(t, np.uint8), at)
    got = sorted((r, s + k) for r, s, n in zip(row, start, many, strict=True) for k in range(n))
    assert got == [(2, i) for i in range(350 - 99)] + [(3, i) for i in range(600 - 99)] and many.max() <= R.LENGTH - R.SEED + 1


def test_the_index_decides(spark, monkeypatch):
    """Without its links, only segments that are equal in whole are found."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(RunIndex, "late", lambda self, length: np.zeros(0, np.int64))
    assert sum(r.n_removed for r in R.digests(docs).collect()) < sum(x[2] for x in brute(rows))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=100, max_size=240).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=4), st.sampled_from(R.NARROW))
def test_narrower_segments_keep_every_window_and_equal_ones_together(texts, width):
    at = np.cumsum([0, *map(len, texts)])
    row, start, many, anchor, _ = R.segments(np.frombuffer(b"".join(texts), np.uint8), at)
    pieces = [texts[r][s : s + n + R.LENGTH - 1] for r, s, n in zip(row, start, many, strict=True)]
    part, first, runs, key, _ = R.narrower(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]), anchor, width)
    assert runs.max() <= width and sorted((p, f + k) for p, f, n in zip(part, first, runs, strict=True) for k in range(n)) == [(p, w) for p, n in enumerate(many) for w in range(n)]
    keys = {}
    for p, f, n, k in zip(part, first, runs, key, strict=True):
        for w in range(f, f + n):
            assert keys.setdefault(pieces[p][w : w + R.LENGTH], k) == k

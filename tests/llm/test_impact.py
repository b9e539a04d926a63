import math

import numpy as np
import pytest

from registrum.llm.impact import Index, searched


def brute(rows, k, every):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in fine}:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"candidates": 40}])
def test_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=6) * (0.1 if i % 3 else 0.001))]) for i in range(230)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, rows[7][1]), (350, None), (400, [None, 1.0]), (450, [math.nan] * 6), (500, [math.inf] + [0.0] * 5), (None, [0.1] * 6), (550, [0.5, -0.5]), (600, []), (0, rows[0][1]), (0, rows[0][1]), (100, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert sorted(tuple(r) for r in searched(df, every=50, **sizes).collect()) == brute(rows, 5, 50)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in searched(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert searched(df.limit(0)).collect() == [] and searched(df.where("vec_id = 1")).collect() == []


def test_proof_stops_early_and_exactly():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(size=(3000, 16)) * 40).astype(np.int64)
    vectors[:10] *= 6
    index = Index(np.arange(3000), vectors)
    for q in range(0, 3000, 97):
        ids, scores = index.best(vectors[q], q, 5)
        full = vectors @ vectors[q]
        want = sorted((-s, i) for i, s in enumerate(full) if i != q)[:5]
        assert [(-s, i) for i, s in zip(ids, scores, strict=True)] == want


def test_a_repeated_query_is_answered_once(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(i, [i / 10, 0.5]) for i in range(1, 8)]
    got = sorted(tuple(r) for r in searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert [(q, r, i) for q, r, i, _ in got] == [(0, n, 8 - n) for n in range(1, 6)]

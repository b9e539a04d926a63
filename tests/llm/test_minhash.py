import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from registrum.llm import minhash as M
from registrum.llm.graph import components


def brute(rows, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root[i]] = min(low.get(root[i], d), d)
    return sorted((d, len(sets[i]), low[root[i]], low[root[i]] == d) for i, (d, _) in enumerate(rows))


def corpus():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    rows, n = [], 0
    for size in (1, 2, 5, 40):
        base = [word() for _ in range(160)]
        for _ in range(size):
            copy = list(base)
            for p in rng.integers(0, 160, rng.integers(0, 6)):
                copy[p] = word()
            rows.append((n := n + 1, " ".join(copy)))
    chain = [word() for _ in range(300)]
    rows += [(n + 1 + k, " ".join(chain[6 * k : 6 * k + 200])) for k in range(12)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one  TWO"), (905, "two one"), (906, "a b c d e"), (907, "É b c d e"), (908, "é b c d e"), (909, rows[3][1]), (909, rows[3][1]), (3, "z " * 9)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"broadcast": 0, "block_signatures": 7, "block_sets": 5}, {"percent": 80}])
def test_equals_brute_force(spark, sizes):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(4)
    assert sorted(tuple(r) for r in M.linked(docs, **sizes).drop("mark").collect()) == brute(rows, sizes.get("percent", 85))


def test_rows_without_an_id_and_texts_of_one_id(spark):
    a, near, b = "one two three four five six", " ".join(f"w{k}" for k in range(60)), "six five four three two one"
    rows = [(5, a), (None, a), (None, "unlike all of the others here"), (5, near), (3, near + " more"), (7, a), (8, b), (None, None)]
    got = sorted(((r.doc_id, r.mark, r.component_id, r.kept) for r in M.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    mark = {t: m for t, m in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", M.mark_of(F.col("text"))).collect()}
    want = [(5, mark[a], 5, True), (None, mark[a], 5, True), (None, mark[rows[2][1]], None, True), (5, mark[near], 3, False), (3, mark[rows[4][1]], 3, True), (7, mark[a], 5, False), (8, mark[b], 8, True), (None, mark[None], None, True)]
    assert got == sorted(want, key=str)
    with pytest.raises(ValueError):
        M.linked(spark.createDataFrame(rows, "doc_id long, text string"), percent=60)


@pytest.mark.parametrize("spread", [30, 90, 400])
def test_groups_beyond_a_block_lose_no_link(spark, spread):
    """Groups of any make: mostly one component, a few, or hardly any links at all."""
    rng = np.random.default_rng(spread)
    values = {n: (int(n % 3), int(v)) for n, v in enumerate(rng.integers(0, spread, 90))}
    sizes = [sum(g == k for g, _ in values.values()) for k in range(3)]
    rows = spark.createDataFrame([(g, n, sizes[g], v) for n, (g, v) in values.items()], "key long, node long, size long, v long")

    def compare(table):
        nodes, v = table.column("node").to_numpy(), table.column("v").to_numpy()
        return M._edges(nodes, M._forest(len(nodes), lambda i, left: np.abs(v[left] - v[i]) <= 1))

    root = {n: n for n in values}
    for a in values:
        for b in values:
            if values[a][0] == values[b][0] and abs(values[a][1] - values[b][1]) <= 1:
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
    tied, _ = M._connected(rows, "key", 4, compare, True)
    assert {r.node: r.root for r in tied.collect()} == {n: r for n, r in root.items() if n != r}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.linked(docs).collect() == []


def test_keys_are_shared_under_the_distance():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (2, M.CHUNKS * M.SYMBOLS)).astype(np.uint16)
    for _ in range(200):
        sig[1] = sig[0]
        sig[1][rng.permutation(sig.shape[1])[: 2 * M.CHUNKS - 1]] ^= np.uint16(1)
        made = M.keys(sig)
        assert (made[0] == made[1]).any()


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (12, 11), (7, 7), (20, 21), (21, 22), (22, 20), (-1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 11: 10, 12: 10, 21: 20, 22: 20, 30: -1}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

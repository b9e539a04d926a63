import re
from itertools import combinations

import pytest

from registrum.llm.spaced_seeds import MASKS, SUBSTITUTIONS, WINDOW, clean, found

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ITEMS = [(1, ITEM), (2, "a short item"), (3, None), (4, "!!"), (5, "alpha beta gamma delta epsilon zeta eta theta iota"), (6, "the the the the the the the the the the")]


def changed(*places):
    w = ITEM.split()
    for p in places:
        w[p] = f"x{p}"
    return " ".join(w)


DOCS = [
    (0, None), (1, ""), (2, "Intro. " + ITEM.upper() + "!! End."), (3, changed(3, 9) + " tail"), (4, "pre " + changed(0, 1, 2, 7, 8)), (5, changed(1, 3, 5, 7, 9, 11, 13)),
    (6, "This is A SHORT, item."), (7, "a short x item"), (8, "alpha beta gamma delta epsilon zeta eta theta iota"), (9, "alpha x gamma delta epsilon zeta eta theta iota"),
    (10, "the " * 3000), (2, "other text with the same id"), (11, ITEM), (11, ITEM), (12, "three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (None, ITEM),
]


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute():
    out = {}
    for d, t in DOCS:
        for i, u in ITEMS:
            a, b = words(t), words(u)
            w = min(WINDOW, len(b))
            for shift in range(-len(b), len(a)) if b else ():
                same = [0 <= shift + k < len(a) and a[shift + k] == x for k, x in enumerate(b)]
                most = max(sum(same[s : s + w]) for s in range(len(b) - w + 1))
                if most >= w - (SUBSTITUTIONS if w == WINDOW else 0) and d is not None:
                    out[d, i] = max(out.get((d, i), (0, 0)), (most, sum(same) / len(b)))
    return out


def test_masks_hit_every_window():
    for gone in combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(all(at + k not in gone for k, c in enumerate(m) if c == "1") for m in MASKS for at in range(WINDOW - len(m) + 1))


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_equals_brute_force(spark, broadcast):
    docs = spark.createDataFrame([(*d, "c") for d in DOCS], "doc_id long, text string, item_id string").repartition(3)
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.matched, r.share) for r in found(docs, items, broadcast=broadcast).collect()}
    assert got == brute()
    assert {(2, 1), (3, 1), (4, 1), (6, 2), (8, 5), (10, 6), (12, 1)} <= set(got) and not {(5, 1), (7, 2), (9, 5)} & set(got)


def test_clean_and_empty(spark):
    docs = spark.createDataFrame([d for d in DOCS if d[0] is not None], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.text) for r in clean(docs, items).collect()} == {d for d in DOCS if d[0] in (0, 1, 5, 7, 9) or d[1] == "other text with the same id"}
    assert found(docs.limit(0), items).collect() == [] and found(docs, items.limit(0)).collect() == []
    assert clean(docs, items.limit(0)).count() == len(DOCS) - 1


def test_clean_checks_rows_without_an_id(spark):
    docs = spark.createDataFrame([*DOCS, (None, "clean text"), (None, None), (None, "pre " + ITEM)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r.doc_id, r.text) for r in clean(docs, items).collect()]
    assert {d for d, _ in got if d is not None} == {0, 1, 2, 5, 7, 9}
    assert sorted(str(t) for d, t in got if d is None) == ["None", "clean text"]


def test_clean_judges_rows_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, "pre " + ITEM, "x"), (1, "clean text", "y"), (1, "clean text", "z")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(r.item_id for r in clean(docs, items).collect()) == ["y", "z"]

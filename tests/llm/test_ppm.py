import math

import numpy as np

from pyspark.sql import functions as F

from registrum.llm.ppm import Model, identify, predicted, sample


def brute(train: list[bytes], text: bytes, order: int = 4) -> float:
    trees: list[dict] = [{} for _ in range(order + 1)]
    for s in train:
        for i in range(len(s)):
            for k in range(min(i, order) + 1):
                node = trees[k].setdefault(s[i - k : i], {})
                node[s[i]] = node.get(s[i], 0) + 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(i, order), -1, -1):
            if node := trees[k].get(text[i - k : i]):
                n = sum(node.values())
                if text[i] in node:
                    bits -= math.log2(node[text[i]] / (n + len(node)))
                    break
                bits -= math.log2(len(node) / (n + len(node)))
        else:
            bits += 8
    return bits


TRAIN = {"aa": [b"the cat sat on the mat", b"the hat of the cat", b"x"], "bb": ["le chat était là, où le rat".encode(), b"la la le"]}
TEXTS = [b"", b"the cat", "le rat était".encode(), b"zzqq the \xf0\x9f", b"t" * 50, b"la"]


def test_code_lengths_equal_brute_force(monkeypatch):
    model = Model(TRAIN)
    at = np.concatenate([[0], np.cumsum([len(t) for t in TEXTS])])
    data = np.frombuffer(b"".join(TEXTS), np.uint8)
    want = [[brute(TRAIN[lang], t) for lang in model.langs] for t in TEXTS]
    assert np.allclose(model.lengths(data, at), want, atol=1e-3)
    monkeypatch.setattr("registrum.llm.ppm.CHUNK", 3)  # long texts go piece by piece
    assert np.allclose(model.lengths(data, at), want, atol=1e-3)


def test_rows_nulls_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(i, ["the cat sat on the mat", "le chat est sur le tapis"][i % 2], "ef"[i % 2], 1) for i in range(60)]
    rows += [(100, None, "e", 1), (101, "", "e", 1), (102, "12 !!", "e", 1), (None, "the cat", "e", 1), (3, "le chat", None, 1), (3, "le chat", None, 1)]
    out = predicted(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[4].lang_pred == "e" and got[5].lang_pred == "f" and got[None].lang_pred == "e" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in out)
    empty = predicted(spark.createDataFrame([], schema))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_no_labels_is_undetermined(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [tuple(r) for r in identify(docs, Model({})).collect()] == [(1, "und", 0.0)]


def test_a_text_repeated_many_times_silences_no_language(spark):
    labelled = [(i, f"the cat sat on mat number {i} and slept", "en") for i in range(50)] + [(100 + i, f"der hund lief zum haus nummer {i} und schlief", "de") for i in range(50)]
    docs = spark.createDataFrame([*labelled, *[labelled[7]] * 30_000], "doc_id long, text string, lang string")
    got = sample(docs, F.lit(True), per_lang=20)
    assert {k: len(set(v)) for k, v in got.items()} == {"en": 20, "de": 20}
    assert set(sample(docs.withColumn("lang", F.col("doc_id").cast("string")), F.lit(True), langs=3)) == set(sorted(str(d) for d, *_ in labelled)[:3])

import re
from itertools import combinations

import numpy as np
import public_tokenizers
from sentencepiece import SentencePieceProcessor

import corpus_pipeline as P
from registrum.llm import rule_ensemble, spaced_seeds
from registrum.llm.rule_ensemble import statistics


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_run(spark, tmp_path):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijé"), 5))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(30), text(60)
    rows = [(i, f"{text(60)} {i}", "en", 1) for i in range(60)]
    rows += [(100 + i, ("BUY NOW!! " * (10 + i)) + str(i), "en", 1) for i in range(30)]
    rows += [(200, rows[3][1], "en", 1), (201, rows[4][1].replace(" ", "  ", 3), "fr", 1), (202, f"{text(9)} {item} {text(9)}", "en", 1)]
    rows += [(300 + i, f"{text(40)} {passage} {text(40)}", "en", 1) for i in range(3)]
    rows += [(400, None, "en", 1), (None, text(50), None, None)]
    folder = str(tmp_path)
    write(spark, folder, "documents", rows, "doc_id long, text string, lang string, score int")
    write(spark, folder, "labels", [(i, int(i < 100), 0) for i, *_ in rows if i is not None and i < 130], "doc_id long, quality int, toxic int")
    write(spark, folder, "benchmark", [(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in P.run(spark, folder).collect()}
    assert {*range(60), 300, 301, 302, None} <= set(got) <= {*range(60), 300, 301, 302, 400, None}
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {i: t for i, t, *_ in rows}
    for i in (5, 300, None):
        assert got[i].ids == library.encode(texts[i], add_bos=True, add_eos=True) and got[i].n_tokens == len(got[i].ids)
    b = texts[301].encode()
    at = texts[301].index(passage)
    left = library.decode(got[301].ids)
    assert left.startswith(texts[301][: at - 1]) and texts[301][at + len(passage) + 2 :] in left and len(left) <= len(texts[301]) - len(passage) and len(b) > len(left)


def brute(rows, items, model):
    """All stages over rows (doc_id, text), in plain Python: ids and token ids of the rows that stay."""
    encoded = [(t or "").encode() for _, t in rows]
    scores = model.score(statistics(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)])))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]

    rows = [r for k, r in enumerate(rows) if r[0] is None or r not in rows[:k]]
    known = sorted({r for r in rows if r[0] is not None}, key=str)
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in known]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    root = list(range(len(known)))
    for i, j in combinations(range(len(known)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= P.SIMILAR * len(sets[i] | sets[j]):
            root = [root[i] if r == root[j] else r for r in root]
    low = {k: min(known[i][0] for i in range(len(known)) if root[i] == k) for k in root}
    gone = {known[i] for i in range(len(known)) if sets[i] and known[i][0] != low[root[i]]}
    rows = [r for r in rows if r not in gone]

    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t or "")
    whole = {d for d, x in texts.items() if d is None or len(x) > 1}
    seen, left = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - 99) if d not in whole else ():
            if b[i : i + 100] in seen:
                cut[i : i + 100] = True
            seen.add(b[i : i + 100])
        if not cut.any():
            left.append((d, t))
        elif rest := bytes(x for x, c in zip(b, cut, strict=True) if not c).decode(errors="ignore"):
            if rest.strip(" "):
                left.append((d, rest))

    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def holds(a, b):
        w = min(spaced_seeds.WINDOW, len(b))
        for shift in range(-len(b), len(a)) if b else ():
            same = [0 <= shift + k < len(a) and a[shift + k] == x for k, x in enumerate(b)]
            if any(sum(same[s : s + w]) >= w - (spaced_seeds.SUBSTITUTIONS if w == spaced_seeds.WINDOW else 0) for s in range(len(b) - w + 1)):
                return True
        return False

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return sorted(((d, library.encode(t or "", add_bos=True, add_eos=True)) for d, t in left if not any(holds(tokens(t), tokens(i)) for i in items)), key=str)


def test_run_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijé�"), 5))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(30), text(60)
    rows = [(i, f"{text(60)} {i}", "en", 1) for i in range(40)]
    rows += [(100 + i, ("BUY NOW!! " * (10 + i)) + str(i), "en", 1) for i in range(30)]
    twin = rows[5][1].split()
    twin[7] = "other"
    rows += [(200, rows[3][1], "en", 1), (201, " ".join(twin), "fr", 1), (202, f"{text(9)} {item} {text(9)}", "en", 1), (203, passage, "en", 1)]
    rows += [(300 + i, f"{text(40)}{passage[i:]}{text(40)}", "en", 1) for i in range(3)]
    rows += [(400, None, "en", 1), (None, text(50), None, None), (None, f"{item} tail", None, None), (7, rows[7][1], "en", 1), (8, text(50), "en", 1), (9, rows[2][1], "en", 1), (-1, rows[11][1], "en", 1)]
    folder = str(tmp_path)
    write(spark, folder, "documents", rows, "doc_id long, text string, lang string, score int")
    write(spark, folder, "labels", [(i, int(i < 100), 0) for i, *_ in rows if i is not None and i < 130], "doc_id long, quality int, toxic int")
    write(spark, folder, "benchmark", [(1, item)], "item_id long, text string")
    model = rule_ensemble.learned(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    got = sorted(((r.doc_id, r.ids) for r in P.run(spark, folder).collect()), key=str)
    want = brute([r[:2] for r in rows], [item], model)
    assert [d for d, _ in got] == [d for d, _ in want] and got == want
    assert {202, 200, 201, 11, 100} & {d for d, _ in got} == set() and {-1, 8, 9, 300, 301, 302} <= {d for d, _ in got}


def test_an_id_with_two_texts_loses_only_the_near_one(spark, tmp_path):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = spark.createDataFrame([(5, a), (5, b), (3, f"{b} end"), (7, f"{a} end")], "doc_id long, text string")
    assert sorted(tuple(r) for r in P.near_duplicates(spark, docs, str(tmp_path)).collect()) == [(3, f"{b} end"), (5, a)]


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, node long, start int, predicted string, `a.b` int"
    write(spark, folder, "documents", [(1, "one two three four five six", "en", 1, 1, "x", 2), (1, "one two three four five six", "en", 1, 1, "x", 2), (2, None, None, None, None, None, None)], schema)
    write(spark, folder, "labels", [], "doc_id long, quality int, toxic int")
    write(spark, folder, "benchmark", [], "item_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), folder).collect() == [], name
        assert out.count() == (2 if name == "near_duplicates" else 3), name
    assert P.encoded(spark, docs, folder).count() == 3 and spaced_seeds.WINDOW == 13

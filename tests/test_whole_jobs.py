"""Registered queries on small tables of their own, against brute force: what a cut of the input would lose."""

import difflib
import random

from pyspark.sql import functions as F

from registrum.operators import linkage
from registrum.operators.needles import found
from registrum.plans import catalogue
from registrum.sources import bulk


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_keys_of_two_to_eight_members_connect(spark, tmp_path):
    # Key k of the first family has k members; the second family has no key of two members.
    rows, at = [], 0
    for k in range(1, 12):
        for _ in range(k):
            at += 1
            rows.append((at, f"n{at}", f"B{k}", "T", 7, 1000.0 + 10 * at))
    write(spark, tmp_path, "part", rows, PART)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r[0])
    want = {(n, min(g)) for g in groups.values() if 2 <= len(g) <= 8 for n in g}
    assert {tuple(r) for r in catalogue.queries()["connected_components"](spark, str(tmp_path)).collect()} == want
    assert sorted(r.members for r in catalogue.queries()["operator_rollup"](spark, str(tmp_path)).collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_misspelled_words_of_every_language_and_of_two_edits(spark, tmp_path):
    rows = [(1, "garden " * 20, "de"), (2, "garden " * 4 + "gardem gardens", "fr"), (3, "garden proffesional managements", None), (4, "anchors proffessionnal acadmy", "en")]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    got = {(r.word, r.likely, r.frequency) for r in catalogue.queries()["misspelled_words"](spark, str(tmp_path)).collect()}
    # No language alone has "garden" 25 times; "gardens" and "managements" are plurals; "academy" is a seed that occurs nowhere.
    assert got == {("GARDEM", "GARDEN", 25), ("PROFFESIONAL", "PROFESSIONAL", 0), ("PROFFESSIONNAL", "PROFESSIONAL", 0), ("ACADMY", "ACADEMY", 0)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_pairs_compare_whole_texts_that_share_a_word(spark, tmp_path):
    base = " ".join(f"w{k:02}" for k in range(40)) + " shared"
    texts = {1: base, 2: "Zz" + base, 3: base + " tail", 4: base + " a far longer other end of it", 5: base.replace("shared", "other"), 6: "é" + base[1:], 7: "shared again shared", 8: "again shared again", 9: None, 10: "shared", 11: "a b c d e f", 12: "a b c d g", 13: "h i", 14: "h i"}
    rows = [(i, t, None if i < 3 else "en" if i < 5 else "fr") for i, t in texts.items()]
    rows += [(100 + i, "common words", "en") for i in range(41)]  # two words in more than 40 rows
    docs = spark.createDataFrame(rows, "uid long, text string, lang string").withColumn("block", F.concat("lang", F.left("text", F.lit(8))))
    lang = {i: x for i, _, x in rows}
    keys = {i: {*(w for w in t.split() if len(w) > 4), ("text", t), ("block", lang[i] or i, t[:8])} for i, t in texts.items() if t}
    met = [(i, j) for i in keys for j in keys if i < j and keys[i] & keys[j]]
    want = {(i, j, e) for i, j in met if (e := edits(texts[i], texts[j])) <= 8}
    pairs = linkage.blocked_pairs(docs, F.expr("abs(n - n2) <= 8")).withColumn("edits", F.levenshtein("text", "text2", 8)).where("edits >= 0").select("uid", "uid2", "edits")
    assert {tuple(r) for r in pairs.collect()} == want >= {(1, 2, 2), (1, 3, 5), (2, 6, 3), (11, 12, 3), (13, 14, 0)}
    alike = lambda a, b: 1.0 if set(a.split()) == set(b.split()) else difflib.SequenceMatcher(None, a, b).ratio()
    want = {(i, j, round(r, 6)) for i, j in met if (r := alike(texts[i], texts[j])) >= 0.9}
    near = F.expr("20 * least(n, n2) >= 9 * (n + n2) or same = same2")
    pairs = linkage.blocked_pairs(docs, near).withColumn("ratio", linkage.ratio("text", "text2", 0.9)).where("ratio >= 0.9").select("uid", "uid2", F.round("ratio", 6))
    assert {tuple(r) for r in pairs.collect()} == want >= {(7, 8, 1.0)}


def test_fuzzy_ratio_against_brute_force(spark, tmp_path):
    rows = [(k, f"Customer {k}", k % 25, 1.5, "AUTO") for k in range(60)]
    write(spark, tmp_path, "customer", rows, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")
    keys = {k: f"HARBOR{k // 5:06} " + ("LIGHT SERVICES", "LIGHTS SERVICES", "LITE SERVICES", "COUNSEL", "SERVICES LIGHT")[k % 5] for k in range(60)}
    blocks = {}
    for k, t in keys.items():
        for w in set(t.split()):
            if len(w) >= 5:
                blocks.setdefault(w, set()).add(k)
    met = {(i, j) for b in blocks.values() if 2 <= len(b) <= 40 for i in b for j in b if i < j and keys[i] != keys[j]}
    alike = lambda a, b: 1.0 if set(a.split()) == set(b.split()) else difflib.SequenceMatcher(None, a, b).ratio()
    want = {(i, j, round(r, 6)) for i, j in met if (r := alike(keys[i], keys[j])) >= 0.9}
    assert {tuple(r) for r in catalogue.queries()["fuzzy_ratio"](spark, str(tmp_path)).collect()} == want and len(want) > 30


def test_needles_of_any_size_meet_texts_without_a_product(spark):
    draw = random.Random(3)
    words = ["alpha", "beta", "gam", "a", "ab", "deltas", "é", "common"]
    texts = [(k, " ".join(draw.choice(words) for _ in range(draw.randrange(12))) + (" common" if k % 2 else "")) for k in range(300)] + [(999, None), (998, ""), (5, "alpha alpha"), (997, "x" * 50_000 + " tail end")]
    needles = [(k, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 5)))[draw.randrange(3) :]) for k in range(120)] + [(500, ""), (501, None), (502, "common"), (503, " "), (504, "a  b"), (505, "nowhere at all"), (506, "x tail en"), (507, "alpha"), (508, "alpha")]
    want = {(u, i) for u, t in texts for i, n in needles if t is not None and n and n in t}
    found = linkage.containing(spark.createDataFrame(texts, "uid long, text string"), spark.createDataFrame(needles, "item_id long, needle string"))
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert linkage.containing(spark.createDataFrame(texts, "uid long, text string"), spark.createDataFrame([], "item_id long, needle string")).count() == 0


def test_a_key_of_ten_thousand_windows_costs_its_output(spark):
    day = lambda n: F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd")
    rows = spark.range(10_000).select(F.lit(1).alias("key"), F.col("id").alias("uid"), day(F.col("id") * 3).alias("start"), day(F.col("id") * 3 + 1).alias("end"))
    other = spark.range(10_000).select(F.lit(1).alias("key"), F.col("id").alias("item"), day(F.col("id") * 3 + 1).alias("start"), day(F.col("id") * 3 + 2).alias("end"))
    met = linkage.overlapping(rows, other, "key")
    assert met.where("uid = item").count() == 10_000 == met.count()


def test_windows_equal_brute_force(spark):
    draw = random.Random(8)
    day = lambda: draw.choice(["2000-01-01", "2000-01-02", "2000-03-01", "2001-01-01", "2005-06-30", None])
    make = lambda n: [(draw.choice([1, 2, None]), k, day(), day()) for k in range(n)]
    left, right = make(120), make(120)
    far = "9999-12-31"
    want = {(a[1], b[1]) for a in left for b in right if a[0] is not None and a[0] == b[0] and a[2] and b[2] and a[2] <= (b[3] or far) and (a[3] or far) >= b[2]}
    got = linkage.overlapping(spark.createDataFrame(left, "key int, uid int, start string, end string"), spark.createDataFrame(right, "key int, item int, start string, end string"), "key").select("uid", "item").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_two_thousand_names_against_brute_force(spark):
    draw = random.Random(12)
    parts = ["HARBOR", "LIGHTS", "MEADOW", "QUILTS", "TIMBER", "CEDARS", "OTTERS", "FENLAND"]
    names, base = [], ""
    for k in range(2000):
        base = f"{draw.choice(parts)}{k // 6:04} {draw.choice(parts)} {draw.choice(parts)}" if k % 6 == 0 else base
        name = base + draw.choice(["", "S", " TWO", " É", f" {draw.choice(parts)}"])
        if k % 3 == 0:
            at = draw.randrange(len(name))
            name = name[:at] + draw.choice("ABCXYZ 09") + name[at + draw.randrange(2) :]
        names.append((k, name))
    rows = spark.createDataFrame(names, "uid long, name string")
    every = linkage.name_pairs(rows, F.lit(True)).collect()
    alike = lambda a, b: 1.0 if set(a.split()) == set(b.split()) else difflib.SequenceMatcher(None, a, b).ratio()
    want = {(r.uid, r.uid2, ratio) for r in every if (ratio := alike(r.text, r.text2)) >= 0.9}
    assert {tuple(r) for r in linkage.near_names(rows).collect()} == want and len(want) > 100
    assert linkage.near_pairs(rows).count() < 0.4 * len(every)  # what Python gets to see


def test_needles_of_two_words_have_one_key(spark):
    # Numbered names share nearly all runs of four characters; the two words with their blank are one key, and a text has one such key a blank.
    names = [f"CUSTOMER {k:09d}" for k in range(300)]
    needles = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "item_id long, needle string")
    texts = spark.createDataFrame([(k, f"OWNER OF X{n}1 PLEADS") for k, n in enumerate(names)], "uid long, text string")
    own, keys = linkage.needle_keys(needles)
    assert {len(r[0]) for r in own.select("keys").collect()} == {1}
    assert {len(r[0]) for r in texts.select(F.concat(*keys)).collect()} == {1}
    assert {tuple(r) for r in linkage.containing(texts, needles).collect()} == {(k, k) for k in range(300)}


def test_needles_of_two_words_of_many_lengths(spark):
    # More pairs of lengths than are told apart: the keys hold the words' ends only, and the whole needle decides.
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abé𝄞\n") for _ in range(draw.choice([1, 1, 2, 3, 5, 9, 17, 40])))
    needles = [(k, f"{word()} {word()}") for k in range(200)] + [(900, " a"), (901, "a "), (902, " "), (903, "a")]
    texts = [(k, " ".join(word() for _ in range(6)) + draw.choice(["", " ", "b"]) + draw.choice(needles)[1] + draw.choice(["", " ", "é"])) for k in range(150)] + [(999, None), (998, "")]
    found = linkage.containing(spark.createDataFrame(texts, "uid long, text string"), spark.createDataFrame(needles, "item_id long, needle string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((u, i) for u, t in texts for i, n in needles if t and n in t)


def test_items_of_a_key_and_url_are_one_before_they_meet(spark):
    entities = spark.range(40).selectExpr("concat('u', id % 30) as uid", "cast(null as string) as credential", "'17' as npi", "'Ann Smith' as name")
    items = spark.range(400).selectExpr("if(id % 4 = 3, null, concat('x', id % 4)) as url", "if(id % 7 = 0, null, concat('t', id % 9)) as title", "concat('d', id % 5) as date", "'news' as kind", "cast(null as string) as credential", "if(id % 2 = 0, '17', null) as npi", "'ANN SMITH' as name")
    links = bulk.context_links(entities, items)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3 and plan.index("Join") < plan.rindex("Aggregate")  # both sides are made single below the join
    best = {}
    for r in items.collect():
        for rank, via, key in ((1, "NPI", r.npi), (2, "name", r.name)):
            if key:
                value = (rank, via, *((x is not None, x) for x in (r.title, r.date, r.kind)))
                best[r.url] = min(best.get(r.url, value), value)
    assert {tuple(r) for r in links.collect()} == {(f"u{u}", url, *(x[1] for x in b[2:]), b[1]) for u in range(30) for url, b in best.items()}
    assert links.count() == 30 * len(best)


def shuffled(spark, run):
    """What run() gives, and the bytes that its stages shuffled."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        seq = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
        return [seq.apply(k) for k in range(seq.size())]

    before = {(s.stageId(), s.attemptId()) for s in stages()}
    out = run()
    return out, sum(s.shuffleWriteBytes() for s in stages() if (s.stageId(), s.attemptId()) not in before)


def test_needles_shuffle_their_hits_and_no_pieces_of_texts(spark, tmp_path):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 9)))
    texts = [(k, " ".join(word() for _ in range(1500))) for k in range(200)]
    needles = [(k, word()) for k in range(40)] + [(100 + k, f"{word()} {word()}") for k in range(20)] + [(200 + k, texts[k][1][50:250]) for k in range(20)]
    spark.createDataFrame(texts, "uid long, text string").write.parquet(f"{tmp_path}/texts")
    found = lambda: {tuple(r) for r in linkage.containing(spark.read.parquet(f"{tmp_path}/texts"), spark.createDataFrame(needles, "item_id long, needle string")).collect()}
    got, size = shuffled(spark, found)
    assert got == {(u, i) for u, t in texts for i, n in needles if n in t}
    assert size < 0.2 * sum(len(t) for _, t in texts)


def test_needles_of_any_length_at_the_edges_of_texts(spark):
    draw = random.Random(9)
    make = lambda n: "".join(draw.choice("abé𝄞\0 ") for _ in range(n))
    base = make(30_000)
    sizes = [*range(1, 40), 63, 64, 65, 127, 128, 129, 1000, 4095, 4096, 4097, 8191, 8192, 9000, 20_000]
    needles = [(n, base[(a := draw.randrange(len(base) - n)) : a + n]) for n in sizes] + [(-n, base[:n]) for n in sizes] + [(1000 + n, base[-n:]) for n in sizes] + [(2000 + n, base[:n] + "!" + base[-n:]) for n in sizes]
    needles += [(5, needles[3][1]), (-40_000, needles[9][1]), (None, "a"), (8000, "x" * 9000 + "y" + "x" * 9000), (8001, "x" * 16)]
    texts = [(0, base), (1, base[:9000]), (2, base[-9000:]), (3, "a" * 300_000 + base[-9000:]), (4, ""), (5, None), (None, "ab"), (6, "x" * 18_001), (6, "x" * 9000 + "y" + "x" * 9000), (7, base[:500]), (8, base[-500:])]
    texts += [(100 + k, make(draw.randrange(60))) for k in range(100)]
    want = {(u, i) for u, t in texts for i, n in needles if t is not None and n in t}
    rows, wanted = spark.createDataFrame(texts, "uid long, text string"), spark.createDataFrame(needles, "item_id long, needle string")
    got = [tuple(r) for r in linkage.containing(rows, wanted).collect()]
    assert set(got) == want and len(got) == len(want)
    # A table that is full lets more through, and merged needles are found like broadcast ones.
    exact = {(u, n.encode()) for u, t in texts for _, n in needles if t is not None and n in t}
    binary = wanted.select(F.col("needle").cast("binary").alias("needle"))
    few = {(r.uid, bytes(r.needle)) for r in found(rows, binary).collect()}
    assert few >= exact and len(few) < 1.02 * len(exact)


def test_full_tables_and_merged_needles(spark, monkeypatch):
    draw = random.Random(10)
    word = lambda: "".join(draw.choice("abcé") for _ in range(draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 12])))
    texts = [(k, " ".join(word() for _ in range(15))) for k in range(120)]
    needles = [(k, draw.choice([word(), f"{word()} {word()}"])) for k in range(150)]
    want = {(u, i) for u, t in texts for i, n in needles if n in t}
    monkeypatch.setattr(linkage, "FEW", 10)
    monkeypatch.setattr("registrum.operators.needles.FEWEST", 64)
    monkeypatch.setattr(linkage, "found", lambda a, b: found(a, b, most=64))
    got = linkage.containing(spark.createDataFrame(texts, "uid long, text string"), spark.createDataFrame(needles, "item_id long, needle string"))
    assert {tuple(r) for r in got.collect()} == want and "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()

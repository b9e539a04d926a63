import random
import re
from collections import Counter

import pytest

from registrum.llm import phrases


def brute(rows, least, inside, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    often = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    gone = set()
    for (lang, words), n in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                short = lang, words[i : i + k]
                if 100 * n >= inside * counts[short]:
                    gone.add(short)
    found = {}
    for (lang, words), a in often.items():
        if (lang, words) not in gone:
            cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return {(lang, rank, w.decode(), -a, left, right, totals[lang], -s) for lang, all_ in found.items() for rank, (s, a, w, left, right) in enumerate(sorted(all_)[:top], 1)}


def made(seed, n=400):
    draw = random.Random(seed)
    names = ["Alpha", "beta", "gamma", "É", "x", "delta-1", "of", "THE"]
    fixed = ["new york city hall", "as well as", "Of The x beta", "gamma É"]
    text = lambda: "".join(draw.choice([draw.choice(names), draw.choice(fixed)]) + draw.choice([" ", " ", "\t", "  ", ". ", "\n", ",", " ! "]) for _ in range(draw.randrange(30)))
    return [(draw.choice(["en", "en", "de", None, "und"]), draw.choice([text(), text(), text(), None, ""])) for _ in range(n)]


@pytest.mark.parametrize(("block", "broadcast"), [(500, 0), (1 << 22, 1000)])
def test_phrases_equal_brute_force(spark, block, broadcast):
    rows = made(block)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", phrases.F.lit(1)).withColumn("id", phrases.F.lit("x"))
    for least, inside, top in ((5, 80, 2000), (2, 60, 7)):
        got = {tuple(r) for r in phrases.mined(docs, least=least, inside=inside, top=top, block=block, broadcast=broadcast).collect()}
        assert got == brute(rows, least, inside, top) and got


def test_one_phrase_in_all_texts_and_repeated_rows(spark):
    rows = [("en", "red apple pie")] * 500 + [("en", "apple pie")] * 100 + [("fr", "x " * 20_000)]
    got = {tuple(r) for r in phrases.mined(spark.createDataFrame(rows, "lang string, text string"), block=1000).collect()}
    assert got == brute(rows, 30, 80, 2000)


def test_empty_tables_and_texts_without_words(spark):
    assert phrases.mined(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.mined(spark.createDataFrame([("en", None), (None, ""), ("en", " .\n. "), ("en", "one")], "lang string, text string")).count() == 0


def test_memory_holds_one_block_at_a_time(spark, monkeypatch):
    """Names meet a block as sorted rows: no aggregate collects the entries of all blocks of a task, and results stay the same."""
    plans, staged = [], phrases.staged

    def seen(df, name, codec=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, name, codec)

    monkeypatch.setattr(phrases, "staged", seen)
    rows = made(7)
    got = {tuple(r) for r in phrases.mined(spark.createDataFrame(rows, "lang string, text string"), least=3, block=300).collect()}
    assert got == brute(rows, 3, 80, 2000) and got
    paired = [plan for name, plan in plans if name.startswith("phrase-pairs")]
    assert len(paired) == phrases.WORDS - 1 and not any("collect_list" in plan for plan in paired)


@pytest.mark.parametrize("bits", [64, phrases.BITS])
def test_phrases_meet_no_join_of_entries(spark, monkeypatch, bits):
    """Only words are joined back to their blocks; longer phrases are counted without a join, whose rows grew 16 times on five times the input. A
    table of bits that is full lets more phrases through to the count, and the results stay the same."""
    plans, staged = [], phrases.staged

    def seen(df, name, codec=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, name, codec)

    monkeypatch.setattr(phrases, "staged", seen)
    rows = made(11)
    got = {tuple(r) for r in phrases.mined(spark.createDataFrame(rows, "lang string, text string"), least=4, block=400, **({} if bits == phrases.BITS else {"bits": bits})).collect()}
    assert got == brute(rows, 4, 80, 2000) and got
    paired = [plan for name, plan in plans if name.startswith("phrase-pairs")]
    assert len(paired) == phrases.WORDS - 1 and not any("Join" in plan or "Generate" in plan for plan in paired)


@pytest.mark.parametrize(("count", "width"), [(7, ">u4"), (300, ">u8")])
def test_table_of_bits_loses_no_phrase(spark, count, width):
    """Each frequent phrase finds its bit, in a table of any size and for names of four and eight bytes."""
    keys = [phrases.np.array([k, k * k, 7], width).tobytes() for k in range(count)]
    for most in (64, 1 << 20):
        table = phrases._table(spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"), width, most).value
        slot = phrases._slots([phrases.np.array(c) for c in zip(*((k, k * k, 7) for k in range(count)), strict=True)], len(table) << 6)
        assert len(table) << 6 <= max(64, most) and (table[slot >> phrases.np.uint64(6)] >> (slot & phrases.np.uint64(63)) & phrases.np.uint64(1)).all()

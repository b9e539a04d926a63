import hashlib
import random
import re

from registrum.llm import personal

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for k, d in enumerate(reversed(s)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """Base spans by whole-text patterns."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def base(finder, text):
    return [s for s in finder.spans(text) if s[1] < 4]


def test_base_spans_equal_whole_text_patterns_on_hostile_texts():
    finder, draw = personal.Finder(), random.Random(5)
    pools = ["a@.-+ 1", "0123456789. ", "0123 -", "+1() .-2", "ab@c.d-é\n", "12.5+@ (a)-", "4 -0"]
    for k in range(30_000):
        text = "".join(draw.choice(pools[k % len(pools)]) for _ in range(draw.randrange(40)))
        assert base(finder, text) == plain(text), repr(text)


def test_cards_and_addresses_at_their_bounds():
    finder = personal.Finder()
    for text in ["4111 1111-1111 1111", "411111111111111 1 1", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0255", "x@y x@y.z@w.v", "+1 (729) 555-7725.", "+12345678", "++1 234 567 89", "a@b..c", "İ@b.c a@b.co", "", "@", "0" * 5000 + ".1.1.1", "5" * 9000]:
        assert base(finder, text) == [s for s in plain_safe(text)], text


def plain_safe(text):
    import sys

    sys.set_int_max_str_digits(0)
    return plain(text)


def test_added_kinds():
    def kinds(text):
        return [(personal.KINDS[k], text[lo:hi]) for lo, k, hi in personal.Finder().spans(text) if k >= 4]

    assert kinds("see https://anna:x1@host.example:81/p and http://host.example/a@b") == [("login", "https://anna:x1@host.example:81")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 and more") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN DE88370400440532013000") == []  # the check digits are wrong
    assert kinds("Account no. 12-345 678, accountant 12345678, account 12") == [("account", "12-345 678")]
    assert kinds('TOKEN = "9233A8ECF7C5B09F" tokens = "9233A8ECF7C5B09F" token = short1') == [("secret", "9233A8ECF7C5B09F")]
    assert kinds("every token counts, the account of 1987") == []


def test_rows(spark):
    rows = [(1, "İ mail a.b@c.de now", 7), (2, None, 7), (3, "", 7), (1, "İ mail a.b@c.de now", 7), (None, "x +1 (729) 555-7725", 7), (4, "word " * 50_000 + "1.2.3.4", 7)]
    got = personal.digests(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    of = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and of[1]["n_email"] == 1 and of[1]["spans"] == "email:7:15" and of[None]["n_phone"] == 1 and of[4]["spans"] == "ip:250000:250007"
    assert of[2]["base_sha256"] == of[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and of[2]["spans"] == ""
    assert of[1]["base_sha256"] == hashlib.sha256(b"email:7:15").hexdigest()
    assert personal.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_query_equals_brute_force(spark):
    from registrum.llm.queries import op13_personal_data

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        spans = plain(r["text"] or "")
        want[r["doc_id"]] = hashlib.sha256(",".join(f"{personal.BASE[k]}:{lo}:{hi}" for lo, k, hi in spans).encode()).hexdigest()
    assert {r["doc_id"]: r["base_sha256"] for r in op13_personal_data(spark, "/root/testdata/sf0.001").collect()} == want

import hashlib
import itertools
import random
import re
import zlib

import pytest

from registrum.llm import dialogues

LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        at = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(at.encode()) % 20
        if kind == 0:
            continue
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row] * (1 + (kind == 3))
    return out


def faults(rows):
    """Rows of one conversation in order, each with its first fault."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        plain = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((turn, role, text, "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) over all edits, by breadth: every row kept, changed or deleted, up to two turns inserted at each place."""

    def put(into, roles, value):
        if re.fullmatch(r"s?(ua)*u?", roles):
            key = roles and {"s": "s", "u": "u", "a": "ua"}[roles[-1]]  # what may follow depends on no more
            if key not in into or value[:2] < into[key][:2]:
                into[key] = value

    now = {}
    put(now, "", (0, "", []))
    for k in range(len(rows) + 1):
        for _ in range(3):
            for roles, (cost, audit, lines) in list(now.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    put(now, roles + r, (cost + 3, audit + "I", [*lines, f"{name}:"]))
        if k == len(rows):
            break
        _, role, text, fault = rows[k]
        then = {}
        for roles, (cost, audit, lines) in now.items():
            put(then, roles, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if role[:1] and role[:1] in "sua":
                put(then, roles + role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for r, name in (("u", "user"), ("a", "assistant")):
                put(then, roles + r, (cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"]))
        now = then
    ends = [v for roles, v in now.items() if LEGAL.fullmatch(roles)]
    return min(ends, key=lambda v: v[:2])


def expected(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        lines = faults([r for r in rows if r[0] == conv])
        turns = [t for t, *_ in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(f == x for *_, f in lines) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(lines))
        cost, audit, text = cheapest(lines)
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def brute(letters, most=2):
    """The least (cost, audit) of a signature, over literally all edits."""
    best = None

    def walk(k, roles, cost, audit, made):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(letters) and LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
            best = cost, audit
        if made < most:
            for r in "ua":
                walk(k, roles + r, cost + 3, audit + "I", made + 1)
        if k < len(letters):
            letter = letters[k]
            walk(k + 1, roles, cost + 4, audit + "D", 0)
            if letter != "x":
                walk(k + 1, roles + letter.lower(), cost + 3 * letter.isupper(), audit + "K", 0)
                for r in "ua":
                    walk(k + 1, roles + r, cost + 3 + 3 * letter.isupper(), audit + "R", 0)

    walk(0, "", 0, "", 0)
    return best


def test_every_short_signature_is_solved_as_by_all_edits():
    solver = dialogues.Solver()
    for n in (1, 2, 3):
        for letters in itertools.product("suaoxSUA", repeat=n):
            costs, edits, ends = solver.solve("".join(letters), dialogues._END)
            steps = [re.sub("[ua](?=.*[KDR])", "I", e) for e in edits[0]]
            audit = "".join(re.sub("(?<=R)[ua]", "", s) for s in steps) + "I" * len(dialogues._TAIL[ends[0]])
            assert (costs[0], audit) == brute(letters), letters


def rows_of(draw, convs):
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?", "Yes. ", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(None if c == 0 else c, draw.choice([None, 0, 1, 2, 3, 5, 9]) if draw.random() < 0.4 else t, draw.choice(roles) if draw.random() < 0.3 else ("user", "assistant")[t % 2], draw.choice(texts)) for c in range(convs) for t in range(draw.randrange(1, 9))]


@pytest.mark.parametrize("block", [2, 4096])
def test_reports_equal_brute_force_in_one_piece_or_many(spark, block):
    rows = rows_of(random.Random(block), 60)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("role2", dialogues.F.lit(1))
    hurt = damage(rows)
    assert sorted(map(str, dialogues.damaged(table).collect())) == sorted(map(str, (spark.createDataFrame(hurt, "conv_id long, turn long, role string, text string").collect())))
    got = {r[0]: tuple(r[1:]) for r in dialogues.repaired(dialogues.damaged(table), table, block=block).collect()}
    assert got == expected(rows, hurt)


def test_a_conversation_with_most_rows_goes_through_many_pieces(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    got = {r["conv_id"]: r for r in dialogues.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=64).collect()}
    assert got[1]["audit"] == "K" * 3000 and got[1]["cost"] == 0 and got[1]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:3000]).encode()).hexdigest()
    assert got[2]["audit"] == "D" or got[2]["cost"] == 3 and got[2]["audit"] == "KI"


def test_empty_table_and_conversations_without_rows(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert dialogues.repaired(none).count() == 0
    one = spark.createDataFrame([("a",), (None,)], "conv_id string")
    got = {tuple(r) for r in dialogues.repaired(none, one).collect()}
    assert got == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ("a", None)}


def test_the_query_equals_brute_force(spark):
    from registrum.llm.queries import op12_dialogue_repair

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in op12_dialogue_repair(spark, "/root/testdata/sf0.01").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == expected(rows, damage(rows))

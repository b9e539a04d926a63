"""Conversation structure repair by signature deduplication.

A conversation should read `(s?(ua)+)?` in the initials of its roles, without blank, repeated or cut-off turns. Each row becomes one letter of
a signature: `x` must go (blank, or role and text seen earlier), otherwise the initial of its role (`o` for any but s, u, a), a capital
where the text is cut off. Conversations with the same signature have the same repair, so each distinct signature is solved once, by a
memoised recursion over its halves; the edits are joined back and replayed over the rows.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant turn 3; a cut-off row that stays costs 3 more.
Of the cheapest edits the ASCII-least sequence of initials counts.

Rows are put in order once, by ranges of (conversation, turn, role, digest of the text), and numbered. A piece of a signature covers at most
`block` rows; a conversation over several pieces is solved piece by piece, where only the costs of four states pass between them, so
no conversation has to fit a group. The replay reads a conversation's rows as a sorted stream that holds one row and a running digest; one
digest over a conversation's text is sequential by its definition.

Null columns are one space. Rows of one turn go by role, then by the SHA-256 of their text; turns that are null come first. A role without
a character fits nowhere. Conversations without rows give zeros, an empty audit and the digest of the empty string; repeated rows are duplicates; very long texts are read whole;
other columns are not read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, releasing, staged

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: Rows of a piece.
BLOCK = 4096
WHITE, STOPS = " \t\n\v\f\r", (".", "!", "?")
NAMES = {"u": "user", "a": "assistant"}

#: State (0 start, 1 after system, 2 after user, 3 after assistant) and initial give the next state; the initial that may be made at a state.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_MADE = "uuau"
_NEVER = 1 << 40
#: Cost to end from a state, and the turns that are then inserted.
_END, _TAIL = (0, 2 * INSERT, INSERT, 0), ("", "ua", "a", "")

#: What a row is given: initials inserted before it, then K, D, or R and the new initial.
Solved = tuple[tuple[int, ...], tuple[tuple[str, ...], ...], tuple[int, ...]]


class Solver:
    """Cheapest edits of a signature from each state, given the cost to go from each state behind it."""

    def __init__(self, most: int = 200_000):
        self.memo: dict[tuple[str, tuple[int, ...]], Solved] = {}
        self.most = most

    def solve(self, signature: str, ahead: tuple[int, ...]) -> Solved:
        """Costs, edits of every row and the last state, each by first state."""
        low = min(ahead)
        key = signature, tuple(min(c - low, _NEVER) for c in ahead)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            known = self.memo[key] = self._halves(*key)
        costs, edits, ends = known
        return tuple(c + low for c in costs), edits, ends

    def _halves(self, signature: str, ahead: tuple[int, ...]) -> Solved:
        if len(signature) == 1:
            return self._row(signature, ahead)
        half = len(signature) // 2
        back = self.solve(signature[half:], ahead)
        front = self.solve(signature[:half], back[0])
        return front[0], tuple(edits + back[1][end] for edits, end in zip(front[1], front[2], strict=True)), tuple(back[2][end] for end in front[2])

    def _row(self, letter: str, ahead: tuple[int, ...]) -> Solved:
        extra = CUT_OFF * letter.isupper()
        choices: list[dict[str, tuple[int, str, int]]] = []  # by state: initial of the edit -> cost, edit, next state
        for state in range(4):
            found = {"D": (DELETE + ahead[state], "D", state)}
            if letter != "x":
                to = _NEXT.get((state, letter.lower()))
                if to is not None:
                    found["K"] = KEEP + extra + ahead[to], "K", to
                to = _NEXT[state, _MADE[state]]
                found["R"] = REROLE + extra + ahead[to], f"R{_MADE[state]}", to
            choices.append(found)
        best = [min(c for c, _, _ in found.values()) for found in choices]
        for _ in range(2):  # at most two turns are inserted at a place
            best = [min(best[s], INSERT + best[_NEXT[s, _MADE[s]]]) for s in range(4)]
        edits, ends = [], []
        for state in range(4):
            before = ""
            while True:
                options = {e: x for e, x in choices[state].items() if x[0] == best[state]}
                to = _NEXT[state, _MADE[state]]
                if "D" not in options and INSERT + best[to] == best[state]:
                    before, state = before + _MADE[state], to
                    continue
                _, edit, end = options[min(options)]
                break
            edits.append((before + edit,))
            ends.append(end)
        return tuple(min(b, _NEVER) for b in best), tuple(edits), tuple(ends)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after reproducible faults: by crc32 of `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its
    full stops (2), is repeated (3) or becomes the user's (4). Nulls are one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(named("text"), "".join(STOPS), "")).otherwise(named("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their digest, what their text ends with (`blank`, `cut` or null) and `at`, which rises with the order."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    text = F.rtrim("text", F.lit(WHITE))
    state = F.when(text == "", "blank").when(~F.right(text, F.lit(1)).isin(*STOPS), "cut").alias("state")
    rows = rows.select("conv_id", "turn", named("role"), named("text")).select("*", F.sha2("text", 256).alias("digest"), state)
    order = ["conv_id", "turn", "role", "digest"]  # ascending puts nulls first
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


def _letters(lines: DataFrame) -> DataFrame:
    """conv_id, at, fault and letter of every row."""
    first = lines.where("state is null or state = 'cut'").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("__first"), F.count("*").alias("__n"))
    first = first.where("__n > 1").select(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("digest").alias("__digest"), "__first")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    fault = F.when(F.col("state") == "blank", "blank").when(F.col("at") > F.col("__first"), "duplicate").when(F.col("state") == "cut", "truncated").otherwise("")
    initial = F.left("role", F.lit(1))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(~initial.isin("s", "u", "a"), F.when(F.col("fault") == "", "o").otherwise("O")).when(F.col("fault") == "", initial).otherwise(F.upper(initial))
    return lines.select("conv_id", "role", "digest", "state", "at").join(first, same, "left").withColumn("fault", fault).select("conv_id", "at", "fault", letter.alias("letter"))


def _vector(costs: tuple[int, ...]) -> str:
    return ",".join(map(str, costs))


def _parsed(vector: str) -> tuple[int, ...]:
    return tuple(map(int, vector.split(",")))


def _transfers(signatures: DataFrame) -> DataFrame:
    """signature and moves: the costs from each state (rows) to each state (columns)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solver = Solver()
        for frame in frames:
            moves = [";".join(_vector(solver.solve(s, tuple(0 if e == end else _NEVER for e in range(4)))[0]) for end in range(4)) for s in frame["signature"]]
            yield frame.assign(moves=moves)

    return signatures.mapInPandas(run, "signature string, moves string")


def _solutions(signatures: DataFrame) -> DataFrame:
    """signature and ahead, with the edits of every row and the last state by first state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solver = Solver()
        for frame in frames:
            got = [solver.solve(s, _parsed(v)) for s, v in zip(frame["signature"], frame["ahead"], strict=True)]
            yield frame.assign(edits=[[list(e) for e in g[1]] for g in got], ends=[list(g[2]) for g in got])

    return signatures.mapInPandas(run, "signature string, ahead string, edits array<array<string>>, ends array<int>")


def _several(pieces: DataFrame, schema: StructType) -> DataFrame:
    """conv_id, block and ahead of the pieces of conversations over several pieces: costs go from the last piece to the first."""
    known = pieces.join(_transfers(pieces.select("signature").distinct()), "signature").select("conv_id", "block", "moves")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", ascending=False, ignore_index=True)
        costs, ahead = _END, []
        for moves in frame["moves"]:
            ahead.append(_vector(costs))
            to = [_parsed(m) for m in moves.split(";")]  # by last state: the cost from each first state
            costs = tuple(min(min(to[e][s] + costs[e] for e in range(4)), _NEVER) for s in range(4))
        return frame[["conv_id", "block"]].assign(ahead=ahead)

    return known.groupBy("conv_id").applyInPandas(run, StructType([*schema.fields, *StructType.fromDDL("block long, ahead string").fields]))


def _begun(solved: DataFrame, schema: StructType) -> DataFrame:
    """conv_id, block and the state in which each piece begins."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", ignore_index=True)
        state, begun = 0, []
        for ends in frame["ends"]:
            begun.append(state)
            state = int(ends[state])
        return frame[["conv_id", "block"]].assign(begun=begun)

    return solved.groupBy("conv_id").applyInPandas(run, StructType([*schema.fields, *StructType.fromDDL("block long, begun int").fields]))


def _conv(left: DataFrame, right: DataFrame, how: str = "left", also: tuple[str, ...] = ()) -> DataFrame:
    """left joined with right on conv_id, null with null, and the columns `also`."""
    right = right.select(*[F.col(c).alias(f"__{c}" if c in ("conv_id", *also) else c) for c in right.columns])
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id"))
    for c in also:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return left.join(right, same, how).drop("__conv_id", *[f"__{c}" for c in also])


def _edits(pieces: DataFrame) -> DataFrame:
    """conv_id, at, fault and edit of every row, and a row without a fault for what is inserted behind the last."""
    conv = StructType([pieces.schema["conv_id"]])
    totals = pieces.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("block").alias("last"))
    pieces = _conv(pieces, totals)
    many = pieces.where("n > 1")
    ahead = F.coalesce("ahead", F.lit(_vector(_END)))
    pieces = _conv(pieces, _several(many, conv), also=("block",)).withColumn("ahead", ahead)
    solved = pieces.join(_solutions(pieces.select("signature", "ahead").distinct()), ["signature", "ahead"])
    begun = F.coalesce("begun", F.lit(0))
    solved = _conv(solved, _begun(solved.where("n > 1").select("conv_id", "block", "ends"), conv), also=("block",)).withColumn("begun", begun)
    rows = F.arrays_zip(F.col("rows.at").alias("at"), F.col("rows.fault").alias("fault"), F.get("edits", F.col("begun")).alias("edit"))
    tail = F.get(F.array(*map(F.lit, _TAIL)), F.get("ends", F.col("begun")))
    tail = F.array(F.struct(F.element_at("rows.at", -1).alias("at"), F.lit(None).cast("string").alias("fault"), tail.alias("edit")))
    rows = F.concat(rows, F.when(F.col("block") == F.col("last"), tail).otherwise(F.array().cast("array<struct<at:bigint,fault:string,edit:string>>")))
    return solved.select("conv_id", F.explode(rows).alias("row")).select("conv_id", "row.*")


class _Report:
    """One conversation's rows as they come."""

    def __init__(self) -> None:
        self.counts = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        self.low = self.high = None
        self.turns, self.before, self.audit, self.digest, self.lines = 0, None, [], hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def insert(self, initials: str) -> None:
        for initial in initials:
            self.line(NAMES[initial], "")
            self.audit.append("I")
            self.counts["cost"] += INSERT

    def row(self, turn: int | None, role: str, text: str, fault: str, edit: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if fault:
            self.counts[fault] += 1
        self.counts["illegal"] += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        made = edit.rstrip("ua") if "R" in edit else edit
        self.insert(made[:-1])
        self.audit.append(made[-1])
        if made[-1] == "D":
            self.counts["cost"] += DELETE
            return
        self.counts["cost"] += CUT_OFF * (fault == "truncated") + REROLE * (made[-1] == "R")
        self.line(NAMES[edit[-1]] if made[-1] == "R" else role, text)

    def result(self) -> tuple:
        if self.low is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        return (*self.counts.values(), "".join(self.audit), self.digest.hexdigest())


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame, every: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id and the report of each conversation in `rows` (conv_id, turn, role, text) and in `every` (conv_id)."""
    spark = rows.sparkSession
    ids = (rows if every is None else every).select("conv_id").distinct()
    lines, lines_path = staged(_ordered(rows), "dialogue-rows")
    bits = (block - 1).bit_length()
    gathered = _letters(lines).groupBy("conv_id", F.shiftright("at", bits).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "fault", "letter"))).alias("rows"))
    pieces, pieces_path = staged(gathered.withColumn("signature", F.array_join("rows.letter", "")), "dialogue-pieces")

    none = lambda kind: F.lit(None).cast(kind)
    stream = ids.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("part"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("string").alias("fault"), none("string").alias("edit"))
    stream = stream.unionByName(lines.select("conv_id", "at", F.lit(2).alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text"), allowMissingColumns=True)
    stream = stream.unionByName(_edits(pieces).select("conv_id", "at", F.when(F.col("fault").isNull(), 3).otherwise(1).alias("part"), "fault", "edit"), allowMissingColumns=True)
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(REPORT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, done, kinds, step = None, [], None, (None, None)

        def made() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema.names)

        conv = None
        for batch in batches:
            kinds = [batch.schema.types[0], *[pa.int64()] * 6, pa.string(), pa.string()]
            for of, _, part, turn, role, text, fault, edit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:  # every conversation begins with this row
                    if report is not None:
                        done.append((conv, *report.result()))
                    conv, report = of, _Report()
                elif part == 1:
                    step = fault, edit
                elif part == 2:
                    report.row(turn, role, text, *step)
                else:
                    report.insert(edit)
            if len(done) >= 1000:
                yield made()
        if report is not None:
            done.append((conv, *report.result()))
        if done:
            yield made()

    out, path = staged(stream.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part").mapInArrow(releasing(run), schema), "dialogue-reports")
    discard(spark, lines_path)
    discard(spark, pieces_path)
    return out

"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over a text and stops at anchors only: at-signs, plus signs, digits, dots before a digit, schemes and
identifier cues. At each anchor a small parser looks at the characters beside it, expands to the left and right as far as its kind allows and
validates what it got. What an anchor's match has covered is not looked at again by the same kind.

email, ip, card and phone are the base kinds: leftmost and non-overlapping per kind, and a match that fails its check is dropped without
another try. The parsers add spans of further kinds, which never replace a base span: `login` (an address behind a scheme with a user before its
at-sign), `iban` (checked modulo 97), `account` (a number of 6 to 17 digits behind an account cue) and `secret` (a value of 16 or more
characters with a letter and a digit, assigned to a token, key or password). Cues are read whatever the case of A-Z, and stand apart from words.

Positions are code points, ends exclusive. Null and empty texts have no spans; long texts are read whole, in time linear in their length;
repeated rows are read alike; columns beside the text and those kept are not read; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import releasing

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "secret")
#: Cue words by the kind that they announce.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "a/c", "konto", "kontonummer", "cuenta", "compte", "routing"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USER = re.compile(r"[^\s/?#@\"'<>]+@[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?")
_ACCOUNT = re.compile(r"(?: ?(?:number|num|no|nr)\b\.?)?[ :=#]{1,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9A-Za-z])")
_IBAN = re.compile(r"[ :=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_VALUE = re.compile(r" {0,2}[:=] {0,2}[\"']?([A-Za-z0-9_+/=.-]{16,})")


def _machine() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    anchors = {"@": "at", "+": "plus", "://": "scheme"} | {d: "digit" for d in "0123456789"} | {f".{d}": "dot" for d in "0123456789"}
    for kind, cues in CUES.items():
        anchors |= dict.fromkeys(cues, kind)
    for anchor, kind in anchors.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    turned = [int(d) for d in reversed(digits)]
    return (sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


class Finder:
    """Spans of a text, by its anchors."""

    def __init__(self) -> None:
        self.machine = _machine()
        self.at = {"at": self.email, "dot": self.ip, "digit": self.card, "plus": self.phone, "scheme": self.login, "iban": self.iban, "account": self.account, "secret": self.secret}

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end), in this order."""
        self.text, self.found, self.over = text, [], dict.fromkeys(("at", "dot", "digit", "plus"), 0)
        for last, (kind, length) in self.machine.iter(text.encode().lower().decode()):  # bytes fold A-Z only, so positions stay
            self.at[kind](last + 1 - length, last + 1)
        return sorted(self.found)

    def add(self, kind: str, start: int, end: int) -> None:
        self.found.append((start, KINDS.index(kind), end))

    def left(self, at: int, allowed: frozenset[str], kind: str) -> int:
        """Where the run of allowed characters that ends before `at` begins, within what the kind's matches left over."""
        over = self.over[kind]
        while at > over and self.text[at - 1] in allowed:
            at -= 1
        return at

    def email(self, at: int, after: int) -> None:
        start = self.left(at, _LOCAL, "at")
        if start < at and (domain := _DOMAIN.match(self.text, after)):
            self.over["at"] = domain.end()
            self.add("email", start, domain.end())

    def ip(self, at: int, after: int) -> None:
        if at < self.over["dot"]:
            return
        start = self.left(at, _DIGITS, "dot")
        if start == at:
            return
        quad = _QUAD.match(self.text, start)
        if not quad:  # too few parts, also from every later one
            self.over["dot"] = _DOTTED.match(self.text, start).end()
            return
        self.over["dot"] = quad.end()
        if all(map(_octet, quad[0].split("."))):
            self.add("ip", start, quad.end())

    def card(self, at: int, after: int) -> None:
        if at < self.over["digit"]:
            return
        run = _SPACED.match(self.text, at)
        self.over["digit"] = run.end()
        if run.end() - at >= 12:
            digits = run[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                self.add("card", at, run.end())

    def phone(self, at: int, after: int) -> None:
        dialled = _DIALLED.match(self.text, at)
        if dialled and 9 <= sum(c in _DIGITS for c in dialled[0]) <= 15:
            self.add("phone", at, dialled.end())

    def login(self, at: int, after: int) -> None:
        start = at
        while start > max(0, at - 12) and "a" <= self.text[start - 1].lower() <= "z":
            start -= 1
        user = _USER.match(self.text, after)
        if start < at and user:
            self.add("login", start, user.end())

    def _apart(self, at: int) -> bool:
        return at == 0 or not (self.text[at - 1].isalnum() or self.text[at - 1] == "/")

    def iban(self, at: int, after: int) -> None:
        if self._apart(at) and (number := _IBAN.match(self.text, after)):
            text = number[1]
            for end in range(len(text), 14, -1):  # a word behind the number may look like its end
                if (end == len(text) or not text[end - 1].isspace()) and 15 <= len(text[:end].replace(" ", "")) <= 34 and _mod97(text[:end]):
                    self.add("iban", number.start(1), number.start(1) + end)
                    return

    def account(self, at: int, after: int) -> None:
        if self._apart(at) and (number := _ACCOUNT.match(self.text, after)):
            self.add("account", number.start(1), number.end(1))

    def secret(self, at: int, after: int) -> None:
        if self._apart(at) and (value := _VALUE.match(self.text, after)) and re.search("[0-9]", value[1]) and re.search("[A-Za-z]", value[1]):
            self.add("secret", value.start(1), value.end(1))



def found(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and spans: an array of (kind, start, end), by start and kind."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = StructType([*rows.drop("__text").schema.fields, *StructType.fromDDL("spans array<struct<kind: string, start: int, end: int>>").fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": lo, "end": hi} for lo, k, hi in finder.spans(t.as_py())] for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], schema.names)

    return rows.mapInArrow(releasing(run), schema)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the counts of the base kinds, the SHA-256 of the base spans and all spans as text."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE]
    return found(docs, text).select("doc_id", *counts, F.sha2(joined(of(BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

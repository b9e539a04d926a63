"""Language identification by prediction by partial matching.

Per language a variable-order byte context tree is counted once on a bounded sample and then frozen. A text's score under a language is
its exact code length: at each byte the longest context that knows the byte codes it, every longer known context first pays its escape
(method C: with n symbols seen, d of them distinct, a symbol counted c times costs -log2(c / (n + d)) and the escape -log2(d / (n + d)));
a byte that no context knows costs 8 bits after the last escape. Contexts end at the start of a text. As statistics are frozen, the cost of (context, byte) is a constant,
so the trees of all languages are folded into one hash table per order, whose rows hold the languages' resolved costs side by side.

Null texts and texts without a letter get `und` with score 0; repeated rows and ties are independent per row, equal lengths go to the
first language in alphabetical order; without any labelled row everything is `und`. A text that is repeated among the labelled rows is learned
once. Texts are scored whole, in chunks of bounded size; other columns are not read, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, releasing, remainder, utf8

#: Longest context in bytes; labelled texts, and bytes of them, sampled per language; languages that are learned.
ORDER, DOCS_PER_LANG, BYTES_PER_LANG, LANGS = 4, 200, 8 << 20, 200

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Table:
    """Open addressing over distinct 64-bit keys; find() gives their positions or -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.slots = np.full(1 << self.bits, _NONE)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.rows[at] < 0
            _, first = np.unique(at, return_index=True)
            first = first[free[first]]
            self.slots[at[first]], self.rows[at[first]] = keys[todo[first]], todo[first]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.rows[at]
        wrong = np.flatnonzero((out >= 0) & (self.slots[at] != keys))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.rows[at]
            again = (out[wrong] >= 0) & (self.slots[at] != keys[wrong])
            wrong, at = wrong[again], at[again]
        return out


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """For each position the last n bytes up to and with it as one number; positions before the start count as zero bytes."""
    out = data.astype(np.uint64)
    for k in range(1, n):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out


class Model:
    """Frozen context trees of several languages."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        joined = {lang: np.frombuffer(b"".join(texts[lang]), np.uint8) for lang in self.langs}
        place = {lang: np.concatenate([np.zeros(0, int), *(np.arange(len(t)) for t in texts[lang])]) for lang in self.langs}
        self.tables: list[_Table] = []
        self.costs: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []  # at k: of each gram of k bytes as a context; at 0 of the empty one
        for k in range(order + 1):
            counted = [np.unique(_grams(joined[lang], k + 1)[place[lang] >= k], return_counts=True) for lang in self.langs]
            keys = np.unique(np.concatenate([x for x, _ in counted])) if counted else np.zeros(0, np.uint64)
            contexts = keys >> np.uint64(8)
            suffix = keys & np.uint64((1 << 8 * k) - 1)
            if k:
                known = self.tables[k - 1].find(contexts)
                below = self.tables[k - 1].find(suffix)
                size = len(self.costs[k - 1])
            else:
                known, below, size = np.zeros(len(keys), np.int32), None, 1
            cost, escape = np.zeros((len(keys), len(self.langs)), np.float32), np.zeros((size, len(self.langs)), np.float32)
            for j, (own, n) in enumerate(counted):
                row = np.searchsorted(keys, own)
                has = known[row] >= 0
                where = known[row][has]
                total, kinds = np.bincount(where, n[has], size), np.bincount(where, minlength=size)
                seen = kinds > 0
                escape[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                lower = self.costs[k - 1][below, j] if k else np.full(len(keys), 8.0, np.float32)
                cost[:, j] = np.where(known >= 0, escape[known, j], 0) + lower
                full = total[known[row]] + kinds[known[row]]
                cost[row[has], j] = -np.log2(n[has] / full[has])
            self.tables.append(_Table(keys))
            self.costs.append(cost)
            self.escapes.append(escape)

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths in bits, a row for each text data[at[i]:at[i + 1]] and a column for each language."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        if not self.langs:
            return out
        pad, i, n = self.order, 0, len(at) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            if j > i + 1 or at[i + 1] - at[i] <= CHUNK:
                sizes = np.diff(at[i : j + 1])
                starts = np.concatenate([[0], np.cumsum(sizes + pad)])
                joined = np.zeros(starts[-1], np.uint8)
                inside = np.ones(starts[-1], bool)
                inside[(starts[:-1, None] + np.arange(pad)).ravel()] = False
                joined[inside] = data[at[i] : at[j]]
                sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self._bits(joined, np.flatnonzero(inside)), 0, np.float64)])
                ends = at[i : j + 1] - at[i]
                out[i:j] = sums[ends[1:]] - sums[ends[:-1]]
            else:
                for lo in range(int(at[i]), int(at[j]), CHUNK):
                    hi = min(lo + CHUNK, int(at[j]))
                    before = data[max(int(at[i]), lo - pad) : lo]
                    piece = np.concatenate([np.zeros(pad - len(before), np.uint8), before, data[lo:hi]])
                    out[i] += self._bits(piece, np.arange(pad, len(piece))).sum(0, dtype=np.float64)
            i = j
        return out

    def _bits(self, joined: np.ndarray, where: np.ndarray) -> np.ndarray:
        out = np.zeros((len(where), len(self.langs)), np.float32)
        grams = _grams(joined, self.order + 1)
        left, own = np.arange(len(where)), grams[where]
        for k in range(self.order, -1, -1):
            row = self.tables[k].find(own & np.uint64((1 << 8 * (k + 1)) - 1))
            hit = row >= 0
            out[left[hit]] += self.costs[k][row[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                break
            if k:
                context = self.tables[k - 1].find((own >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1))
                known = context >= 0
                out[left[known]] += self.escapes[k][context[known]]
            else:
                out[left] += self.escapes[0][0] + np.float32(8)
        return out


def sample(docs: DataFrame, labelled, per_lang: int = DOCS_PER_LANG, most: int = BYTES_PER_LANG, langs: int = LANGS) -> dict[str, list[bytes]]:
    """Of the `langs` languages with most different texts, at most per_lang different texts each, drawn by a hash of the text, whole, as far as they
    have `most` bytes together, and one at least: fixed bounds, so the driver can hold them. However often a row is repeated, it counts once."""
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64("text", "lang")
    different = rows.select("lang", key.alias("key"), F.octet_length("text").alias("n")).distinct()
    counts = {r["lang"]: r["count"] for r in different.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()}
    if not counts:
        return {}
    mark = F.pmod("key", F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, 1.5 * per_lang / n) * (1 << 30)) + 1) for k, n in counts.items()], "lang string, share long")
    some, limit = different.join(F.broadcast(shares), "lang").where(mark < F.col("share")), 2 * per_lang * len(counts)  # a row a language, langs at most
    held: dict[str, tuple[int, int]] = {}
    picked = []
    for r in some.select("lang", "key", mark.alias("mark"), "n").orderBy("mark", "key").limit(limit).collect():
        n, size = held.get(r["lang"], (0, 0))
        if n == 0 or n < per_lang and size + r["n"] <= most:
            held[r["lang"]] = (n + 1, size + r["n"])
            picked.append((r["lang"], r["key"]))
        else:
            held[r["lang"]] = (per_lang, most)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, "lang string, key long"))  # at most per_lang rows a language
    texts = rows.select("lang", "text", key.alias("key")).join(wanted, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    out: dict[str, list[bytes]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["key"])):
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with lang_pred and score, the posterior of the predicted language under equal priors."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    langs = np.array([*model.langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            known = ~column.is_null().to_numpy(zero_copy_only=False)
            best, score = np.full(len(column), len(model.langs)), np.zeros(len(column))
            if model.langs:
                bits = model.lengths(*utf8(column))
                first = bits.argmin(1)
                odds = np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                best, score = np.where(known, first, best), np.where(known, 1 / odds, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs[best], pa.string()), pa.array(score)], schema.names)

    return rows.mapInArrow(releasing(run), schema)


def predicted(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from rows outside the held-out fold only."""
    fold = remainder(F.col("doc_id"), folds)
    model = Model(sample(docs, fold != held))
    rows = docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model, keep=("doc_id", "held_out"))

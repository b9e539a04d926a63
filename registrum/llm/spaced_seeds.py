"""Benchmark decontamination by spaced-seed hashing.

Documents and benchmark items are token sequences (lower-cased runs of letters and digits). A mask such as 11010011 hashes the tokens at
its ones and ignores those at its zeros, so a seed survives substitutions there. Hashes of all document positions are joined with those of
all item positions; each hit names a diagonal (document position minus item position), on which the whole item is laid over the document
and compared token by token. An item is found where, in some window of WINDOW tokens on a diagonal, at most SUBSTITUTIONS differ; the
default mask hits every such window (11010011 keeps a place free of any two positions of thirteen). Items shorter than the window are
matched whole, without substitutions; items shorter than a mask have masks of their own length without zeros.

A side is broadcast only while it holds at most `BROADCAST` numbers and words; beyond it the same join is shuffled. A hot seed has a row per
occurrence and the hits of a document are made distinct before they are verified. Null and empty texts and items without a token match
nothing; repeated rows of a document give the same pairs once; very long texts are matched whole; other columns are not read, whatever their
names; an empty table on either side gives none. Everything stays in DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Tokens of a window and how many of them may differ; masks that hit all such windows; numbers and words that are few enough to broadcast.
WINDOW, SUBSTITUTIONS, MASKS, BROADCAST = 13, 2, ("11010011",), 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _seed(words: Column, mask: str, at: Column) -> Column:
    """Hash of the tokens at the mask's ones from position `at` (from 0) on."""
    return F.xxhash64(F.lit(mask), *[F.get(words, at + k) for k, c in enumerate(mask) if c == "1"])


def _seeds(words: Column, mask: str) -> Column:
    """The mask's hashes at every position."""
    places = F.sequence(F.lit(0), F.size(words) - len(mask))
    return F.when(F.size(words) >= len(mask), F.transform(places, lambda at: _seed(words, mask, at))).otherwise(F.array().cast("array<bigint>"))


def _all_seeds(rows: DataFrame, words: str, masks: tuple[str, ...], at: str) -> DataFrame:
    """A row for each position and mask: the other columns, the position and the hash."""
    others = [c for c in rows.columns if c != words]
    rows = rows.select(*others, F.array(*[_seeds(F.col(words), m) for m in masks]).alias("masks"))
    if len(masks) == 1:
        return rows.select(*others, F.posexplode(F.col("masks")[0]).alias(at, "seed"))
    return rows.select(*others, F.explode("masks").alias("one")).select(*others, F.posexplode("one").alias(at, "seed"))


def _total(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda total, x: total + x)


def found(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks: tuple[str, ...] = MASKS, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, item_id, matched (most equal tokens in a window) and share (equal tokens of the whole item on its best diagonal) of every item found in a document."""
    span = max(map(len, masks))
    items = items.select("item_id", tokens(F.col("text")).alias("item")).where("size(item) > 0")
    docs = docs.select("doc_id", F.col(text).alias("text"))
    short = sorted(r["n"] for r in items.select(F.size("item").alias("n")).where(F.col("n") < span).distinct().collect())  # fewer than a mask has places

    def small(rows: DataFrame, held: Column) -> DataFrame:
        """rows, to be broadcast if they hold few enough numbers and words: `held` in each."""
        return F.broadcast(rows) if (rows.agg(F.sum(held)).first()[0] or 0) <= broadcast else rows

    starts = _all_seeds(items.where(F.size("item") >= span), "item", masks, "item_at")
    for n in short:
        starts = starts.unionByName(_all_seeds(items.where(F.size("item") == n), "item", ("1" * n,), "item_at"))
    places = _all_seeds(docs.select("doc_id", tokens(F.col("text")).alias("words")), "words", (*masks, *("1" * n for n in short)), "doc_at")
    hits = places.join(small(starts, F.lit(3)), "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    hits, path = staged(hits, "seed-hits")

    # Verification reads the texts that have hits once more and lays each item over its diagonals.
    shifts = hits.groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))  # at most a document's positions
    # Tokens are made beneath the join with the items, so that they aren't made anew for each comparison.
    laid = docs.join(small(shifts, F.size("shifts") + 2), "doc_id").select("doc_id", "item_id", "shifts", tokens(F.col("text")).alias("words")).join(small(items, F.size("item") + 1), "item_id")
    wide = F.least(F.size("item"), F.lit(window))

    def judged(shift: Column) -> Column:
        same = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda k: F.when(F.get("item", k) == F.get("words", shift + k), 1).otherwise(0))
        sums = F.transform(F.sequence(F.lit(1), F.size("item") - wide + 1), lambda s: _total(F.slice(same, s, wide)))
        return F.struct(F.array_max(sums).alias("matched"), (_total(same) / F.size("item")).alias("share"))

    best = laid.select("doc_id", "item_id", wide.alias("wide"), F.array_max(F.transform("shifts", judged)).alias("best"))
    best = best.where(F.col("best.matched") >= F.col("wide") - F.when(F.col("wide") < window, 0).otherwise(substitutions))
    best = best.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    out, _ = staged(best.select("doc_id", "item_id", F.col("best.matched").alias("matched"), F.col("best.share").alias("share")), "found")
    discard(docs.sparkSession, path)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no item is found. A row is judged by its own text, whatever other rows share its id or have none."""
    key = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    dirty = found(docs.select(key.alias("doc_id"), F.col(text).alias("text")), items).select(F.col("doc_id").alias("__dirty")).distinct()
    return docs.join(dirty, key == F.col("__dirty"), "left_anti")

"""Joins with the tie rules of record linkage: first wins, unique only, cascades of keys, time and interval conditions, blocked pairs."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registrum.functions.names import generic
from registrum.functions.text import name_key
from registrum.session import staged

from .needles import found


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in `order`."""
    return rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__turn = 1").drop("__turn")


def unique_only(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left joined with right where right has exactly one row of the key; counted before the join, so crowded keys never meet."""
    single = right.groupBy(*key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in key]).where("__n = 1").drop("__n")
    return left.join(single, key)


def cascade(left: DataFrame, listed: DataFrame, keys: list[tuple[str, list[str]]], order: str, uid: str = "uid") -> DataFrame:
    """left with `tier` and `hit` (a struct of the listed row): the first of the named keys that matches, and of its matches the first by `order`. Null keys match nothing."""
    payload = F.struct(*[F.col(c) for c in listed.columns]).alias("rec")
    out = left
    for tier, key in keys:
        side = listed.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.min_by(F.struct(*listed.columns), F.col(order)).alias(f"hit_{tier}"))
        out = out.join(side, key, "left")
    tiers = [t for t, _ in keys]
    tier = F.coalesce(*[F.when(F.col(f"hit_{t}").isNotNull(), F.lit(t)) for t in tiers])
    return out.withColumn("tier", tier).withColumn("hit", F.coalesce(*[F.col(f"hit_{t}") for t in tiers])).drop(*[f"hit_{t}" for t in tiers])


def registry_index(rows: DataFrame, active: tuple[str, ...] = ("ACTIVE", "OPEN")) -> DataFrame:
    """name_key and active of a business registry (name, status): a name is active if any of its rows is; one without a status counts as active."""
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    good = status.isin(*active) | (F.coalesce("status", F.lit("")) == "")
    return rows.select(name_key(F.col("name")).alias("name_key"), good.alias("active")).where("name_key <> ''").groupBy("name_key").agg(F.bool_or("active").alias("active"))


def active_match(left: DataFrame, registry: DataFrame, names: list[str], name: str = "name_key", active: str = "active") -> DataFrame:
    """left with `found` (none, active, inactive): any active registry row of one of the name keys, else any row."""
    best = registry.groupBy(name).agg(F.bool_or(active).alias("__a"))
    out, seen = left, []
    for k, c in enumerate(names):
        out = out.join(best.select(F.col(name).alias(c), F.col("__a").alias(f"__a{k}")), c, "left")
        seen.append(F.col(f"__a{k}"))
    some = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in seen])
    found = F.when(some, "active").when(F.coalesce(*seen).isNotNull(), "inactive").otherwise("none")
    return out.withColumn("found", found).drop(*[f"__a{k}" for k in range(len(names))])


def after(facts: DataFrame, bars: DataFrame, covers: Column | None = None) -> DataFrame:
    """Facts (uid, program, year, amount) of a barred uid dated in a later year than the bar (uid, bar_year), where the bar covers them."""
    met = facts.join(bars, "uid").where("year > bar_year")
    return met if covers is None else met.where(covers)


def _starting(points: DataFrame, spans: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
    """spans and __place: the places, in order of `start` within the key, of the points that start from `low` to `high`. A sorted sweep counts the points
    before either end, so a key costs its points, its spans and its output, never their product."""
    marks = points.select(key, F.col("start").cast("string").alias("__x"), F.lit(1).alias("__turn"), F.lit(None).cast("long").alias("__span"))
    ends = spans.select(key, F.explode(F.array(F.struct(low.alias("x"), F.lit(0).alias("turn")), F.struct(high.alias("x"), F.lit(2).alias("turn")))).alias("__e"), "__span")
    swept = marks.unionByName(ends.select(key, F.col("__e.x").alias("__x"), F.col("__e.turn").alias("__turn"), "__span"))
    before = F.count_if(F.col("__turn") == 1).over(Window.partitionBy(key).orderBy("__x", "__turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = swept.withColumn("__n", before).where("__span is not null").groupBy("__span").agg(F.min("__n").alias("__lo"), F.max("__n").alias("__hi"), F.max_by("__n", "__turn").alias("__last"))
    counted = counted.where("__hi > __lo and __last = __hi")  # windows that end before they start hold nothing
    return counted.select("__span", F.explode(F.sequence(F.col("__lo") + 1, F.col("__hi"))).alias("__place"))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of a key whose windows (start, end; end may be open) overlap; starts must be known, and null keys meet nothing.

    Of two windows that overlap one starts inside the other. Each side's windows are numbered by their start, a sweep gives every window the range of
    numbers that start inside it, and the pairs are looked up by number: a key with many windows costs its output, not its square."""
    late = F.lit("9999-12-31")

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.where(F.col(key).isNotNull() & F.col("start").isNotNull())
        return staged(rows.withColumn("__span", F.monotonically_increasing_id()), name)

    def places(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy("start", "__span")).cast("long"))

    a, b = numbered(left, "windows"), numbered(right, "windows")
    others = [c for c in right.columns if c not in (key, "start", "end")]
    until, begin = F.coalesce(F.col("end").cast("string"), late), F.col("start").cast("string")
    inside = a.join(_starting(b, a, key, begin, until), "__span").drop("__span")  # the right one starts in the left one
    met = inside.join(places(b).select(key, "__place", F.col("start").alias("start2"), F.col("end").alias("end2"), *others), [key, "__place"]).drop("__place")
    # The left one starts in the right one, and later: by a character that is below all others, no start lies between.
    around = b.join(_starting(a, b, key, F.concat(begin, F.lit("\0")), until), "__span").select(key, "__place", F.col("start").alias("start2"), F.col("end").alias("end2"), *others)
    met = met.unionByName(around.join(places(a).drop("__span"), [key, "__place"]).drop("__place"))
    return met.where((begin <= F.coalesce(F.col("end2").cast("string"), late)) & (until >= F.col("start2").cast("string"))).select(*left.columns, "start2", "end2", *others)


def words(text: Column) -> Column:
    """The different words of a text, cut at white space as Python's split() does."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))


def blocked_pairs(rows: DataFrame, near: Column, least: int = 5, most: int = 40, also: dict[str, Column] | None = None) -> DataFrame:
    """Pairs of rows (uid, text, block), uid below uid2, that share a word of `least` or more characters, the block or the whole text, where 2 to
    `most` rows have it. `near` is a condition that all wanted pairs fulfil, over the lengths n and n2, the hashes of the word sets same and same2, and
    what `also` makes of a text (name and name2); it holds before texts are joined."""
    also = also or {}
    rows = rows.where("text is not null")
    # A word has no blank in it, so that the other two kinds of keys can't be taken for one.
    others = F.array(F.concat(F.lit("block "), "block"), F.concat(F.lit("text "), F.sha2("text", 256)))
    known = rows.select("uid", F.length("text").alias("n"), words(F.col("text")).alias("words"), others.alias("others"), *[c.alias(k) for k, c in also.items()])
    keys = F.filter(F.concat(F.filter("words", lambda w: F.length(w) >= least), "others"), lambda k: k.isNotNull())
    known = known.select("uid", "n", F.xxhash64(F.array_sort("words")).alias("same"), *also, F.explode(keys).alias("word"))
    rows = rows.select("uid", "text")
    sized = known.groupBy("word").agg(F.count_distinct("uid").alias("members")).where(F.col("members").between(2, most))
    kept = known.join(sized.select("word"), "word")
    other = kept.select("word", F.col("uid").alias("uid2"), F.col("n").alias("n2"), F.col("same").alias("same2"), *[F.col(k).alias(f"{k}2") for k in also])
    pairs = kept.join(other, "word").where("uid < uid2").where(near).select("uid", "uid2").distinct()
    return pairs.join(rows, "uid").join(rows.select(F.col("uid").alias("uid2"), F.col("text").alias("text2")), "uid2").select("uid", "uid2", "text", "text2")


def name_pairs(rows: DataFrame, near: Column, least: int = 5, most: int = 40, also: dict[str, Column] | None = None) -> DataFrame:
    """blocked_pairs of the name keys of organizations (uid, name): of five characters or more, not generic, different, sharing a word."""
    keys = rows.select("uid", name_key(F.col("name")).alias("text")).where((F.length("text") >= least) & ~generic(F.col("text")))
    return blocked_pairs(keys.withColumn("block", F.lit(None).cast("string")), near, least, most, also).where("text <> text2")


#: The characters of a name key.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "


def letter_counts(text: Column) -> Column:
    """How often each of LETTERS is in a text, and how many other characters it has."""
    known = [F.length(text) - F.length(F.replace(text, F.lit(c))) for c in LETTERS]
    return F.array(*known, F.length(text) - reduce(lambda a, b: a + b, known)).cast("array<smallint>")


def near_pairs(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """name_pairs that may reach the ratio `least`: matching blocks hold no more characters than the two texts have in common, whatever their order, so a pair that
    has too few goes before any text is joined or handed to Python."""
    common = F.aggregate(F.zip_with("letters", "letters2", lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda total, x: total + x)
    near = ((2.0 * F.least("n", "n2")) / (F.col("n") + F.col("n2")) >= least) & ((2.0 * common) / (F.col("n") + F.col("n2")) >= least) | (F.col("same") == F.col("same2"))
    return name_pairs(rows, near, also={"letters": letter_counts(F.col("text"))})


def near_names(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs uid, uid2 of organizations whose name keys are alike by `least`, with their ratio."""
    return near_pairs(rows, least).withColumn("ratio", ratio("text", "text2", least)).where(F.col("ratio") >= least).select("uid", "uid2", "ratio")


def ratio(left: str, right: str, least: float = 0.0) -> Column:
    """Similarity of two names: 1 for equal word sets, else the share of characters in matching blocks. Where that can't reach `least`, a higher
    value that doesn't either. No built-in function has it."""

    def one(x: str, y: str) -> float:
        if set(x.split()) == set(y.split()):
            return 1.0
        m = difflib.SequenceMatcher(None, x, y)
        bound = m.quick_ratio() if least else 1.0
        return m.ratio() if bound >= least else bound

    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")

    return F.pandas_udf(compared, "double")(left, right)


def covers_tokens(left: Column, right: Column) -> Column:
    """Whether every word of `left` is one of `right`."""
    return F.size(F.array_except(F.split(left, " "), F.split(right, " "))) == 0


def supersets(rows: DataFrame, subsets: DataFrame) -> DataFrame:
    """uid and subset for rows (uid, name) whose words hold all words of a subset (subset). They meet on the subset's rarest word, so no common word gathers everything; names are made distinct first."""
    names = rows.select("name").distinct().select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    often = names.groupBy("word").agg(F.count("*").alias("n"))
    wanted = subsets.select("subset", F.explode(F.array_distinct(F.split("subset", " "))).alias("word")).join(often, "word", "left")
    rarest = wanted.groupBy("subset").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "word")).alias("r")).select("subset", F.col("r.word").alias("word"))
    met = names.join(rarest, "word").where(covers_tokens(F.col("subset"), F.col("name"))).select("name", "subset")
    return rows.join(met, "name").select("uid", "subset")


#: Characters of the pieces by which short needles meet texts; pairs of lengths of two words that are told apart.
GRAM, PAIRS = 4, 25


def needle_keys(needles: DataFrame) -> tuple[DataFrame, list[Column]]:
    """needle and keys of the different needles, and the arrays of keys of a column `text` that can meet them.

    The inner words of a needle of three or more words are whole words of every text that holds it. Of two words the first ends a word of the text and the second
    begins one, so the key is the end of the one, the blank and the beginning of the other: both words whole while the needles have at most
    PAIRS pairs of lengths, else their last and first 1, 2, 4, 8 or 16 characters. A text has one such key a blank and pair of lengths. Of any other needle, which may start or
    end inside a word, every run of GRAM characters (all of it, if it has fewer) is one of the text's."""
    needles = staged(needles.select("needle").distinct(), "needles")
    parts = F.split("needle", " ")
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))), lambda w: w != "")
    long, two = (F.size(parts) >= 3) & (F.size(inner) > 0), (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    whole = needles.where(two).select(F.length(first), F.length(second)).distinct().limit(PAIRS + 1).count() <= PAIRS
    cut = lambda w: F.length(w) if whole else F.greatest(F.lit(1), *[F.when(F.length(w) >= n, n) for n in (2, 4, 8, 16)])

    def runs(text: str, n: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda x: F.concat(F.lit(f"{n}:"), x))

    size = F.when(~long & ~two, F.least(F.length("needle"), F.lit(GRAM)))
    own = F.when(long, F.transform(inner, lambda w: F.concat(F.lit("w:"), w)))
    own = own.when(two, F.array(F.concat(F.lit("p:"), F.right(first, cut(first)), F.lit(" "), F.left(second, cut(second)))))
    for n in range(1, GRAM + 1):
        own = own.when(size == n, runs("needle", n))
    kinds = needles.select(long.alias("long"), F.when(two, cut(first)).alias("a"), F.when(two, cut(second)).alias("b"), size.alias("size")).distinct().collect()  # GRAM + PAIRS + 1 at most
    keys = [F.transform(F.split("text", " "), lambda w: F.concat(F.lit("w:"), w))] if any(k["long"] for k in kinds) else []
    for a, b in sorted({(k["a"], k["b"]) for k in kinds if k["a"]}):
        keys.append(F.transform(F.regexp_extract_all("text", F.lit(f"(?=([^ ]{{{a}}} [^ ]{{{b}}}))"), F.lit(1)), lambda x: F.concat(F.lit("p:"), x)))
    keys += [runs("text", n) for n in sorted({k["size"] for k in kinds if k["size"]})]
    return needles.select("needle", F.array_distinct(own).alias("keys")), keys


#: Rows and bytes of needles that are few enough to broadcast.
FEW, FEW_BYTES = 20_000, 1 << 22


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """uid and item_id for texts (uid, text) that hold a needle (item_id, needle) as it stands. Empty needles are nowhere.

    The pieces of a text that look like needles are found where the text is read (needles.found) and meet the needles as they stand, so what is sent grows
    with the result. Needles are broadcast while they are few, and merged beyond that: their files are far smaller than their rows, and the driver would hold
    them all."""
    needles = staged(needles.where("needle <> ''").select("item_id", F.col("needle").cast("binary").alias("needle")), "needles")
    rows, size = needles.agg(F.count("*"), F.sum(F.length("needle"))).first()
    if not rows:
        return texts.join(needles, F.lit(False)).select("uid", "item_id")
    other = F.broadcast(needles) if rows <= FEW and size <= FEW_BYTES else needles.hint("merge")
    return found(texts, needles).join(other, "needle").select("uid", "item_id").distinct()


def merge(old: DataFrame, new: DataFrame, key: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """old with new laid over it by key: a null in new leaves the old value; missing ones take the default."""
    a, b, defaults = old.alias("a"), new.alias("b"), defaults or {}
    out = [F.coalesce(f"b.{key}", f"a.{key}").alias(key)]
    for c in old.columns:
        if c != key:
            out.append(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"), F.lit(defaults.get(c))).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*out)

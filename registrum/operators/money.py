"""Money attached to entities: roll-ups, outliers and year-over-year tests over facts (uid, program, period, amount)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registrum.functions.text import first_of


def rollup(facts: DataFrame) -> DataFrame:
    return facts.groupBy("uid", "program", "period").agg(F.round(F.sum("amount"), 2).cast("double").alias("amount"))


def dominant_program(facts: DataFrame) -> DataFrame:
    """Per uid the program with the most money (ties: first by name), its amount and the uid's total."""
    per = facts.groupBy("uid", "program").agg(F.round(F.sum("amount"), 2).cast("double").alias("amount"))
    top = Window.partitionBy("uid").orderBy(F.desc("amount"), "program")
    whole = Window.partitionBy("uid")
    return per.withColumn("total", F.round(F.sum("amount").over(whole), 2)).withColumn("turn", F.row_number().over(top)).where("turn = 1").drop("turn")


def ranked(rows: DataFrame, group: str | None, value: str) -> DataFrame:
    """Per group and value, how many rows have it (n), a smaller one (below), and how many the group has (size). Nulls take no part.

    No group has to fit a task: values are counted first, ranked inside coarse buckets of their logarithm, and the buckets, a few thousand at
    most, are summed up from below."""
    keys = [group] if group else []
    v = F.col(value)
    counts = rows.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*keys, value).agg(F.count("*").alias("n"))
    # 1,024 steps a power of two; below zero in reverse
    size_of = F.floor(F.log2(F.abs(v.cast("double")) + 1) * 1024)
    counts = counts.withColumn("__bucket", F.when(v < 0, -size_of - 1).otherwise(size_of))
    sums = counts.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = sums.select(*keys, "__bucket", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__below"), F.sum("__m").over(whole).alias("size"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    met = counts.join(sums, [*keys, "__bucket"])
    return met.select(*keys, value, "n", (F.col("__below") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"), "size")


def nearest_rank(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """Per group the value at the (half-even rounded) rank share * (n - 1), counted from 0."""
    rank = F.bround(F.lit(share) * (F.col("size") - 1), 0)
    return ranked(rows, group, value).where((F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))).select(group, F.col(value).alias("at_rank"))


def interpolated(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row, `cut`: the percentile of all values, by linear interpolation between the two ranks around it."""
    at = F.lit(share) * (F.col("size") - 1)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    ends = ranked(rows, None, value).where(holds(low) | holds(high)).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.first(at - low).alias("part"))
    return ends.select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("cut"))


def outliers(dominant: DataFrame, share: float = 0.95, least: float = 100_000.0) -> DataFrame:
    """uids whose total is at or over the nearest-rank percentile of their dominant program, and large."""
    cut = nearest_rank(dominant, "program", "total", share)
    return dominant.join(cut, "program").where((F.col("total") >= F.col("at_rank")) & (F.col("total") >= least))


def spikes(yearly: DataFrame, ratio: float = 2.0, least: float = 25_000.0, rise: float = 10_000.0) -> DataFrame:
    """uids whose last period (uid, period, amount) is at least `ratio` times the one before, large and well above it. A uid of four or more
    periods that fell or stood still through all but the last two is a bounce and left out."""
    by = Window.partitionBy("uid").orderBy("period")
    rows = yearly.withColumn("prev", F.lag("amount").over(by)).withColumn("next", F.lead("period").over(by)).withColumn("turn", F.row_number().over(by))
    step = F.lead("amount").over(by)
    rows = rows.withColumn("falls", F.col("amount") >= step).withColumn("left", F.count("*").over(Window.partitionBy("uid")) - F.col("turn"))
    falling = F.bool_and(F.when(F.col("left") >= 3, F.col("falls"))).over(Window.partitionBy("uid"))
    rows = rows.withColumn("falling", (F.count("*").over(Window.partitionBy("uid")) >= 4) & F.coalesce(falling, F.lit(False)))
    last = rows.where("next is null and prev > 0")
    return last.where((F.col("amount") / F.col("prev") >= ratio) & (F.col("amount") >= least) & (F.col("amount") - F.col("prev") >= rise) & ~F.col("falling")).select("uid", "period", "amount", "prev", F.round(F.col("amount") / F.col("prev"), 4).alias("ratio"))


def movers(yearly: DataFrame, ratio: float = 1.6, least: float = 100_000.0, floor: float = 10_000.0, limit: int = 12) -> DataFrame:
    """The `limit` uids whose last period grew most, as a multiple of the one before; ties go to the larger uid. Money of contracts is left out beforehand."""
    by = Window.partitionBy("uid").orderBy("period")
    rows = yearly.withColumn("prev", F.lag("amount").over(by)).withColumn("next", F.lead("period").over(by)).where("next is null")
    rows = rows.where((F.col("prev") > floor) & (F.col("amount") >= least) & (F.col("amount") / F.col("prev") >= ratio))
    return rows.select("uid", "period", "amount", "prev", (F.col("amount") / F.col("prev")).alias("ratio")).orderBy(F.desc("ratio"), F.desc("uid")).limit(limit)


def series(yearly: DataFrame) -> DataFrame:
    """Per uid its periods in order, as years and amounts."""
    kept = F.array_sort(F.collect_list(F.struct("period", "amount")))
    return yearly.groupBy("uid").agg(kept.alias("s")).select("uid", F.col("s.period").alias("periods"), F.col("s.amount").alias("amounts"))


def contiguous(yearly: DataFrame, least: int = 3, since: DataFrame | None = None, gap: int = 2) -> DataFrame:
    """uids with at least `least` years and no gap between them; with since (uid, year), only where the first of them follows within `gap` years."""
    if since is not None:
        met = yearly.join(since.select("uid", "year"), "uid").where("period > year")
        near = met.groupBy("uid").agg(F.min(F.col("period") - F.col("year")).alias("after")).where(F.col("after") <= gap)
        yearly = met.join(near, "uid", "left_semi").drop("year")
    rows = yearly.groupBy("uid").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count_distinct("period").alias("years"))
    return rows.where((F.col("last") - F.col("first") + 1 == F.col("years")) & (F.col("years") >= least))


def top_codes(rows: DataFrame, k: int = 5) -> DataFrame:
    """Per uid the k codes with the most money, ranked."""
    per = rows.groupBy("uid", "code").agg(F.round(F.sum("amount"), 2).alias("amount"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("amount"), "code"))).where(F.col("rank") <= k)


def conditional(rows: DataFrame, key: str, counts: dict[str, Column], sums: dict[str, tuple[Column, str]]) -> DataFrame:
    """Per key its rows (n), how many fulfil each condition of `counts`, and the sums of a column over those that fulfil each of `sums`, to the cent."""
    made = [F.count_if(c).alias(k) for k, c in counts.items()] + [F.round(F.sum(F.when(c, F.col(v)).otherwise(0)), 2).alias(k) for k, (c, v) in sums.items()]
    return rows.groupBy(key).agg(F.count("*").alias("n"), *made)


def tiered(rows: DataFrame, key: str, value: str, tiers: list[tuple[str, Column]], rest: str) -> DataFrame:
    """tier, n and funds: keys by the first tier whose condition any of their rows fulfils, and their money."""
    level = F.min(first_of(*[(c, k) for k, (_, c) in enumerate(tiers)], default=len(tiers)))
    per = rows.groupBy(key).agg(F.round(F.sum(value), 2).alias("total"), level.alias("level"))
    return per.groupBy(first_of(*[(F.col("level") == k, F.lit(name)) for k, (name, _) in enumerate(tiers)], default=F.lit(rest)).alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("funds"))


def year_span(rows: DataFrame, key: str, year: Column) -> DataFrame:
    """Per key its years as `first–last`, and how many there are."""
    return rows.groupBy(key).agg(F.concat(F.min(year).cast("string"), F.lit("–"), F.max(year).cast("string")).alias("range"), F.count_distinct(year).alias("years"))


def tracked_sums(rows: DataFrame, tracked: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Per key the rows and money of those whose `by` is tracked: cut by a semi-join before the shuffle."""
    return rows.join(tracked, by, "left_semi").groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("amount"))


def dominance(rows: DataFrame, share: float = 0.85, least: float = 50_000.0, mismatched: DataFrame | None = None) -> DataFrame:
    """uids with one code for at least `share` of a large total; not those whose identity is mismatched (uid), whose money may be another's."""
    rows = rows if mismatched is None else rows.join(mismatched.select("uid"), "uid", "left_anti")
    top = top_codes(rows, 1).drop("rank")
    total = rows.groupBy("uid").agg(F.round(F.sum("amount"), 2).alias("total"))
    out = top.join(total, "uid").withColumn("share", F.round(F.col("amount") / F.col("total"), 4))
    return out.where((F.col("share") >= share) & (F.col("total") >= least))


def chain_dates(events: DataFrame, least: int = 4) -> DataFrame:
    """Of events (uid, date): how many distinct dates of a uid are its own, and how many are shared by at least `least` uids."""
    dates = events.select("uid", "date").distinct()
    shared = dates.groupBy("date").agg(F.count("*").alias("n"))
    return dates.join(shared, "date").groupBy("uid").agg(F.count_if(F.col("n") < least).alias("own"), F.count_if(F.col("n") >= least).alias("chain"))


def rank_severity(rows: DataFrame, value: str, low: float = 6.0, spread: float = 14.0) -> DataFrame:
    """Positive values with their percentile rank and a half-even rounded severity that grows with it."""
    ranks = ranked(rows.where(F.col(value) > 0), None, value).select(value, ((F.col("below") + F.col("n")) / F.col("size")).alias("percentile"))
    return rows.join(ranks, value).withColumn("severity", F.bround(low + spread * F.col("percentile"), 0))

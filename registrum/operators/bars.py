"""Money dated against a bar: one row of dispositions per barred entity, from dated facts and dated bars.

Inputs. entities: uid, status, identity (grade of the match behind the money), expiry_year, reissue_year. facts: uid, program, year, amount.
bars: uid, list, bar_year, scope (empty: all programs, else a word that the covered programs' names hold). Per program the earliest formal
bar that covers it counts, else the expiry of a barred credential as a proxy, unless the credential was issued again later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registrum.functions.text import first_of

# Statuses that bar, statuses that are adverse, and identity grades that mean another person.
BARRED = ["REVOKED", "SUSPENDED", "TERMINATED", "SURRENDER", "VOLUNTARY SURRENDER"]
ADVERSE = [*BARRED, "EXPIRED", "DENIED", "INACTIVE"]
MISMATCH = ["license-mismatch", "dob-mismatch", "taxonomy-mismatch"]


def covers(scope: Column, program: Column) -> Column:
    """Whether a list's scope takes in a program."""
    return (F.coalesce(scope, F.lit("")) == "") | F.contains(F.upper(program), F.upper(scope))


def by_dollars(amount: Column) -> Column:
    return first_of((amount < 1_000, 22.0), (amount < 25_000, 35.0), (amount < 100_000, 45.0), default=50.0)


def aged(severity: Column, age: Column) -> Column:
    """Severity of money whose last year lies `age` years before the data's end."""
    old, older = F.greatest(F.lit(10.0), F.bround(severity * 0.6, 0)), F.greatest(F.lit(8.0), F.bround(severity * 0.3, 0))
    return first_of((age >= 8, older), (age >= 5, old), default=severity)


def proxies(entities: DataFrame) -> DataFrame:
    """uid and proxy_year of barred credentials that weren't issued again after they ran out."""
    valid = F.upper(F.trim("status")).isin(BARRED) & F.col("expiry_year").isNotNull() & ~(F.coalesce("reissue_year", F.lit(0)) > F.col("expiry_year"))
    return entities.where(valid).select("uid", F.col("expiry_year").alias("proxy_year"))


def program_bars(entities: DataFrame, facts: DataFrame, bars: DataFrame, first: int = 2006) -> DataFrame:
    """uid, program, bar_year and formal of each program with money, from bars of the year `first` on."""
    programs = facts.select("uid", "program").distinct()
    formal = programs.join(bars.where(F.col("bar_year") >= first), "uid").where(covers(F.col("scope"), F.col("program"))).groupBy("uid", "program").agg(F.min("bar_year").alias("formal_year"))
    out = programs.join(formal, ["uid", "program"], "left").join(proxies(entities).where(F.col("proxy_year") >= first), "uid", "left")
    return out.select("uid", "program", F.coalesce("formal_year", "proxy_year").alias("bar_year"), F.col("formal_year").isNotNull().alias("formal")).where("bar_year is not null")


def _by_program(adverse: DataFrame, facts: DataFrame, bars: DataFrame, recent: int, first: int) -> DataFrame:
    """Per uid and program with money: its bar, its money after the bar (in the window or, for a confirmed identity and years without a gap, in
    all years), what the window leaves out, the money of the bar's year, and the money of each year."""
    yearly = facts.groupBy("uid", "program", "year").agg(F.sum("amount").alias("amount"))
    rows = yearly.join(program_bars(adverse, facts, bars, first), ["uid", "program"], "left").join(adverse.select("uid", "identity"), "uid")
    later = (F.col("year") > F.col("bar_year")) & (F.col("amount") != 0)
    near = later & (F.col("year") <= F.col("bar_year") + recent)
    nothing = F.lit(0.0)
    out = rows.groupBy("uid", "program", "bar_year", "formal", "identity").agg(
        F.sum("amount").alias("total"), F.max("year").alias("last"), F.coalesce(F.sum(F.when(F.col("year") == F.col("bar_year"), F.col("amount"))), nothing).alias("same"),
        F.min(F.when(later, F.col("year"))).alias("later_from"), F.max(F.when(later, F.col("year"))).alias("later_to"), F.count_if(later).alias("later_n"), F.coalesce(F.sum(F.when(later, F.col("amount"))), nothing).alias("later_sum"),
        F.max(F.when(near, F.col("year"))).alias("near_to"), F.coalesce(F.sum(F.when(near, F.col("amount"))), nothing).alias("near_sum"),
        F.map_from_entries(F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", "amount")))).alias("by_year"),
    )
    whole = (F.col("identity") == "license-confirmed") & (F.col("later_to") - F.col("later_from") + 1 == F.col("later_n")) & (F.col("later_from") - F.col("bar_year") <= recent)
    whole = F.coalesce(whole, F.lit(False))
    out = out.withColumn("after", F.when(whole, F.col("later_sum")).otherwise(F.col("near_sum"))).withColumn("after_to", F.when(whole, F.col("later_to")).otherwise(F.col("near_to")))
    out = out.withColumn("dropped", F.col("later_sum") - F.col("after")).withColumn("refills", F.contains("program", F.lit("Part D")))
    own = Window.partitionBy("uid")
    out = out.withColumn("refill_bar", F.max(F.when(F.col("refills") & F.col("after_to").isNotNull(), F.col("bar_year"))).over(own))
    before = F.coalesce(F.try_element_at("by_year", F.col("refill_bar")), nothing) + F.coalesce(F.try_element_at("by_year", F.col("refill_bar") - 1), nothing)
    return out.withColumn("prior", F.when(F.col("refills") & F.col("after_to").isNotNull(), before).otherwise(nothing))


def dispositions(entities: DataFrame, facts: DataFrame, bars: DataFrame, horizon: int, recent: int = 6, first: int = 2006, by_name: str = "WA state") -> DataFrame:
    """What the dates say of every adverse entity with money: uid, rule_id, severity, after_amount, runoff, last_year, bar_year, same_amount,
    dropped (after the window), unobservable (the bar is at or past the data's end) and out_of_scope.

    Another person's identifier, or money matched by name only (all programs start with `by_name`), leaves the attribution unconfirmed.
    Money after the bar counts unless it is a trivial tail; refills that end within a year of the bar are runoff; old money weighs less.
    Money that ends before the bar, or in its year where the data run on, is information; the rest is the soft rule."""
    adverse = entities.where(F.upper(F.trim("status")).isin(ADVERSE))
    facts = facts.join(adverse.select("uid"), "uid", "left_semi").where("amount is not null")
    some = F.col("after_to").isNotNull()
    sums = _by_program(adverse, facts, bars, recent, first).groupBy("uid").agg(
        F.sum("total").alias("total"), F.max("last").alias("last_year"), F.sum("after").alias("after"), F.max("after_to").alias("after_to"), F.sum("same").alias("same"), F.sum("dropped").alias("dropped"), F.sum("prior").alias("prior"),
        F.max("refill_bar").alias("refill_bar"), F.bool_and(F.when(some, F.col("refills"))).alias("only_refills"), F.max(F.when(some, F.col("bar_year"))).alias("applied_to"), F.min(F.when(some, F.col("bar_year"))).alias("applied_from"),
        F.bool_and(F.col("program").startswith(by_name)).alias("named"),
    ).where("total > 0")
    formal = bars.groupBy("uid").agg(F.min("bar_year").alias("formal_year"))
    rows = adverse.select("uid", "identity").join(sums, "uid").join(formal, "uid", "left").join(proxies(adverse), "uid", "left")
    rows = rows.withColumn("any_bar", F.coalesce("formal_year", "proxy_year"))

    doubtful = F.coalesce(F.col("identity").isin(MISMATCH), F.lit(False)) | F.col("named")
    after, total, bar, last = F.col("after"), F.col("total"), F.col("any_bar"), F.col("last_year")
    trivial = F.col("after_to").isNotNull() & (after < F.greatest(F.lit(1000.0), 0.02 * total)) & (after <= 0.5 * total)
    counted = F.col("after_to").isNotNull() & ~trivial & ~doubtful
    runoff = counted & F.coalesce(F.col("only_refills") & (F.col("after_to") <= F.col("refill_bar") + 1) & (F.col("prior") > 0) & (after < 0.35 * F.col("prior")), F.lit(False))
    hard = F.when(runoff, F.least(by_dollars(after), F.lit(20.0))).otherwise(by_dollars(after))
    hard = F.when(after >= 100_000, hard).otherwise(aged(hard, F.lit(horizon) - F.col("after_to")))

    ceased = F.coalesce((last < bar) | ((F.lit(horizon) > bar) & ((last == bar) | trivial)), F.lit(False)) & ~counted & ~doubtful
    unseen, beyond = F.coalesce(bar > horizon, F.lit(False)), F.coalesce(last > bar, F.lit(False))
    soft = F.when(unseen, 14.0).otherwise(35.0)
    soft = F.when(beyond & ~unseen, F.least(soft, F.lit(18.0))).otherwise(soft)
    soft = first_of((total < 1_000, F.least(soft, F.lit(15.0))), (total < 25_000, F.least(soft, F.lit(28.0))), default=soft)
    soft = aged(soft, F.lit(horizon) - last)

    rule = first_of((doubtful, "paid_attribution_unconfirmed"), (counted, "paid_after_barred"), (ceased, "paid_before_bar"), default="paid_while_sanctioned")
    severity = first_of((doubtful, F.lit(8.0)), (counted, hard), (ceased, F.lit(10.0)), default=soft)
    shown = F.when(counted & (F.col("applied_from") == F.col("applied_to")), F.col("applied_to")).otherwise(bar)
    quiet = ~counted & ~doubtful
    return rows.select(
        "uid", rule.alias("rule_id"), severity.alias("severity"), F.round("after", 2).alias("after_amount"), runoff.alias("runoff"), "last_year", shown.alias("bar_year"), F.round("same", 2).alias("same_amount"), F.round("dropped", 2).alias("dropped"),
        (quiet & F.coalesce(bar >= horizon, F.lit(False)) & (ceased | unseen)).alias("unobservable"), (quiet & ~ceased & beyond & ~unseen).alias("out_of_scope"),
    )


def identity_grade(own_core: Column, npi_cores: Column, own_birth: Column, listed_birth: Column, by_npi: Column, own_city: Column, listed_city: Column) -> Column:
    """How sure the match between an entity and the identifier behind its money is; the first condition that holds."""
    known = (own_core != "") & (F.size(npi_cores) > 0)
    births = own_birth.isNotNull() & listed_birth.isNotNull()
    return first_of(
        (known & F.array_contains(npi_cores, own_core), "license-confirmed"), (known, "license-mismatch"), (by_npi & births & (own_birth == listed_birth), "dob-confirmed"), (by_npi & births, "dob-mismatch"), (by_npi, "exclusion-npi"), ((own_city != "") & (own_city == listed_city), "city-match"),
        default="name-only",
    )

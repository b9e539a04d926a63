"""Money from its sources to entities: contracts, payments by provider number, bulk extracts, and the facts that operators need of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions.text import money, name_key, year

from .linkage import first_wins, unique_only

#: Sources whose ids are provider numbers; the money of agencies' contracts.
NUMBERED, CONTRACTS = ("aba", "nemt", "dme"), "WA agency contract"
# Rules that make a member sanctioned or barred, that say nothing but quality, and that date money after a bar.
SANCTIONED = ["excluded_or_sanctioned", "excluded_license_derived", "paid_while_sanctioned", "paid_after_barred", "credential_revoked_or_suspended", "credential_surrendered", "credential_active_with_conditions", "disciplinary_action_taken"]
BARRED = ["excluded_or_sanctioned", "paid_after_barred", "paid_while_sanctioned", "credential_revoked_or_suspended", "credential_surrendered"]
QUALITY = ["immediate_jeopardy_citation", "civil_monetary_penalty", "many_health_deficiencies", "low_quality_rating"]
DATED = ["paid_after_barred", "paid_while_sanctioned", "paid_attribution_unconfirmed"]


def contract_payments(entities: DataFrame) -> DataFrame:
    """uid, program, period and amount of contracts: of the snapshots of a number and vendor the newest, so that no contract counts twice. The period is
    `start → end`, else the snapshot's fiscal year."""
    rows = entities.where("source like 'contracts%' and amount is not null")
    newest = first_wins(rows.withColumn("__vendor", F.upper(F.coalesce("name", F.lit("")))), ["source_id", "__vendor"], [F.desc("source"), "uid"])
    day = lambda field: F.left(F.coalesce(F.col("raw")[field], F.lit("")), F.lit(10))
    shown = F.regexp_replace(F.concat(day("contract_effective_start"), F.lit(" → "), day("contract_effective_end_date")), "^[ →]+|[ →]+$", "")
    fiscal = F.when(F.col("source").contains("_"), F.concat(F.lit("FY20"), F.right(F.substring_index("source", "_", -1), F.lit(2)))).otherwise("FY2022")
    return newest.select("uid", F.lit(CONTRACTS).alias("program"), F.when(shown != "", shown).otherwise(fiscal).alias("period"), "amount")


def provider_numbers(entities: DataFrame, crosswalk: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """npi and uid, one entity a number: its own id where the source has such, else the crosswalk's (uid, npi). Of several entities the last uid counts."""
    rows = entities if sources is None else entities.where(F.col("source").isin(sources))
    met = rows.join(crosswalk.select("uid", F.col("npi").alias("__npi")), "uid", "left")
    npi = F.when(F.col("source").isin(*NUMBERED), F.col("source_id")).otherwise(F.col("__npi"))
    return met.select("uid", npi.alias("npi")).where("coalesce(npi, '') <> ''").groupBy("npi").agg(F.max("uid").alias("uid"))


def tracked_numbers(*sides: DataFrame) -> DataFrame:
    """The different numbers (npi) of all sides, blanks aside."""
    return reduce(DataFrame.unionByName, [x.select("npi") for x in sides]).where("coalesce(npi, '') <> ''").distinct()


def unresolved(crosswalk: DataFrame, entities: DataFrame) -> DataFrame:
    """uid and name of crosswalk rows (uid, npi, city, licenses) that have a number but no city or licences yet: what to look up again."""
    bare = crosswalk.where("coalesce(npi, '') <> '' and (coalesce(city, '') = '' or licenses is null)")
    return bare.select("uid").join(entities.select("uid", "name"), "uid")


def field(rows: DataFrame, name: str) -> Column:
    """The column of that name, whatever its case."""
    found = next((c for c in rows.columns if c == name), None) or next((c for c in rows.columns if c.lower() == name.lower()), None)
    if found is None:
        raise ValueError(f"no column {name} among {rows.columns}")
    return F.col(f"`{found}`")


def provider_payments(years: dict[str, DataFrame], numbers: DataFrame, program: str, npi: str, amount: str, state: tuple[str, str] | None = None) -> DataFrame:
    """uid, program, period and amount of yearly payment files by provider number. state: a field and its value; a year in which other states stand
    there was delivered unfiltered and only its rows of the state count."""
    out = None
    for period, rows in sorted(years.items(), reverse=True):
        if state is not None:
            rows = rows.where(F.upper(field(rows, state[0])) == state[1].upper())
        paid = rows.select(field(rows, npi).cast("string").alias("npi"), money(field(rows, amount).cast("string")).alias("amount"))
        met = paid.where("amount <> 0").join(numbers, "npi").select("uid", F.lit(program).alias("program"), F.lit(period).alias("period"), "amount")
        out = met if out is None else out.unionByName(met)
    if out is None:
        raise ValueError("no years given")
    return out


def spending(lines: DataFrame, tracked: DataFrame) -> DataFrame:
    """Per tracked number (npi) of claim lines (billing, servicing, code, month, patients, lines, paid): total, by_year, lines, patients and the five codes
    with the most money. A line counts for its servicing number if tracked, else for its billing one. The tracked side decides by semi-joins,
    so only its lines are shuffled, and they are summed before."""
    servicing = lines.join(tracked.select(F.col("npi").alias("servicing")), "servicing", "left_semi").withColumn("npi", F.col("servicing"))
    rest = lines.join(tracked.select(F.col("npi").alias("servicing")), "servicing", "left_anti")
    billing = rest.join(tracked.select(F.col("npi").alias("billing")), "billing", "left_semi").withColumn("npi", F.col("billing"))
    own = servicing.unionByName(billing).where("paid is not null")
    per = own.groupBy("npi", F.left("month", F.lit(4)).alias("year"), "code").agg(F.sum("paid").alias("paid"), F.sum("lines").alias("lines"), F.sum("patients").alias("patients"))
    years = per.groupBy("npi", "year").agg(F.round(F.sum("paid"), 2).alias("amount"), F.sum("lines").alias("lines"), F.sum("patients").alias("patients"), F.sum("paid").alias("paid"))
    whole = years.groupBy("npi").agg(F.round(F.sum("paid"), 2).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "amount")))).alias("by_year"), F.sum("lines").alias("lines"), F.sum("patients").alias("patients"))
    codes = per.groupBy("npi", "code").agg(F.round(F.sum("paid"), 2).alias("amount"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("least"), "code"))), 1, 5)
    top = codes.groupBy("npi").agg(F.transform(best, lambda x: F.struct(x["code"].alias("code"), (-x["least"]).alias("amount"))).alias("top_codes"))
    return whole.join(top, "npi")


def spending_payments(spent: DataFrame, numbers: DataFrame, program: str = "Medicaid") -> DataFrame:
    """uid, program, period and amount of spending(), a row for each year with money."""
    rows = spent.select("npi", F.explode("by_year").alias("period", "amount")).where("amount <> 0")
    return rows.join(numbers, "npi").select("uid", F.lit(program).alias("program"), "period", "amount")


def checkbook(rows: DataFrame, tracked: DataFrame, agencies: dict[str, str]) -> DataFrame:
    """Vendors (name_key) of an expenditure file (agency, fiscal_year, vendor, amount) that are tracked (name_key) and paid by one of the agencies: total, by_fy,
    agencies and a name as written."""
    short = F.create_map(*[F.lit(x) for pair in agencies.items() for x in pair])
    own = rows.where(F.trim("agency").isin(*agencies)).withColumn("name_key", name_key(F.trim("vendor"))).where("name_key <> '' and amount <> 0").join(tracked.select("name_key"), "name_key", "left_semi")
    per = own.groupBy("name_key", F.trim("fiscal_year").alias("fy")).agg(F.sum("amount").alias("paid"), F.collect_set(short[F.trim("agency")]).alias("agencies"), F.min("vendor").alias("vendor"))
    return per.groupBy("name_key").agg(F.round(F.sum("paid"), 2).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("fy", F.round("paid", 2).alias("amount"))))).alias("by_fy"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("agencies")))).alias("agencies"), F.min("vendor").alias("vendor"))


def checkbook_payments(entities: DataFrame, vendors: DataFrame) -> DataFrame:
    """uid, program, period and amount of checkbook() vendors whose name exactly one entity has that is no contract; crowded names attribute nothing."""
    named = entities.where("source not like 'contracts%'").select("uid", name_key(F.col("name")).alias("name_key"))
    met = unique_only(vendors, named, ["name_key"])
    label = F.concat(F.lit("WA state ("), F.array_join("agencies", "/"), F.lit(")"))
    return met.select("uid", label.alias("program"), F.explode("by_fy").alias("fy", "amount")).where("amount <> 0").select("uid", "program", F.concat(F.lit("FY"), "fy").alias("period"), "amount")


def horizon(payments: DataFrame, today: str) -> DataFrame:
    """One row, max_year: the latest year with money that isn't a contract's, not beyond this year."""
    rows = payments.where(~F.col("program").startswith(CONTRACTS)).select(F.least(year(F.col("period")), F.year(F.lit(today).cast("date"))).alias("y"))
    return rows.agg(F.max("y").alias("max_year"))


def member_facts(flags: DataFrame, funds: DataFrame) -> DataFrame:
    """uid, funds, sanctioned, barred, quality, contradiction, identity and top_flag of every uid with a flag (entity_uid, rule_id, severity, title, evidence) or money (uid, funds)."""
    rule, seen = F.col("rule_id"), F.try_parse_json("evidence")
    identity = F.try_variant_get(seen, "$.identity_confidence", "string")
    order = F.struct(-F.col("severity"), "rule_id")
    facts = flags.groupBy(F.col("entity_uid").alias("uid")).agg(
        F.bool_or(rule.isin(SANCTIONED)).alias("sanctioned"), F.bool_or(rule.isin(BARRED)).alias("barred"), F.bool_or(rule.isin(QUALITY)).alias("quality"),
        F.coalesce(F.sum(F.when(rule == "paid_after_barred", F.try_variant_get(seen, "$.amount_after", "double"))), F.lit(0.0)).alias("contradiction"),
        F.coalesce(F.min_by(identity, F.when(rule.isin(DATED) & (F.coalesce(identity, F.lit("")) != ""), order)), F.lit("")).alias("identity"), F.min_by("title", order).alias("top_flag"),
    )
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = facts.join(funds, "uid", "full")
    return out.select("uid", F.coalesce("funds", F.lit(0.0)).alias("funds"), no("sanctioned").alias("sanctioned"), no("barred").alias("barred"), no("quality").alias("quality"), F.coalesce("contradiction", F.lit(0.0)).alias("contradiction"), F.coalesce("identity", F.lit("")).alias("identity"), F.coalesce("top_flag", F.lit("")).alias("top_flag"))


def combinations(members: DataFrame) -> DataFrame:
    """label and n: how many operators of members (operator_id, source) have exactly these sources, in order, joined by ` + `."""
    sets = members.groupBy("operator_id").agg(F.array_join(F.array_sort(F.collect_set("source")), " + ").alias("label"))  # as many as there are registries
    return sets.groupBy("label").agg(F.count("*").alias("n"))


def run_summary(flags: DataFrame, payments: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """kind, label, n and amount: flags per rule, money per program and, of members (operator_id, source), operators per combination of sources."""
    rules = flags.groupBy(F.col("rule_id").alias("label")).agg(F.count("*").alias("n")).select(F.lit("rule").alias("kind"), "label", "n", F.lit(0.0).alias("amount"))
    paid = payments.groupBy(F.col("program").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount")).select(F.lit("program").alias("kind"), "label", "n", "amount")
    out = rules.unionByName(paid)
    if members is None:
        return out
    return out.unionByName(combinations(members).select(F.lit("combination").alias("kind"), "label", "n", F.lit(0.0).alias("amount")))

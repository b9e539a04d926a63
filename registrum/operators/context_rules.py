"""Rules that need a side table beside the entities. Each returns uid, rule_id, severity; a side without rows gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions.names import professions_conflict
from registrum.functions.text import first_of, letters, license_core, year

from .money import chain_dates, rank_severity
from .rules import OPEN_BRAND, open_brands


def _flags(rows: DataFrame, rule: Column | str, severity: Column | float) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    severity = severity if isinstance(severity, Column) else F.lit(float(severity))
    return rows.select("uid", rule.alias("rule_id"), severity.cast("double").alias("severity"))


def registration(matched: DataFrame, missing: float = 12.0, inactive: float = 20.0) -> DataFrame:
    """no_active_business_registration, from rows of active_match()."""
    return _flags(matched.where("found <> 'active'"), "no_active_business_registration", F.when(F.col("found") == "none", missing).otherwise(inactive))


# Adverse credential statuses, and identity grades that mean another person.
ADVERSE = ("REVOKED", "SUSPENDED", "EXPIRED", "TERMINATED", "SURRENDER", "VOLUNTARY SURRENDER", "DENIED", "INACTIVE")
MISMATCHED = ("license-mismatch", "dob-mismatch", "taxonomy-mismatch")
# What each list bars, and how its entry is headed, by a word of its name; the first that fits counts.
SCOPES = [
    ("LEIE", "Bars payment by all federal health programs."), ("CMS REVOKED", "Bars billing Medicare; a state's Medicaid decides for itself."),
    ("SAM", "Bars federal awards and contracts; billing of health programs is another list's matter."), ("HCA TERMINATED", "Bars the state's Medicaid only, not Medicare or other federal programs."),
]
TITLES = [("HCA", "Terminated by the state's Medicaid"), ("LEIE", "Excluded from federal health programs"), ("SAM", "Excluded from federal awards"), ("CMS REVOKED", "Revoked from Medicare billing")]


def scope_text(listed: Column) -> Column:
    """What a list bars."""
    name = F.upper(F.coalesce(listed, F.lit("")))
    return first_of(*[(name.contains(k), F.lit(v)) for k, v in SCOPES], default=F.lit("Which programs it bars is to be found out."))


def list_title(listed: Column) -> Column:
    """The headline of an entry; a state's list is never called federal."""
    name = F.upper(F.coalesce(listed, F.lit("")))
    shown = first_of(*[(name.contains(k), F.lit(v)) for k, v in TITLES], default=F.lit("On a list of exclusions"))
    return F.concat(shown, F.lit(" ("), F.coalesce(listed, F.lit("")), F.lit(")"))


def license_derived(code: Column) -> Column:
    """Whether an exclusion restates a state's licence action."""
    return F.regexp_replace(F.lower(F.coalesce(code, F.lit(""))), r"[ ()]", "").rlike("^1128b[45]")


def identity_grade(rows: DataFrame) -> Column:
    """How sure it is that a credential's holder is the person behind its provider number: a column over credential, licenses (array), via, birth and
    listed_birth (years), city and listed_city, credential_type and taxonomy, npi. Licence numbers decide, then birth years of an exclusion
    by number, then cities; different professions refute what is only a name. Null without a number."""
    own = F.when(F.length(license_core(F.col("credential"))) > 0, license_core(F.col("credential")))
    cores = F.filter(F.transform(F.coalesce("licenses", F.array().cast("array<string>")), license_core), lambda c: F.length(c) >= 3)
    both = own.isNotNull() & (F.size(cores) > 0)
    listed = F.coalesce(F.col("via") == "NPI", F.lit(False))
    births = F.col("birth").isNotNull() & F.col("listed_birth").isNotNull()
    cities = letters(F.coalesce("city", F.lit("")))
    same_city = (cities != "") & (cities == letters(F.coalesce("listed_city", F.lit(""))))
    soft = first_of((listed, "exclusion-npi"), (same_city & F.col("via").isNotNull(), "city-corroborated"), default="unique-name")
    soft = F.when(professions_conflict(F.col("credential_type"), F.col("taxonomy")), "taxonomy-mismatch").otherwise(soft)
    grade = first_of((both & F.array_contains(cores, own), "license-confirmed"), (both, "license-mismatch"), (listed & births & (F.col("birth") == F.col("listed_birth")), "dob-confirmed"), (listed & births, "dob-mismatch"), default=soft)
    return F.when(F.coalesce("npi", F.lit("")) != "", grade)


def exclusions(hits: DataFrame, horizon: int | None = None, derived_most: float = 22.0) -> DataFrame:
    """excluded_or_sanctioned or excluded_license_derived of matches with a listed row: uid, source, status, confidence, mandatory, list, code, reason, date (of
    the listing), identity (identity_grade, null where none) and last_paid (year of the last money, null without any).

    Definitive 40, mandatory 48; corroborated 30; by name 20. Definitive by a crosswalked number whose identity is mismatched: 10 at most. A listing
    that restates the credential's own adverse status: derived_most. Where all money ended by the listing's year and 5 years or more before the
    horizon: 0.6 of it, from 8 years on 0.3, 10 at least."""
    sure = F.col("confidence") == "definitive"
    severity = first_of((sure & F.coalesce("mandatory", F.lit(False)), 48.0), (sure, 40.0), (F.col("confidence") == "corroborated", 30.0), default=20.0)
    severity = F.when(sure & F.coalesce(F.col("identity").isin(*MISMATCHED), F.lit(False)), F.least(severity, F.lit(10.0))).otherwise(severity)
    echo = F.upper(F.coalesce("list", F.lit(""))).contains("HCA") & F.coalesce(F.col("reason").rlike(r"(?i)licen[cs]e\s+(suspend|revok|surrender)"), F.lit(False))
    derived = (license_derived(F.col("code")) | echo) & (F.col("source") == "healthcare") & F.upper(F.trim(F.coalesce("status", F.lit("")))).isin(*ADVERSE)
    severity = F.when(derived, F.least(severity, F.lit(derived_most))).otherwise(severity)
    if horizon is not None:
        gone = F.lit(horizon) - F.col("last_paid")
        over = F.coalesce((F.col("last_paid") <= year(F.col("date"))) & (gone >= 5), F.lit(False))
        severity = F.when(over, F.greatest(F.lit(10.0), F.bround(severity * F.when(gone >= 8, 0.3).otherwise(0.6), 0))).otherwise(severity)
    return _flags(hits, F.when(derived, "excluded_license_derived").otherwise("excluded_or_sanctioned"), severity)


def ownership_churn(events: DataFrame) -> DataFrame:
    """14 for two or more sale dates of a facility's own, else 6 for a date that a chain shares."""
    rows = chain_dates(events)
    return _flags(rows.where("own >= 2 or chain >= 1"), "ownership_churn", F.when(F.col("own") >= 2, 14.0).otherwise(6.0))


def shared_owner(owned: DataFrame, least: int = 2) -> DataFrame:
    """Rows (uid, owner, org) whose owner holds at least `least` orgs."""
    busy = owned.groupBy("owner").agg(F.count_distinct("org").alias("orgs")).where(F.col("orgs") >= least)
    return _flags(owned.join(busy, "owner", "left_semi").select("uid").distinct(), "shared_owner", 16.0)


def services_per_visit(codes: DataFrame, ratio: float = 10.0, least: int = 20) -> DataFrame:
    """Rows (uid, services, days) with at least `least` days in which some code has `ratio` services a day."""
    top = codes.where(F.col("days") >= least).groupBy("uid").agg(F.max(F.col("services") / F.col("days")).alias("top"))
    return _flags(top.where(F.col("top") >= ratio), "services_per_visit_outlier", 14.0)


def enforcement(rows: DataFrame) -> DataFrame:
    """Flags of facilities (uid, deficiencies, jeopardy, fines, denials): citations of jeopardy 22, fines from 10,000 on by percentile 6 to 20,
    any denial of payment 16, deficiencies in the top tenth 8. Percentiles are over the whole table."""
    fines = rank_severity(rows, "fines")
    many = rank_severity(rows, "deficiencies").where("percentile >= 0.9")
    out = _flags(rows.where("jeopardy > 0"), "immediate_jeopardy_citation", 22.0)
    out = out.unionByName(_flags(fines.where("fines >= 10000"), "civil_monetary_penalty", F.col("severity")))
    out = out.unionByName(_flags(rows.where("denials > 0"), "payment_denial_imposed", 16.0))
    return out.unionByName(_flags(many, "many_health_deficiencies", 8.0))


def complaints(rows: DataFrame) -> DataFrame:
    """Flags of providers (uid, complaints, inspections): 18 for a valid complaint and 6 for each further, 34 at most; 6 for six inspections."""
    n = F.col("complaints")
    out = _flags(rows.where("complaints >= 1"), "childcare_valid_complaint", F.least(F.lit(34), 18 + 6 * (n - 1)))
    return out.unionByName(_flags(rows.where("inspections >= 6"), "childcare_many_inspections", 6.0))


def deactivated(facts: DataFrame, off: DataFrame, mismatched: DataFrame) -> DataFrame:
    """45 for money (uid, year, amount) dated after the year in which an identifier (uid, off_year) was taken out, unless the match is doubtful."""
    met = facts.join(off, "uid").where("year > off_year and amount > 0").select("uid").distinct().join(mismatched, "uid", "left_anti")
    return _flags(met, "paid_after_npi_deactivated", 45.0)


def labor(contracts: DataFrame, listed: DataFrame) -> DataFrame:
    """Strikes 10, debarments 22, contracts in a debarment 40: contracts (uid, name_key, start, end) and the list (name_key, kind, start, end)."""
    side = listed.select("name_key", "kind", F.col("start").alias("start2"), F.col("end").alias("end2"))
    met = contracts.where(F.length("name_key") >= 7).join(side, "name_key")
    overlap = (F.col("kind") == "debarred") & F.col("start").isNotNull() & F.col("start2").isNotNull()
    overlap = overlap & (F.col("start") <= F.coalesce("end2", F.lit("9999"))) & (F.coalesce("end", F.lit("9999")) >= F.col("start2"))
    rule = first_of((F.coalesce(overlap, F.lit(False)), "contract_during_debarment"), (F.col("kind") == "debarred", "lni_debarred"), default="lni_strike")
    severity = first_of((rule == "contract_during_debarment", 40.0), (rule == "lni_debarred", 22.0), default=10.0)
    return _flags(met, rule, severity).distinct()


def _discounted(met: DataFrame, groups: DataFrame, names: DataFrame | None, key: list[str], severity: float) -> DataFrame:
    """met (uid and key columns) with severity, less where the names (uid, name) of a key's members openly carry one brand."""
    if names is None:
        return met.withColumn("severity", F.lit(severity))
    named = groups.join(names.select("uid", "name"), "uid").withColumn("__key", F.concat_ws("|", *key))
    brands = open_brands(named, "__key", 2)
    out = met.withColumn("__key", F.concat_ws("|", *key)).join(brands, "__key", "left")
    return out.withColumn("severity", F.bround(severity * F.when(F.col("brand").isNotNull(), OPEN_BRAND).otherwise(1.0), 1)).drop("__key", "brand")


def shared_contact(rows: DataFrame, low: int = 2, high: int = 8, names: DataFrame | None = None) -> DataFrame:
    """Rows (uid, email, phone) that share either with `low` to `high` uids: 22, once; `via` says phone where both do. With names (uid, name), OPEN_BRAND of it for sites of one brand."""
    keys = rows.select("uid", F.explode(F.array_compact(F.array(F.when(F.col("phone").isNotNull(), F.struct(F.lit("phone").alias("via"), F.col("phone").alias("key"))), F.when(F.coalesce("email", F.lit("")) != "", F.struct(F.lit("email").alias("via"), F.col("email").alias("key")))))).alias("k")).select("uid", "k.*")
    sized = keys.groupBy("via", "key").agg(F.count_distinct("uid").alias("n")).where(F.col("n").between(low, high))
    groups = keys.join(sized, ["via", "key"])
    met = groups.groupBy("uid").agg(F.max_by("key", F.struct("via", "key")).alias("key"), F.max("via").alias("via"))
    met = _discounted(met, groups, names, ["via", "key"], 22.0)
    return met.select("uid", F.lit("shared_contact_multiple_providers").alias("rule_id"), "severity", "via")


def contact_person(rows: DataFrame, low: int = 3, high: int = 10, names: DataFrame | None = None) -> DataFrame:
    """12 for uids whose contact person serves `low` to `high` uids; with names (uid, name), OPEN_BRAND of it for sites of one brand."""
    busy = rows.where("person is not null").groupBy("person").agg(F.count_distinct("uid").alias("n")).where(F.col("n").between(low, high))
    groups = rows.join(busy, "person", "left_semi").select("uid", "person")
    met = _discounted(groups.groupBy("uid").agg(F.max("person").alias("person")), groups, names, ["person"], 12.0)
    return _flags(met, "concentration_same_contact_person", F.col("severity"))

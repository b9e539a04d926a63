"""Scores: of flags of one correlation group only the strongest counts; groups add up to a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions.text import first_of

# Correlation groups; any other rule is a group of its own.
GROUPS = {
    "doh_sanction": ["credential_revoked_or_suspended", "credential_surrendered", "credential_active_with_conditions", "disciplinary_action_taken", "disciplinary_action_pending", "excluded_license_derived", "paid_before_bar"],
    "shared_identity": ["shared_contact_multiple_providers", "concentration_same_contact_person"],
    "capacity": ["capacity_outlier_high", "capacity_missing_or_zero"],
    "paid_after": ["paid_while_sanctioned", "paid_after_barred", "paid_after_npi_deactivated"],
    "lni": ["lni_debarred", "lni_strike", "contract_during_debarment"],
}
# Families of rules; any other rule is of the quality family.
FAMILIES = {
    "integrity": ["excluded_or_sanctioned", "excluded_license_derived", "no_active_business_registration", "credential_revoked_or_suspended", "credential_surrendered", "credential_active_with_conditions", "disciplinary_action_taken", "disciplinary_action_pending", "license_expired_active", "payment_only_certificate", "childcare_valid_complaint", "lni_debarred", "lni_strike", "contract_during_debarment"],
    "network": ["address_shared_multiple_providers", "shared_contact_multiple_providers", "concentration_same_contact_person", "shared_owner", "ownership_churn", "commercial_mailbox", "virtual_office", "po_box_address"],
    "billing": ["payment_outlier", "billing_spike", "paid_while_sanctioned", "paid_after_barred", "paid_attribution_unconfirmed", "paid_after_npi_deactivated", "single_code_dominance", "services_per_visit_outlier", "contract_duplicate_amount_vendor", "contract_round_large_amount", "payment_denial_imposed"],
}


def _lookup(rule: Column, table: dict[str, list[str]], default: Column) -> Column:
    return first_of(*[(rule.isin(rules), F.lit(name)) for name, rules in table.items()], default=default)


def group_of(rule: Column) -> Column:
    return _lookup(rule, GROUPS, rule)


def family_of(rule: Column) -> Column:
    return _lookup(rule, FAMILIES, F.lit("quality"))


def parts(flags: DataFrame) -> DataFrame:
    """Per uid and correlation group the highest severity and its rule (ties: the first by name)."""
    rows = flags.select("entity_uid", "rule_id", "severity", group_of(F.col("rule_id")).alias("grp"))
    return rows.groupBy("entity_uid", "grp").agg(F.max("severity").alias("severity"), F.min_by("rule_id", F.struct(-F.col("severity"), "rule_id")).alias("rule_id"))


def scores(flags: DataFrame, cap: float = 100.0) -> DataFrame:
    """risk_score, flag_count, family_count and top_rule per uid."""
    total = parts(flags).groupBy("entity_uid").agg(F.bround(F.least(F.sum("severity"), F.lit(cap)), 1).alias("risk_score"), F.min_by("rule_id", F.struct(-F.col("severity"), "rule_id")).alias("top_rule"))
    counts = flags.groupBy("entity_uid").agg(F.count("*").alias("flag_count"), F.count_distinct(family_of(F.col("rule_id"))).alias("family_count"))
    return total.join(counts, "entity_uid")


def suppressed(scored: DataFrame, institutions: DataFrame, factor: float = 0.5) -> DataFrame:
    """Scores of institutions (entity_uid) times `factor`."""
    marked = scored.join(institutions.select("entity_uid").distinct().withColumn("__i", F.lit(True)), "entity_uid", "left")
    return marked.withColumn("risk_score", F.when(F.col("__i"), F.bround(F.col("risk_score") * factor, 1)).otherwise(F.col("risk_score"))).drop("__i")


def buckets(scored: DataFrame) -> DataFrame:
    """Rows per band of twenty points."""
    s = F.col("risk_score")
    band = first_of((s < 20, "0-19"), (s < 40, "20-39"), (s < 60, "40-59"), (s < 80, "60-79"), default="80-100")
    return scored.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


# Identity grades that confirm a lead and those that refute it.
CONFIRMED, REFUTED = ["license-confirmed", "dob-confirmed"], ["license-mismatch", "dob-mismatch", "city-mismatch", "taxonomy-mismatch"]


def grade(after: Column, prebar: Column, excluded_paid: Column, strong: Column, funds: Column, identity: Column, after_amount: Column, runoff: Column, last_year: Column, horizon: int = 2024) -> Column:
    """Evidence grade A to D of a lead; the first condition that holds."""
    good, bad = identity.isin(*CONFIRMED), identity.isin(*REFUTED)
    prebar = prebar & ~after
    paid = excluded_paid & (funds > 0) & ~prebar
    big = after_amount >= 100_000
    material = ((after_amount >= 1000) & ~runoff) | big
    recent = last_year >= horizon - 2
    return first_of((prebar, "D"), (bad & (after | paid), "C"), (after & good & material & (recent | big), "A"), (after, "B"), (paid & good, "B"), (paid | (strong & (funds > 0)), "C"), default="D")

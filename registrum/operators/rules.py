"""Single-entity rules: each turns entities into flags (entity_uid, rule_id, severity, title, explanation, evidence).

Entities have the normalized columns and `raw`, a map of the source's own fields. A missing field never matches. Flags are leads to verify.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions.names import brand_key, brand_or_name, venue
from registrum.functions.text import blank, day, number, one_edit, phone, plural_of, upper_key

from .money import interpolated

FLAG = "entity_uid string, rule_id string, severity double, title string, explanation string, evidence string"


def raw(field: str) -> Column:
    return F.col("raw")[field]


def active(status: Column) -> Column:
    return F.upper(F.trim(status)).startswith("ACTIVE")


def flag(rows: DataFrame, rule: str, severity: Column | float, title: str, explanation: Column, evidence: Column) -> DataFrame:
    """Flags of all rows; evidence is a struct, written as JSON."""
    severity = severity if isinstance(severity, Column) else F.lit(float(severity))
    return rows.select(F.col("uid").alias("entity_uid"), F.lit(rule).alias("rule_id"), severity.cast("double").alias("severity"), F.lit(title).alias("title"), explanation.alias("explanation"), F.to_json(evidence).alias("evidence"))


# Mail shops, virtual offices and ways to write a post office box.
MAIL_SHOPS = ["PMB", "UPS STORE", "MAIL ?BOXES ?ETC", "POSTAL ANNEX", "PAK ?MAIL", "PACKAGING", "PARCEL", "GOIN ?POSTAL", "POSTNET", "MAILBOX"]
OFFICES = ["REGUS", "WEWORK", "INTELLIGENT OFFICE", "DAVINCI", "OPUS VIRTUAL"]
BOXES = [r"P\.?\s*O\.?\s*BOX", "POST OFFICE BOX", r"BOX\s+\d"]
# Credential statuses, ownership words and rating fields, in order.
REVOKED, SURRENDERED, CONDITIONS = ("REVOKED", "SUSPENDED"), ("SURRENDER", "VOLUNTARY SURRENDER"), "ACTIVE WITH CONDITIONS"
FOR_PROFIT, PROFIT_WORDS = ("FOR-PROFIT", "PROFIT", "PROPRIETARY", "FOR PROFIT"), ("FOR-PROFIT", "PROPRIETARY")
STARS = ("quality_of_patient_care_star_rating", "five_star", "overall_rating")


def _mailbox(address: Column) -> Column:
    a = F.trim(F.upper(address))
    return F.when(a.rlike(rf"\b({'|'.join(MAIL_SHOPS)})\b"), "commercial_mailbox").when(a.rlike(rf"\b({'|'.join(OFFICES)})\b"), "virtual_office").when(a.rlike(rf"^\s*({'|'.join(BOXES)})"), "po_box_address")


def for_profit(ownership: Column) -> Column:
    o = F.upper(F.trim(ownership))
    return o.isin(*FOR_PROFIT) | o.contains(PROFIT_WORDS[0]) | o.contains(PROFIT_WORDS[1])


#: rule -> (condition, severity, title, the column shown); conditions are over entities and the parameter `today`.
def simple_rules(today: str) -> dict[str, tuple[Column, Column | float, str, Column]]:
    status, now = F.col("status"), F.lit(today).cast("date")
    age = F.datediff(now, day(raw("_cert_date")))
    capacity, credential, action = number(raw("licensecapacity")), F.upper(F.trim(status)), F.upper(F.trim(raw("actiontaken")))
    stars = F.coalesce(*[number(raw(field)) for field in STARS])
    nowhere = F.col("lat").isNull() | F.col("lon").isNull() | ((F.col("lat") == 0) & (F.col("lon") == 0))
    box = _mailbox(blank(F.col("address")))
    return {
        "license_expired_active": (active(status) & (day(raw("licenseexpirationdate")) < now), 30, "Active with an expired licence", raw("licenseexpirationdate")),
        "payment_only_certificate": (active(status) & (F.upper(F.trim(raw("licensecertificatetypedesc"))) == "PAYMENT ONLY"), 5, "Payment-only certificate", raw("licensecertificatetypedesc")),
        "capacity_missing_or_zero": (active(status) & (F.coalesce(capacity, F.lit(0.0)) == 0), 10, "No capacity on record", raw("licensecapacity")),
        "ungeocoded_address": (active(status) & (nowhere | (blank(F.col("address")) == "")), F.when(blank(F.col("address")) == "", 10.0).otherwise(5.0), "Address not on the map", F.col("address")),
        "missing_contact_info": (active(status) & (blank(raw("primarycontactemail")) == "") & phone(raw("primarycontactphonenumber")).isNull(), 8, "No way to contact", raw("primarycontactemail")),
        "commercial_mailbox": (box == "commercial_mailbox", 12, "Commercial mailbox", F.col("address")),
        "virtual_office": (box == "virtual_office", 12, "Virtual office", F.col("address")),
        "po_box_address": (box == "po_box_address", 8, "Post office box", F.col("address")),
        "contract_round_large_amount": ((F.col("amount") >= 100_000) & (F.col("amount") % 10_000 == 0), 6, "Large round amount", F.col("amount").cast("string")),
        "credential_revoked_or_suspended": (credential.isin(*REVOKED), 30, "Credential revoked or suspended", status),
        "credential_surrendered": (credential.isin(*SURRENDERED), 16, "Credential surrendered", status),
        "credential_active_with_conditions": (credential == CONDITIONS, 18, "Credential under conditions", status),
        "disciplinary_action_taken": (action == "YES", 22, "Disciplinary action", raw("actiontaken")),
        "disciplinary_action_pending": (action == "PENDING", 12, "Disciplinary action pending", raw("actiontaken")),
        "recently_certified": (age.between(0, 365), 8, "Certified within a year", raw("_cert_date")),
        "for_profit_ownership": (for_profit(raw("_ownership")), 5, "For-profit ownership", raw("_ownership")),
        "low_quality_rating": (stars <= 2, 8, "Low quality rating", stars.cast("string")),
    }


def simple_flags(entities: DataFrame, today: str, only: list[str] | None = None) -> DataFrame:
    """All single-row rules in one pass: an array of the rules that hold, exploded; no union of scans."""
    found = []
    for rule, (condition, severity, title, shown) in simple_rules(today).items():
        if only is None or rule in only:
            severity = severity if isinstance(severity, Column) else F.lit(float(severity))
            made = F.struct(F.lit(rule).alias("rule_id"), severity.cast("double").alias("severity"), F.lit(title).alias("title"), F.concat(F.lit(f"{title}: "), F.coalesce(shown, F.lit("none"))).alias("explanation"), F.to_json(F.struct(shown.alias("value"))).alias("evidence"))
            found.append(F.when(condition, made))
    rows = entities.select(F.col("uid").alias("entity_uid"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("entity_uid", "f.*")


def capacity_outliers(rows: DataFrame, sigmas: float = 3.0, least: int = 20) -> DataFrame:
    """Rows (uid, kind, value) above the mean by more than `sigmas` population deviations of their kind, in kinds of enough rows. Moments are aggregated, then joined: no kind has to fit a window."""
    moments = rows.groupBy("kind").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sigma"), F.count("value").alias("n")).where(F.col("n") >= least)
    return rows.join(moments, "kind").where(F.col("value") > F.col("mean") + sigmas * F.col("sigma"))


def recent_large(rows: DataFrame, today: str, share: float = 0.9, days: int = 365) -> DataFrame:
    """Rows (uid, date, value) of the last `days` days at or above the interpolated percentile of all positive values."""
    cut = interpolated(rows.where("value > 0"), "value", share)
    return rows.crossJoin(F.broadcast(cut)).where(F.datediff(F.lit(today).cast("date"), F.col("date")).between(0, days) & (F.col("value") >= F.col("cut")))


def duplicate_values(rows: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """Keys held by at least `least` distinct uids, with their number."""
    return rows.groupBy(*key).agg(F.count_distinct("uid").alias("n")).where(F.col("n") >= least)


def duplicate_contracts(entities: DataFrame, least: float = 5_000.0) -> DataFrame:
    """contract_duplicate_amount_vendor flags (14) of contracts of `least` or more whose vendor and amount, to the cent, at least two uids have."""
    rows = entities.where(F.col("amount") >= least).select("uid", "name", "amount", upper_key(blank(F.col("name"))).alias("vendor"), F.bround("amount", 2).alias("paid"))
    same = rows.groupBy("vendor", "paid").agg(F.count_distinct("uid").alias("uids"), F.count("*").alias("occurrences")).where("uids >= 2")
    met = rows.join(same, ["vendor", "paid"])
    return flag(met, "contract_duplicate_amount_vendor", 14, "One vendor, one amount, several contracts", F.concat(F.col("occurrences").cast("string"), F.lit(" contracts to one vendor have the same amount")), F.struct(F.col("name").alias("vendor"), F.col("paid").alias("amount"), "occurrences"))


def round_amounts(rows: DataFrame, least: float, step: float) -> DataFrame:
    """Rows (uid, amount) with a large amount that is a whole multiple of `step`."""
    return rows.where((F.col("amount") >= least) & (F.col("amount") % step == 0))


def shared_key(rows: DataFrame, low: int = 2, high: int = 8) -> DataFrame:
    """Members (uid, key, brand) of keys with `low` to `high` uids of at least two brands, with the key's size."""
    sizes = rows.groupBy("key").agg(F.count_distinct("uid").alias("members"), F.count_distinct("brand").alias("brands"))
    return rows.join(sizes.where(F.col("members").between(low, high) & (F.col("brands") >= 2)), "key").select("uid", "key", "members", "brands")


def majority_root(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Per cluster the root (first word) that at least `share` of its names have."""
    per = rows.groupBy("cluster", F.substring_index("name", " ", 1).alias("root")).agg(F.count("*").alias("n"))
    whole = per.groupBy("cluster").agg(F.sum("n").alias("total"), F.max_by("root", F.struct("n", F.expr("-ascii(root)"), "root")).alias("top"))
    out = per.join(whole, "cluster").where("root = top")
    return out.where(F.col("n") / F.col("total") >= share).select("cluster", "root", "n", "total")


# Words that names are made of, which count as common in any corpus.
SEEDS = (
    "LEARNING ACADEMY CHILDCARE PRESCHOOL CENTER CENTERS CHILDREN CHILDRENS DEVELOPMENT MONTESSORI EDUCATION EARLY SCHOOL CHILD CARE KIDS DAYCARE FAMILY COMMUNITY PROGRAM PROGRAMS PLACE CAMPUS INFANT TODDLER ELEMENTARY "
    "EXTENDED ENRICHMENT DISCOVERY CURIOSITY IMAGINATION ADVENTURE EXPLORERS MILESTONES PATHWAYS POTENTIAL GENERATION KNOWLEDGE BEGINNINGS BLESSINGS TREASURE SUNSHINE RAINBOW "
    "HEALTH HOSPICE HOSPITAL MEDICAL TRANSPORT TRANSPORTATION NURSING THERAPY BEHAVIOR BEHAVIORAL REHABILITATION CLINIC EQUIPMENT SUPPLIES DIALYSIS CONSULTING HOME PEDIATRIC COUNSELING WELLNESS RECOVERY TREATMENT RESIDENTIAL "
    "SERVICES SERVICE CHRISTIAN PARTNERS INTERNATIONAL FOUNDATION MINISTRY MINISTRIES INSTITUTE REGIONAL NETWORK SUPPORT PROVIDERS INCLUSION ASSOCIATION ASSOCIATES RESOURCES SOLUTIONS MANAGEMENT ENVIRONMENT GUARDIAN ASSISTANCE "
    "OPPORTUNITY OPPORTUNITIES EXCEPTIONAL EXCELLENCE PROFESSIONAL ACHIEVEMENT INDEPENDENT COMPREHENSIVE INTEGRATED ACCREDITED CERTIFIED LICENSED REGISTERED DEDICATED NURTURING SPECIALIZED CONNECTION CONNECTIONS MAINTENANCE ACCOMMODATION NECESSARY"
).split()
# Long, often misspelled words with few near ones, the only ones met with two edits.
ANCHORS = (
    "PROFESSIONAL ACCOMMODATION REHABILITATION COMPREHENSIVE DEVELOPMENT ENVIRONMENT INDEPENDENT OPPORTUNITY INTERNATIONAL ACHIEVEMENT MANAGEMENT ASSOCIATION FOUNDATION TRANSPORTATION "
    "EXCELLENCE ENRICHMENT MONTESSORI COUNSELING ELEMENTARY EDUCATION BEHAVIORAL RESIDENTIAL PEDIATRIC"
).split()


def misspelled(words: DataFrame, rare: int = 3, common: int = 25, least: int = 5, target: int = 5, long: int = 8, real: DataFrame | None = None) -> DataFrame:
    """Rare words (word, in upper case) one edit away from a common one or a seed: word, likely, frequency. Plurals of each other are no misspelling,
    nor are the words of `real` (word), if given. Candidates meet on the word with one letter left out, so no length class is joined with
    itself. Words of `long` letters or more that meet none are compared with the ANCHORS, at two edits at most. Ties go to the first word."""
    spark = words.sparkSession
    counts = words.select(F.upper("word").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seeds = spark.createDataFrame([(w,) for w in SEEDS], "word string").select("word", F.lit(0).cast("long").alias("n"))
    known = counts.where((F.col("n") >= common) & (F.length("word") >= 4)).unionByName(seeds.join(counts.select("word"), "word", "left_anti")).unionByName(counts.join(F.broadcast(seeds.select("word")), "word", "left_semi").where(F.col("n") < common))
    odd = counts.where((F.length("word") >= least) & (F.col("n") <= min(rare, common - 1)) & ~F.col("word").isin(SEEDS))
    if real is not None:
        odd = odd.join(real.select(F.upper("word").alias("word")), "word", "left_anti")
    cuts = F.expr("array_distinct(array_append(transform(sequence(1, length(word)), i -> concat(left(word, i - 1), substr(word, i + 1))), word))")
    usual = known.where(F.length("word") >= target).select(F.col("word").alias("likely"), "n", F.explode(cuts).alias("cut"))
    w, a = F.col("word"), F.col("likely")
    pairs = odd.select("word", F.explode(cuts).alias("cut")).join(usual, "cut").select("word", "likely", "n").distinct().where(one_edit(w, a) & ~plural_of(w, a))
    best = [F.min_by("likely", F.struct(-F.col("n"), "likely")).alias("likely"), F.max("n").alias("frequency")]
    near = pairs.groupBy("word").agg(*best)

    anchors = F.explode(F.array(*map(F.lit, ANCHORS))).alias("likely")
    far = odd.where(F.length("word") >= long).select("word", anchors).where("levenshtein(word, likely, 2) >= 0").where(~plural_of(w, a)).join(near, "word", "left_anti")
    seen = counts.where(F.col("word").isin(ANCHORS)).select(F.col("word").alias("likely"), "n")
    far = far.join(F.broadcast(seen), "likely", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).groupBy("word").agg(*best)
    return near.unionByName(far)


def misspelled_names(entities: DataFrame, real: DataFrame | None = None, **limits: int) -> DataFrame:
    """misspelled_word_in_name flags (8) of entities whose name holds a misspelled word, with the words."""
    words = entities.where("name is not null").select("uid", "name", F.posexplode(F.regexp_extract_all(F.upper("name"), F.lit("[A-Z]+"), F.lit(0))).alias("at", "word"))
    met = words.join(misspelled(words, real=real, **limits), "word").groupBy("uid", "name").agg(F.array_sort(F.collect_list(F.struct("at", "word", "likely"))).alias("found"))
    pairs = F.transform(F.slice("found", 1, 5), lambda x: F.struct(x["word"].alias("word"), x["likely"].alias("likely")))
    shown = F.array_join(F.transform(F.slice("found", 1, 3), lambda x: F.concat(F.lit("'"), F.initcap(x["word"]), F.lit("' → '"), F.initcap(x["likely"]), F.lit("'"))), "; ")
    return flag(met, "misspelled_word_in_name", 8, "Name may be misspelled", F.concat(F.lit("Close to a common word: "), shown), F.struct(pairs.alias("misspellings"), F.col("name")))


def open_brands(rows: DataFrame, group: str, least: int = 3, share: float = 0.7) -> DataFrame:
    """Per `group` of rows (group, name) the brand that at least `share` of its branded names have, of `least` or more: the group, brand.
    A brand of two words counts as its first where that stands alone in the group. Ties go to the first by name."""
    brands = rows.select(group, brand_or_none(F.col("name")).alias("brand")).where("brand is not null").groupBy(group, "brand").agg(F.count("*").alias("n"))
    single = brands.where(~F.col("brand").contains(" ")).select(group, F.col("brand").alias("first"))
    met = brands.withColumn("first", F.substring_index("brand", " ", 1)).join(single.withColumn("__alone", F.lit(True)), [group, "first"], "left")
    folded = met.select(group, F.when(F.col("__alone"), F.col("first")).otherwise(F.col("brand")).alias("brand"), "n").groupBy(group, "brand").agg(F.sum("n").alias("n"))
    best = folded.groupBy(group).agg(F.min_by("brand", F.struct(-F.col("n"), "brand")).alias("brand"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.where((F.col("all") >= least) & (F.col("n") / F.col("all") >= share)).select(group, "brand")


def brand_or_none(name: Column) -> Column:
    return F.nullif(brand_key(name), F.lit(""))


#: What a group whose sites openly carry one brand counts.
OPEN_BRAND = 0.35


def shared_addresses(entities: DataFrame, two: float = 14.0, more: float = 24.0) -> DataFrame:
    """address_shared_multiple_providers for entities (uid, name, dba, address, city, zip) at one address with others: at least two uids and names, and two
    brands that aren't a host's. 14 for two, 24 for more; OPEN_BRAND of it where the sites carry one brand. Columns: uid, rule_id, severity, providers, brand."""
    rows = entities.where("coalesce(address, '') <> ''").select("uid", "name", "dba", upper_key(blank(F.col("address")), blank(F.col("city")), blank(F.col("zip"))).alias("key")).where("key <> ''")
    brand = F.when((blank(F.col("name")) != "") & ~venue(F.col("name"), F.col("dba")), brand_or_name(F.col("name")))
    sizes = rows.groupBy("key").agg(F.count_distinct("uid").alias("providers"), F.count_distinct(F.nullif(upper_key(blank(F.col("name"))), F.lit(""))).alias("names"), F.count_distinct(brand).alias("brands"))
    sizes = sizes.where("providers >= 2 and names >= 2 and brands >= 2")
    met = rows.join(sizes, "key")
    out = met.join(open_brands(met.where("coalesce(name, '') <> ''"), "key", 2), "key", "left")
    severity = F.bround(F.when(F.col("providers") >= 3, more).otherwise(two) * F.when(F.col("brand").isNotNull(), OPEN_BRAND).otherwise(1.0), 1)
    return out.select("uid", F.lit("address_shared_multiple_providers").alias("rule_id"), severity.alias("severity"), "providers", "brand")


def union(*flags: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, flags)

"""Queries behind the review screens, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registrum.functions.text import dollars, first_of, fiscal, years

from .money import ranked
from .scoring import group_of


#: Orders of the review queue, over risk_score, funds, funds_after and grade. A material sum after a bar leads the default one.
QUEUE_ORDERS = {
    "default": lambda: [F.desc(F.coalesce(F.col("funds_after") >= 1000, F.lit(False))), F.desc("risk_score"), F.desc("funds_after"), F.asc("grade"), F.desc("funds")],
    "grade": lambda: [F.asc("grade"), F.desc("funds_after"), F.desc("funds"), F.desc("risk_score")],
    "funds": lambda: [F.desc("funds")],
    "after": lambda: [F.desc("funds_after"), F.desc("funds")],
}


def predicates(least: float | None = None, source: str | None = None, text: str | None = None, county: str | None = None, triage: str | None = None, in_operator: bool | None = None) -> Column:
    """The filters that are set, joined by AND. triage: a state, `watched`, or `open` for none."""
    out = F.lit(True)
    if least is not None:
        out = out & (F.col("risk_score") >= least)
    if source:
        out = out & (F.col("source") == source)
    if text:
        out = out & (F.col("name").ilike(f"%{text}%") | F.col("uid").ilike(f"%{text}%"))
    if county:
        out = out & (F.upper(F.trim("county")) == county.upper())
    if triage == "watched":
        out = out & F.coalesce(F.col("watched"), F.lit(False))
    elif triage == "open":
        out = out & (F.coalesce("state", F.lit("")) == "")
    elif triage:
        out = out & (F.col("state") == triage)
    if in_operator is not None:
        out = out & (F.col("operator_id").isNotNull() if in_operator else F.col("operator_id").isNull())
    return out


def review_queue(entities: DataFrame, scored: DataFrame, triage: DataFrame, where: Column, rule_flags: DataFrame | None = None, limit: int = 1000, order: str = "default") -> DataFrame:
    """Scored entities with their triage state in one of the QUEUE_ORDERS, ties by families, flags and uid; only those with a row of rule_flags, if
    given. entities or scored may bring funds, funds_after and grade; where none does, they are 0 and D."""
    rows = entities.join(scored, entities["uid"] == scored["entity_uid"]).join(triage, "uid", "left")
    for name, empty in (("funds", 0.0), ("funds_after", 0.0), ("grade", "D")):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(empty)) if name in rows.columns else F.lit(empty))
    rows = rows.where(where)
    if rule_flags is not None:
        rows = rows.join(rule_flags.select(F.col("entity_uid").alias("uid")).distinct(), "uid", "left_semi")
    rows = rows.withColumn("state", F.coalesce("state", F.lit("new")))
    return rows.orderBy(*QUEUE_ORDERS[order](), F.desc("family_count"), F.desc("flag_count"), "uid").limit(limit)


def top_titles(flags: DataFrame, most: int = 6) -> DataFrame:
    """Per uid the titles of its strongest flag of each correlation group, `most` at most."""
    rows = flags.withColumn("grp", group_of(F.col("rule_id")))
    per = rows.groupBy("entity_uid", "grp").agg(F.min_by("title", F.struct(-F.col("severity"), "rule_id")).alias("title"), F.max("severity").alias("severity"))
    order = Window.partitionBy("entity_uid").orderBy(F.desc("severity"), "title")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("entity_uid", "rank", "title", "severity")


def changes(now: DataFrame, before: DataFrame, points: float = 10.0, money: float = 25_000.0, fresh: float = 40.0, triage: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """What moved between two snapshots (uid, score, funds, status), a row for each kind: `new` for a uid of at least `fresh`, `risk` for a score up by `points`,
    `funds` for money up by more than `money`, `status` for one that replaced another. Watched uids (triage: uid, watched) come first, then
    changes of status, then by uid; `limit` cuts the feed."""
    old = before.select("uid", F.col("score").alias("score0"), F.col("funds").alias("funds0"), F.col("status").alias("status0"), F.lit(True).alias("__was"))
    rows = now.join(old, "uid", "left")
    was = F.col("__was").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    moved = (F.coalesce("status", F.lit("")) != F.coalesce("status0", F.lit(""))) & (F.coalesce("status0", F.lit("")) != "")
    kinds = [F.when(~was & (zero("score") >= fresh), "new"), F.when(was & (zero("score") - zero("score0") >= points), "risk"), F.when(was & (zero("funds") - zero("funds0") > money), "funds"), F.when(was & moved, "status")]
    out = rows.withColumn("kind", F.explode(F.array_compact(F.array(*kinds)))).drop("__was")
    shown = ["uid", "kind", "score", "score0", "funds", "funds0", "status", "status0"]
    if triage is None:
        out = out.withColumn("watched", F.lit(False))
    else:
        out = out.join(triage.select("uid", F.coalesce("watched", F.lit(False)).alias("watched")), "uid", "left").withColumn("watched", F.coalesce("watched", F.lit(False)))
    out = out.select(*shown, "watched")
    return out if limit is None else out.orderBy(F.desc("watched"), F.desc(F.col("kind") == "status"), "uid", "kind").limit(limit)


def peers(totals: DataFrame, group: str, value: str) -> DataFrame:
    """Each row's share of peers with a smaller value, with its peers' number."""
    below = ranked(totals, group, value).select(group, value, F.col("size").alias("peers"), F.round(F.col("below") / F.col("size"), 4).alias("percentile"))
    return totals.join(below, [group, value])


def peer_stats(totals: DataFrame, narrow: str = "taxonomy", wide: str = "source", value: str = "funds", least: int = 8) -> DataFrame:
    """uid, peer_group, peers, percentile (0 to 100), median and p90 of rows with a value that isn't zero, among those of the same `narrow` group, where fewer than
    `least` of them are, of the same `wide` one; none where that is small too."""
    rows = totals.where(F.col(value) != 0)
    found = []
    for group in (narrow, wide):
        ranks = ranked(rows.where(F.col(group).isNotNull() & (F.col(group) != "")), group, value).where(F.col("size") >= least)
        at = lambda k: F.min(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value)))
        marks = ranks.groupBy(group).agg(at(F.floor(F.col("size") / 2)).alias("median"), at(F.floor(F.col("size") * 0.9)).alias("p90"))
        percent = F.least(F.bround(100 * F.col("below") / F.col("size"), 0), F.lit(100))
        found.append(ranks.join(marks, group).select(F.col(group).alias("peer_group"), F.col(value).alias("__v"), F.col("size").alias("peers"), percent.cast("int").alias("percentile"), "median", "p90"))
    met = []
    for group, side in zip((narrow, wide), found, strict=True):
        met.append(rows.join(side, (rows[group] == side["peer_group"]) & (rows[value] == side["__v"])).select(rows["uid"], *[side[c] for c in ("peer_group", "peers", "percentile", "median", "p90")]))
    return met[0].unionByName(met[1].join(met[0].select("uid"), "uid", "left_anti"))


#: Filters and orders of the operators' list.
OPERATOR_FILTERS = {
    "barred": lambda: F.col("barred_people") > 0,
    "contradiction": lambda: F.col("contradiction") > 0,
    "cross": lambda: F.col("cross_program"),
    "hard": lambda: F.col("strongest_link").isin("hard", "shell"),
    "soft": lambda: F.col("strongest_link").isin("fuzzy", "geo", "name"),
}
OPERATOR_ORDERS = {
    "score": lambda: [F.desc(F.col("contradiction") > 0), F.desc("score"), F.desc("barred_people"), F.desc("funds")],
    "stake": lambda: [F.desc("funds"), F.desc("score")],
    "barred": lambda: [F.desc("barred_people"), F.desc("contradiction"), F.desc("score")],
}


def operators(rows: DataFrame, text: str | None = None, filters: tuple[str, ...] = (), order: str = "score", sources: int = 1, limit: int = 200) -> DataFrame:
    """Operators (operator_id, name, score, sources, barred_people, contradiction, funds, cross_program, strongest_link) by named filters and order; ties by id."""
    where = F.col("sources") >= sources
    if text:
        where = where & F.col("name").ilike(f"%{text}%")
    for name in filters:
        where = where & OPERATOR_FILTERS[name]()
    return rows.where(where).orderBy(*OPERATOR_ORDERS[order](), "operator_id").limit(min(limit, 1000))


def operator_tasks(rows: DataFrame) -> DataFrame:
    """operator_id and todo: what a reviewer has to verify, in order."""
    link = F.col("strongest_link")
    tasks = [
        F.when(F.col("contradiction") > 0, F.concat(F.lit("Check "), dollars(F.col("contradiction")), F.lit(" dated after a bar in the payment and sanction records."))),
        F.when(F.col("barred_people") > 0, F.concat(F.lit("Make sure by number or licence who the barred people are: "), F.col("barred_people").cast("string"), F.lit("."))),
        F.when(link.isin("hard", "shell"), F.lit("Get the registry or ownership record that these entities share.")).when(link.isin("fuzzy", "geo"), F.lit("The link is by likeness or nearness only: find out whether it is one operator.")),
    ]
    return rows.select("operator_id", F.array_compact(F.array(*tasks)).alias("todo"))


def period_ranges(payments: DataFrame, key: str) -> DataFrame:
    """key and funds_range (`2019–2023`, or one year) of the plausible years in the periods of its payments."""
    rows = payments.select(key, F.explode(years(F.col("period"))).alias("y")).groupBy(key).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    return rows.select(key, F.when(F.col("lo") == F.col("hi"), lo).otherwise(F.concat(lo, F.lit("–"), hi)).alias("funds_range"))


# Dated fields of a record and what they say; rules that date a bar; statuses that make an expiry the end of a licence.
EVENTS = {"firstissuedate": "license issued", "expirationdate": "license expires", "certification_date": "certified", "cert_date": "certified", "licenseeffectivedate": "license effective"}
BAR_RULES = ("excluded_or_sanctioned", "paid_while_sanctioned", "paid_after_barred", "paid_after_npi_deactivated")
ENDED = ("REVOKED", "SURRENDER", "VOLUNTARY SURRENDER", "SUSPENDED", "TERMINATED")


def dateish(c: Column) -> Column:
    """A whole text that is a date or a year, as yyyy-MM-dd, 1990 to 2035; null otherwise."""
    text = F.trim(c)
    part = lambda at, n: F.substring(text, at, n)
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), text).when(text.rlike(r"^\d\d/\d\d/\d{4}$"), F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))
    iso = iso.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))).when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
    return F.when(F.left(iso, F.lit(4)).cast("int").between(1990, 2035), iso)


def timeline(entities: DataFrame, flags: DataFrame) -> DataFrame:
    """uid, date, label and kind (license, bar, flag) of what is dated in the records (raw, status) and in the evidence of flags, each once, and bar_date, the first bar."""
    raw = [F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), dateish(F.col("raw")[k]).alias("date")) for k, label in EVENTS.items()]
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    own = entities.select("uid", status.alias("status"), F.explode(F.array(*raw)).alias("e")).where("e.date is not null")
    ended = (F.col("e.key") == "expirationdate") & F.col("status").isin(*ENDED)
    own = own.select("uid", F.col("e.date").alias("date"), F.when(ended, F.concat(F.lit("license ended: "), F.lower("status"), F.lit(", no dated order"))).otherwise(F.col("e.label")).alias("label"), F.lit("license").alias("kind"))
    seen = flags.select(F.col("entity_uid").alias("uid"), "rule_id", "title", F.explode(F.from_json("evidence", "map<string,string>")).alias("key", "value")).where("lower(key) like '%date%'")
    bar = F.col("rule_id").isin(*BAR_RULES)
    told = seen.select("uid", dateish(F.col("value")).alias("date"), F.when(bar, "barred").otherwise(F.left("title", F.lit(60))).alias("label"), F.when(bar, "bar").otherwise("flag").alias("kind")).where("date is not null")
    rank = F.when(F.col("kind") == "license", 0).when(F.col("kind") == "bar", 1).otherwise(2)
    once = own.unionByName(told).groupBy("uid", "date", "label").agg(F.min_by("kind", rank).alias("kind"))
    first = once.where("kind = 'bar'").groupBy("uid").agg(F.min("date").alias("bar_date"))
    return once.join(first, "uid", "left")


def yearly_payments(payments: DataFrame) -> DataFrame:
    """uid, year (the first of the period) and amount, rounded half-even."""
    rows = payments.select("uid", F.get(years(F.col("period")), F.lit(0)).alias("year"), "amount").where("year is not null")
    return rows.groupBy("uid", "year").agg(F.bround(F.sum("amount"), 0).alias("amount"))


# How strongly each identity grade ties a record to its money.
IDENTITY_STRENGTH = {"license-confirmed": "confirmed", "dob-confirmed": "confirmed", "exclusion-npi": "strong", "city-corroborated": "moderate", "unique-name": "moderate", "name-only": "weak", "license-mismatch": "conflict", "dob-mismatch": "conflict", "taxonomy-mismatch": "conflict"}
SANCTIONS = ("excluded_or_sanctioned", "excluded_license_derived", "paid_while_sanctioned", "credential_revoked_or_suspended", "credential_surrendered")


def dossier(flags: DataFrame, payments: DataFrame) -> DataFrame:
    """uid, headline, strength, identity, bar_date, total and after of every uid with a sanction or money: the strongest statement that its records carry.

    Money dated after a bar leads, then money that ended before it, money of a sanctioned holder, a listing alone, payments alone."""
    rule, seen = F.col("rule_id"), F.try_parse_json("evidence")
    text = lambda k: F.try_variant_get(seen, f"$.{k}", "string")
    order = F.struct(-F.col("severity"), "rule_id")
    per = flags.groupBy(F.col("entity_uid").alias("uid")).agg(
        F.bool_or(rule.isin("paid_after_barred", "paid_after_npi_deactivated")).alias("t_after"), F.bool_or(rule == "paid_before_bar").alias("t_before"), F.bool_or(rule.isin(*SANCTIONS)).alias("t_listed"),
        F.sum(F.when(rule.isin("paid_after_barred", "paid_after_npi_deactivated"), F.try_variant_get(seen, "$.amount_after", "double"))).alias("after"),
        F.min_by(text("identity_confidence"), F.when(text("identity_confidence").isNotNull(), order)).alias("identity"), F.min(F.when(rule.isin(*BAR_RULES), dateish(F.coalesce(text("bar_date"), text("date"))))).alias("bar_date"),
    )
    money = payments.groupBy("uid").agg(F.round(F.sum("amount"), 2).alias("total"))
    rows = per.join(money, "uid", "full").where("t_listed or t_after or t_before or total is not null")
    yes, paid = (lambda c: F.coalesce(F.col(c), F.lit(False))), F.coalesce("total", F.lit(0.0)) > 0
    weak = F.create_map(*[F.lit(x) for pair in IDENTITY_STRENGTH.items() for x in pair])[F.col("identity")]
    headline = first_of((yes("t_after"), "Public money dated after a bar"), (yes("t_before"), "Barred; payments ended before the bar"), (yes("t_listed") & paid, "Sanctioned and paid with public money"), (yes("t_listed"), "On a sanction list"), default="Paid with public money")
    strength = first_of((yes("t_after") & F.coalesce(weak == "conflict", F.lit(False)), "weak"), (yes("t_after") & F.coalesce(weak.isin("confirmed", "strong"), F.lit(False)), "strong"), (yes("t_after"), "moderate"), (yes("t_before"), "context"), (yes("t_listed") & paid, "moderate"), (yes("t_listed"), "weak"), default="context")
    return rows.select("uid", headline.alias("headline"), strength.alias("strength"), F.coalesce(weak, F.lit("unknown")).alias("identity"), "bar_date", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("after", F.lit(0.0)).alias("after"))


def funds_breakdown(payments: DataFrame, flags: DataFrame, contracts: str = "WA agency contract") -> DataFrame:
    """kind (program, tier, year, fiscal), label, amount and n of payments (uid, program, period, amount): by program; by the strongest kind of flag of those paid,
    contracts aside; by calendar year, contracts aside; and by the state's fiscal year. The two kinds of years are never mixed."""
    total = lambda rows, kind, label: rows.groupBy(label.alias("label")).agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "amount", "n")
    own = payments.where(F.col("program") != contracts)
    rule = F.col("rule_id")
    level = F.min(first_of((rule.isin("paid_after_barred", "paid_after_npi_deactivated"), 0), (rule.isin("excluded_or_sanctioned", "paid_while_sanctioned"), 1), (rule.isin("single_code_dominance", "services_per_visit_outlier", "payment_outlier", "billing_spike"), 2), default=3))
    levels = flags.groupBy(F.col("entity_uid").alias("uid")).agg(level.alias("level"))
    tier = first_of(*[(F.col("level") == k, F.lit(v)) for k, v in enumerate(["paid after a bar", "sanctioned and paid", "unusual billing", "other flags"])], default=F.lit("no flags"))
    paid = own.groupBy("uid").agg(F.sum("amount").alias("amount")).join(levels, "uid", "left")
    out = total(payments, "program", F.col("program")).unionByName(total(paid, "tier", tier))
    out = out.unionByName(total(own.where(F.col("period").rlike("^[0-9]{4}$")), "year", F.col("period")))
    return out.unionByName(total(payments.where(fiscal(F.col("period")) & F.col("program").startswith("WA state")), "fiscal", F.col("period")))


def summary(entities: DataFrame, scored: DataFrame, flags: DataFrame, triage: DataFrame) -> DataFrame:
    """kind, label and n: entities and flagged ones by source, flags by rule, triage states, watched ones, high scores without a state, and the number of
    dated contradictions."""
    count = lambda rows, kind, label: rows.groupBy(label.alias("label")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
    own = scored.join(entities.select(F.col("uid").alias("entity_uid"), "source"), "entity_uid")
    out = count(entities, "entities", F.col("source")).unionByName(count(own, "flagged", F.col("source"))).unionByName(count(flags, "rule", F.col("rule_id")))
    out = out.unionByName(count(triage.where("coalesce(state, '') <> ''"), "triage", F.col("state"))).unionByName(count(triage.where("watched"), "triage", F.lit("watched")))
    busy = triage.where("coalesce(state, '') <> ''").select(F.col("uid").alias("entity_uid"))
    high = scored.where("risk_score >= 40").join(busy, "entity_uid", "left_anti")
    return out.unionByName(count(high, "story", F.lit("untriaged_high"))).unionByName(count(flags.where(F.col("rule_id").isin("paid_after_barred", "paid_after_npi_deactivated")), "story", F.lit("after_bar")))


def money_summary(payments: DataFrame, flags: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """kind, label, n and amount of the first screen's money: payments (program, period, amount) in all and by program, the latest fiscal year of state
    programs, what flags (rule_id, evidence) say was paid after a bar (evidence that can't be read counts for nothing), valid complaints, and of runs (source, ran_at) the last of each source as
    `ingest` with its time as label's second half, after ` @ `. Everything is aggregated before it meets; empty tables leave zeros in the totals."""
    cents = F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("amount")
    row = lambda kind, label, n, amount: [F.lit(kind).alias("kind"), label.alias("label"), n.alias("n"), amount.alias("amount")]
    n, amount = F.col("n"), F.col("amount")
    count = F.count("*").alias("n")
    out = payments.agg(count, cents).select(*row("funds", F.lit("all"), n, amount)).unionByName(payments.groupBy("program").agg(count, cents).select(*row("program", F.col("program"), n, amount)))
    years_ = payments.where(fiscal(F.col("period")) & F.col("program").startswith("WA state")).groupBy("period").agg(count, cents)
    out = out.unionByName(years_.orderBy(F.desc("period")).limit(1).select(*row("fiscal", F.col("period"), n, amount)))
    paid = F.coalesce(F.try_variant_get(F.try_parse_json("evidence"), "$.amount_after", "double"), F.lit(0.0))
    late = flags.where(F.col("rule_id").isin("paid_after_barred", "paid_after_npi_deactivated") & F.try_parse_json(F.coalesce(F.nullif("evidence", F.lit("")), F.lit("{}"))).isNotNull()).agg(count, F.bround(F.coalesce(F.sum(paid), F.lit(0.0)), 0).alias("amount"))
    out = out.unionByName(late.select(*row("story", F.lit("after_bar"), n, amount)))
    out = out.unionByName(flags.where("rule_id = 'childcare_valid_complaint'").agg(count).select(*row("story", F.lit("complaints"), n, F.lit(0.0))))
    if runs is None:
        return out
    last = runs.groupBy("source").agg(count, F.max("ran_at").alias("ran_at"))
    return out.unionByName(last.select(*row("ingest", F.concat("source", F.lit(" @ "), "ran_at"), n, F.lit(0.0))))


def story_totals(rows: DataFrame, kind: str, document: str, path: str) -> DataFrame:
    """Per kind its rows and the sum of a whole number inside a JSON document; documents without it add nothing."""
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.try_variant_get(F.try_parse_json(document), path, "bigint")).alias("total"))


def density(rows: DataFrame, place: str) -> DataFrame:
    """Per place (trimmed, upper case) the number of rows, their funds and how many score at least 40."""
    return rows.groupBy(F.upper(F.trim(place)).alias("place")).agg(F.count("*").alias("n"), F.round(F.sum("funds"), 2).alias("funds"), F.count_if(F.col("score") >= 40).alias("high"))


#: Characters of the pieces in the search index.
GRAM = 3


def _fields(entities: DataFrame) -> Column:
    """Everything that a search looks at, in small letters."""
    own = F.array(*[F.coalesce(F.lower(c), F.lit("")) for c in ("name", "source_id", "city")])
    return F.concat(own, F.coalesce(F.transform(F.map_values("raw"), lambda v: F.coalesce(F.lower(v), F.lit(""))), F.array().cast("array<string>")))


def _grams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def search_index(entities: DataFrame) -> DataFrame:
    """gram and uid: every run of GRAM characters of an entity's name, id, city and raw values, to be kept as a table in the order of its grams, so that a
    search reads few of its files."""
    grams = F.array_distinct(F.flatten(F.transform(_fields(entities), _grams)))
    return entities.select("uid", F.explode(grams).alias("gram")).select("gram", "uid").repartitionByRange("gram").sortWithinPartitions("gram", "uid")


def candidates(index: DataFrame, text: str) -> DataFrame:
    """uids that have every run of GRAM characters of the text."""
    low = text.lower()
    wanted = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
    return index.where(F.col("gram").isin(wanted)).groupBy("uid").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("uid")


def search_all(entities: DataFrame, scored: DataFrame, text: str, index: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The first `limit` entities by score whose name, id, city or any raw value holds the text, whatever the case. With search_index() only entities that have
    all its pieces are looked at; a text shorter than a piece is looked for everywhere."""
    if index is not None and len(text) >= GRAM:
        entities = entities.join(candidates(index, text), "uid", "left_semi")
    rows = entities.where(F.exists(_fields(entities), lambda v: v.contains(text.lower())))
    rows = rows.join(scored.select(F.col("entity_uid").alias("uid"), "risk_score"), "uid", "left").select("uid", "name", "source", "city", "risk_score")
    return rows.orderBy(F.desc_nulls_last("risk_score"), "uid").limit(limit)


def search_operators(found: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """The first `limit` operators (operator_id, name, score) by score whose name holds the text."""
    return found.where(F.lower("name").contains(text.lower())).orderBy(F.desc("score"), "operator_id").limit(limit)


def search(rows: DataFrame, text: str, limit: int = 10) -> DataFrame:
    return rows.where(F.col("name").ilike(f"%{text}%")).orderBy(F.desc("score"), "uid").limit(limit)


def random_lead(rows: DataFrame, seed: int) -> DataFrame:
    """One row (uid, score, and state where triaged) of the middle band that nobody has looked at, picked by a seeded hash."""
    calm = rows.where("coalesce(state, '') = ''") if "state" in rows.columns else rows
    return calm.where("score between 25 and 79").orderBy(F.xxhash64("uid", F.lit(seed)), "uid").limit(1)

"""From entities to cross-source operators: match keys, links, components, structure signals and their bonus.

Entities have uid, source, source_id, name, dba, address, city, zip, status, amount and the map raw. All of it is relational: keys are exploded and
counted before they are joined, each signal is an aggregate per component, and the bonus is arithmetic on one row per component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions.names import brand_key, brand_or_name, distinctive, generic, venue, without_site
from registrum.functions.text import address_key, address_line, blank, email, first_of, name_key, person_key, phone, upper_key, year
from registrum.session import staged

from .graph import components
from .linkage import first_wins
from .rules import open_brands

#: Sources whose names are people's, and those whose addresses are streets.
PEOPLE, STREETS = ("healthcare",), ("childcare",)
# Kinds of agreements that carry no procurement money.
ROUTINE = ["DATA SHAR", "DATA-SHAR", "MEMORANDUM OF UNDERSTANDING", "ORGANIZATIONAL LICENSE", "COMPUTER AND INFORMATION SERVICES", "NON-FINANCIAL", "NURSING FACILITY SERVICES"]
ROUTINE_FIELDS = ("procurement_type", "purpose_of_the_contract", "purpose_of_the_contract_1")


def raw(field: str) -> Column:
    return F.col("raw")[field]


def contract(source: Column) -> Column:
    return source.startswith("contracts")


def program(source: Column) -> Column:
    """Snapshot years of contracts are one program."""
    return F.when(contract(source), "contracts").otherwise(source)


def substantive(amount: Column, status: Column) -> Column:
    """Whether a contract carries real money: an amount, and no word of a routine agreement in its fields."""
    text = F.upper(F.concat_ws(" ", *[F.coalesce(raw(f), F.lit("")) for f in ROUTINE_FIELDS], F.coalesce(status, F.lit(""))))
    return (F.coalesce(amount, F.lit(0.0)) > 0) & ~text.rlike("|".join(ROUTINE))


def organization_keys(name: Column, dba: Column) -> Column:
    """org: keys of a name and a trade name; not of generic ones, and of a trade name only with two distinctive words."""

    def fine(c: Column) -> Column:
        key = name_key(c)
        return (F.length(key) >= 4) & ~generic(key)

    own = F.when(fine(name), F.concat(F.lit("org:"), name_key(name)))
    trade = F.when(fine(dba) & ((dba == name) | (F.size(distinctive(dba)) >= 2)), F.concat(F.lit("org:"), name_key(dba)))
    return F.array_compact(F.array(own, trade))


def match_keys(entities: DataFrame, streets: tuple[str, ...] = STREETS) -> DataFrame:
    """uid and key of every key by which an entity meets others: organization names, people, mail, phone and street addresses."""
    source, person = F.col("source"), F.col("source").isin(*PEOPLE)
    care = source == "childcare"
    mail = F.nullif(email(blank(raw("primarycontactemail"))), F.lit(""))
    made = [
        F.when(care, F.concat(F.lit("person:"), person_key(raw("primarycontactpersonname")))), F.when(care, F.concat(F.lit("email:"), mail)), F.when(care, F.concat(F.lit("phone:"), phone(raw("primarycontactphonenumber")))),
        F.when(person, F.concat(F.lit("person:"), person_key(F.col("name")))), F.when(source.isin(*streets), F.concat(F.lit("addr:"), address_key(blank(F.col("address")), F.col("city"), F.col("zip")))),
    ]
    names = F.when(person, F.array().cast("array<string>")).otherwise(organization_keys(blank(F.col("name")), blank(F.col("dba"))))
    return entities.select("uid", F.explode(F.array_union(names, F.array_compact(F.array(*made)))).alias("key"))


def registry_keys(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """uid and key of entities found in a business registry (name, ubi, agent, governors) by name, else by trade name: its number, agent and
    officers. Of registry rows with one name the first stays."""
    side = first_wins(registry.withColumn("name_key", name_key(F.col("name"))).where("name_key <> ''"), ["name_key"], ["ubi", "agent"])
    record = side.select("name_key", F.struct("ubi", "agent", "governors").alias("rec"))
    keyed = entities.select("uid", name_key(F.col("name")).alias("k1"), name_key(F.col("dba")).alias("k2"))
    met = keyed.join(record.select(F.col("name_key").alias("k1"), F.col("rec").alias("r1")), "k1", "left").join(record.select(F.col("name_key").alias("k2"), F.col("rec").alias("r2")), "k2", "left")
    rec = F.coalesce("r1", "r2")
    named = lambda c: F.filter(F.transform(c, name_key), lambda k: F.length(k) >= 4)
    ubi = F.transform(F.filter(F.array(rec["ubi"]), lambda u: blank(u) != ""), lambda u: F.concat(F.lit("ubi:"), name_key(u)))
    agents = F.transform(named(F.array(rec["agent"])), lambda k: F.concat(F.lit("agent:"), k))
    officers = F.transform(named(F.coalesce(rec["governors"], F.array().cast("array<string>"))), lambda k: F.concat(F.lit("gov:"), k))
    return met.where(rec.isNotNull()).select("uid", F.explode(F.array_distinct(F.concat(ubi, agents, officers))).alias("key"))


def owner_keys(entities: DataFrame, owned: DataFrame) -> DataFrame:
    """uid and owner: key of organizations (org, owner) that owners hold, met by name. Shared billing groups are no such key: they chain strangers through large employers."""
    named = entities.where(~F.col("source").isin(*PEOPLE)).select("uid", name_key(F.col("name")).alias("org"))
    return named.join(owned.select("org", "owner").distinct(), "org").select("uid", F.concat(F.lit("owner:"), "owner").alias("key"))


def sized_keys(keys: DataFrame, least: int = 2, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Keys (key, members) that `least` to `most` uids share, and those that more share and that therefore link nothing."""
    sizes = keys.groupBy("key").agg(F.count_distinct("uid").alias("members")).where(F.col("members") >= least)
    return sizes.where(F.col("members") <= most), sizes.where(F.col("members") > most)


def folded_members(rows: DataFrame) -> DataFrame:
    """rows (root and entity columns) with one row per contract: of the snapshots of a vendor's contract, whatever zeros lead its number, the newest source."""
    kept = first_wins(rows.where(contract(F.col("source"))).withColumn("__name", name_key(F.col("name"))).withColumn("__id", F.regexp_replace("source_id", "^0+", "")), ["root", "__name", "__id"], [F.desc("source"), "uid"]).drop("__name", "__id")
    return rows.where(~contract(F.col("source"))).unionByName(kept)


def colocated(members: DataFrame, keys: DataFrame) -> DataFrame:
    """root of components in which an address key joins two brands that aren't a host's: members (root, uid, name, dba), keys (uid, key)."""
    met = members.join(keys.where("key like 'addr:%'"), "uid").groupBy("root", "key").agg(F.count_distinct("uid").alias("n"), F.count_distinct(F.when(~venue(F.col("name"), F.col("dba")), brand_or_name(F.col("name")))).alias("brands"))
    return met.where("n >= 2 and brands >= 2").select("root").distinct()


def documented(members: DataFrame) -> DataFrame:
    """root of components in which a contract's trade name is another member's name, site numbers aside."""
    names = members.where("coalesce(name, '') <> ''").select("root", without_site(name_key(F.col("name"))).alias("key")).distinct()
    trade = members.where(contract(F.col("source")) & (blank(F.col("dba")) != "") & (name_key(F.col("dba")) != name_key(F.col("name"))))
    return trade.select("root", without_site(name_key(F.col("dba"))).alias("key")).join(names, ["root", "key"], "left_semi").select("root").distinct()


def franchises(entities: DataFrame, sites: int = 10, contacts: int = 3) -> DataFrame:
    """brand of child-care names with at least `sites` sites and `contacts` different contact persons in the whole corpus."""
    person = F.nullif(upper_key(raw("primarycontactpersonname")), F.lit(""))
    rows = entities.where("source = 'childcare'").select(brand_key(F.col("name")).alias("brand"), person.alias("contact"))
    seen = rows.where("brand <> ''").groupBy("brand").agg(F.count("*").alias("sites"), F.count_distinct("contact").alias("contacts"))
    return seen.where((F.col("sites") >= sites) & (F.col("contacts") >= contacts)).select("brand")


def component_brand(members: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """root and brand of components whose names openly carry one brand, or half of them a franchise's (rows of franchises())."""
    orgs = members.where(~F.col("source").isin(*PEOPLE))
    names = orgs.select("root", F.explode(F.array("name", "dba")).alias("name")).where("coalesce(name, '') <> ''")
    own = open_brands(names, "root")
    if chains is None:
        return own
    brand = F.when(brand_key(F.col("name")) != "", brand_key(F.col("name"))).otherwise(brand_key(F.col("dba")))
    counted = orgs.select("root", brand.alias("brand")).where("brand <> ''").groupBy("root", "brand").agg(F.count("*").alias("n"))
    top = counted.groupBy("root").agg(F.min_by("brand", F.struct(-F.col("n"), "brand")).alias("brand"), F.max("n").alias("n"), F.sum("n").alias("all"))
    wide = top.where("n / all >= 0.5").join(chains, "brand", "left_semi").join(own, "root", "left_anti").select("root", "brand")
    return own.unionByName(wide)


def bridges(members: DataFrame, today: str, counts: DataFrame | None = None, national: DataFrame | None = None) -> DataFrame:
    """root, bridge (the bonus), common, mail_differs, years_dead and refuted of components that tie a child-care contact to a sanctioned credential by a person's name.

    25, or 10 for a name that more than two hold in the corpus (counts: person, n) or more than five in the country (national: person, n); half
    where the contact's mail address hasn't the surname; half or a quarter for a credential dead more than 5 or 10 years; nothing where middle
    names differ or the holder would have been under 16 when the site was licensed."""
    now = F.year(F.lit(today).cast("date"))
    holders = members.where("source = 'healthcare'").select(
        "root", person_key(F.col("name")).alias("person"), F.element_at(F.split(upper_key(F.col("name")), " "), -1).alias("surname"), F.size(F.split(upper_key(F.col("name")), " ")).alias("words"), year(raw("expirationdate")).alias("ends"), year(raw("birthyear")).alias("birth"),
        F.nullif(upper_key(blank(raw("middlename"))), F.lit("")).alias("middle"),
    )
    per = holders.groupBy("root").agg(
        F.collect_set("person").alias("people"), F.collect_set(F.when((F.col("words") >= 2) & (F.length("surname") >= 4), F.col("surname"))).alias("surnames"), F.max("ends").alias("ends"), F.max("birth").alias("birth"), F.collect_set("middle").alias("middles"),
    )
    contact = raw("primarycontactpersonname")
    inner = F.filter(F.slice(F.split(upper_key(contact), " "), 2, F.greatest(F.size(F.split(upper_key(contact), " ")) - 2, F.lit(0))), lambda t: F.length(t) > 1)
    local = F.regexp_replace(upper_key(F.substring_index(blank(raw("primarycontactemail")), "@", 1)), " ", "")
    licensed = F.coalesce(year(raw("licenseeffectivedate")), year(raw("firstissuedate")))
    sites = members.where("source = 'childcare'").select("root", person_key(contact).alias("person"), local.alias("local"), inner.alias("inner"), licensed.alias("licensed"))
    met = sites.join(per, "root")
    linked = F.coalesce(F.array_contains("people", F.col("person")), F.lit(False))
    stranger = linked & (F.col("local") != "") & (F.size("surnames") > 0) & ~F.exists("surnames", lambda s: F.col("local").contains(s))
    initials = lambda c: F.transform(c, lambda t: F.left(t, F.lit(1)))
    apart = linked & (F.size("middles") > 0) & (F.size("inner") > 0) & ~F.arrays_overlap("middles", "inner") & ~F.arrays_overlap(initials(F.col("middles")), initials(F.col("inner")))
    young = linked & F.coalesce(F.col("licensed") - F.col("birth") < 16, F.lit(False))
    out = met.groupBy("root").agg(F.bool_or(stranger).alias("mail_differs"), F.bool_or(apart | young).alias("refuted"), F.first("ends").alias("ends"), F.first("people").alias("people"))
    out = out.withColumn("years_dead", F.coalesce(now - F.col("ends"), F.lit(0)))
    names = out.select("root", F.explode("people").alias("person"))
    for table, limit, column in ((counts, 2, "often"), (national, 5, "far")):
        if table is None:
            out = out.withColumn(column, F.lit(False))
        else:
            busy = names.join(table.where(F.col("n") > limit), "person", "left_semi").select("root").distinct().withColumn(column, F.lit(True))
            out = out.join(busy, "root", "left").withColumn(column, F.coalesce(column, F.lit(False)))
    out = out.withColumn("common", F.col("often") | F.col("far"))
    points = F.when(F.col("common"), 10).otherwise(25)
    points = F.when(F.col("mail_differs"), F.bround(points * 0.5, 0)).otherwise(points)
    points = first_of((F.col("years_dead") > 10, F.bround(points * 0.25, 0)), (F.col("years_dead") > 5, F.bround(points * 0.5, 0)), default=points)
    points = F.when(F.col("refuted"), 0).otherwise(points).cast("double")
    return out.select("root", points.alias("bridge"), "common", "mail_differs", "years_dead", "refuted")


def structure(members: DataFrame, flags: DataFrame, bridge: DataFrame, brands: DataFrame, hard: DataFrame) -> DataFrame:
    """One row per component: its programs, whether it surfaces, its strongest link and the bonus of its structure.

    members: root, uid, source, name, address and the column `real` (a substantive contract; null elsewhere). flags: root and the booleans
    colocated, fuzzy, geo, dba, verified. hard: root, bonus, ubi, agent, gov, owner of identity_signals(). Programs count 10, child care with contracts 15,
    a shared address 18, name variants 8, nearness 16; less under one open brand; three tenths of it all without verified evidence. The
    bridge is added whole, hard identifiers in three tenths without evidence."""
    per = members.groupBy("root").agg(F.collect_set(program(F.col("source"))).alias("programs"), F.count("*").alias("members"), F.bool_or(F.coalesce("real", F.lit(False))).alias("real"))
    real = F.filter("programs", lambda p: (p != "contracts") | F.col("real"))
    rows = per.withColumn("programs", F.array_sort("programs")).withColumn("counted", F.array_sort(real))
    for side in (flags, bridge.select("root", "bridge"), brands.select("root", "brand"), hard.withColumnRenamed("bonus", "identity")):
        rows = rows.join(side, "root", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    branded, has = F.col("brand").isNotNull(), lambda p: F.array_contains("counted", p)
    some = F.size("counted") >= 2
    points = F.when(some, 10).otherwise(0) + F.when(has("childcare") & has("contracts"), F.when(branded, 4).otherwise(15)).otherwise(0) + F.when(yes("colocated"), F.when(branded, 5).otherwise(18)).otherwise(0)
    points = points + F.when(yes("fuzzy"), F.when(branded, 2).otherwise(8)).otherwise(0) + F.when(yes("geo"), F.when(branded, 4).otherwise(16)).otherwise(0)
    scale = lambda c: F.when(yes("verified"), c).otherwise(F.bround(c * 0.3, 0))
    total = scale(points) + F.when(has("childcare") & has("healthcare"), F.coalesce("bridge", F.lit(0.0))).otherwise(0) + scale(F.coalesce("identity", F.lit(0)))
    link = first_of(
        (yes("ubi") | yes("owner"), "hard"), (yes("dba"), "dba"), (yes("agent") | yes("gov"), "shell"), (yes("colocated"), "address"), (yes("geo"), "geo"), (yes("fuzzy"), "fuzzy"), (some, "cross-program"), default="name",
    )
    surfaces = some | yes("colocated") | yes("fuzzy") | yes("geo") | yes("ubi") | yes("agent") | yes("gov") | yes("owner")
    return rows.select("root", "programs", "members", some.alias("cross_program"), surfaces.alias("surfaces"), link.alias("strongest_link"), total.cast("double").alias("bonus"), "brand")


def identity_signals(members: DataFrame, keys: DataFrame) -> DataFrame:
    """root, the kinds of hard identifier (ubi, agent, gov, owner) that at least two members share, and their bonus; agents and officers count only
    across two brands. members: root, uid, name; keys: uid, key, already of a size that links."""
    met = members.select("root", "uid", brand_or_name(F.col("name")).alias("brand")).join(keys.withColumn("kind", F.substring_index("key", ":", 1)).where("kind in ('ubi', 'agent', 'gov', 'owner')"), "uid")
    shared = met.groupBy("root", "kind", "key").agg(F.count_distinct("uid").alias("n"), F.count_distinct("brand").alias("brands")).where("n >= 2 and (kind not in ('agent', 'gov') or brands >= 2)")
    out = shared.groupBy("root").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("ubi", "agent", "gov", "owner")])
    return out.withColumn("bonus", F.when(F.col("ubi"), 16).otherwise(0) + F.when(F.col("agent"), 14).otherwise(0) + F.when(F.col("gov"), 12).otherwise(0) + F.when(F.col("owner"), 16).otherwise(0))


def linked_pairs(members: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """root and the boolean `name` of components in which at least two members of pairs (a, b) have different names, and, for `geo`, different addresses too."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    met = members.join(ends, "uid").groupBy("root").agg(F.count_distinct("uid").alias("n"), F.count_distinct(name_key(F.col("name"))).alias("names"), F.count_distinct(address_line(F.col("address"), F.col("city"), F.col("zip"))).alias("places"))
    return met.where("n >= 2 and names >= 2" + (" and places >= 2" if name == "geo" else "")).select("root", F.lit(True).alias(name))


def assembled(entities: DataFrame, keys: DataFrame, fuzzy: DataFrame, geo: DataFrame, verified: DataFrame, today: str, most: int = 8, counts: DataFrame | None = None, national: DataFrame | None = None, chains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (root and entity columns, one row per contract) of every component of keys (uid, key) and pairs (a, b), and structure() of them.

    verified: uid of members with evidence that doesn't rest on a person's name. Every entity is a component, alone or not; those that don't
    surface have the column so."""
    small, _ = sized_keys(keys, most=most)
    met = keys.join(small.select("key"), "key").select("uid", "key").distinct()
    lowest = met.groupBy("key").agg(F.min("uid").alias("b"))
    edges = met.join(lowest, "key").select(F.col("uid").alias("a"), "b").unionByName(fuzzy.select("a", "b")).unionByName(geo.select("a", "b"))
    alone = entities.select(F.col("uid").alias("a"), F.col("uid").alias("b"))
    roots = components(edges.unionByName(alone).distinct())
    rows = entities.join(roots, entities["uid"] == roots["node"]).drop("node")
    members = staged(folded_members(rows).withColumn("real", F.when(contract(F.col("source")), substantive(F.col("amount"), F.col("status")))), "members")
    flags = members.select("root").distinct()
    for side in (colocated(members, met).withColumn("colocated", F.lit(True)), linked_pairs(members, fuzzy, "fuzzy"), linked_pairs(members, geo, "geo"), documented(members).withColumn("dba", F.lit(True)), members.join(verified.select("uid"), "uid", "left_semi").where(~F.col("source").isin(*PEOPLE)).select("root").distinct().withColumn("verified", F.lit(True))):
        flags = flags.join(side, "root", "left")
    return members, structure(members, flags, bridges(members, today, counts, national), component_brand(members, chains), identity_signals(members, met))


def name_counts(entities: DataFrame) -> DataFrame:
    """person and n: how many credentials and child-care contacts have a person's first and last name."""
    people = entities.where("source = 'healthcare'").select(person_key(F.col("name")).alias("person")).unionByName(entities.where("source = 'childcare'").select(person_key(raw("primarycontactpersonname")).alias("person")))
    return people.where("person is not null").groupBy("person").agg(F.count("*").alias("n"))


def bumped(operators: DataFrame, audits: DataFrame | None = None, agreements: DataFrame | None = None, revoked: DataFrame | None = None) -> DataFrame:
    """operators (ein, name, score) with the score raised by what independent sources hold: audits (ein, questioned, weakness, repeated: counts) by 10, 6
    and 4, integrity agreements (name_key) by 8, a lost exemption (ein) by 10; 100 at most."""
    out = operators.withColumn("__up", F.lit(0))
    if audits is not None:
        points = F.when(F.col("questioned") > 0, 10).otherwise(0) + F.when(F.col("weakness") > 0, 6).otherwise(0) + F.when(F.col("repeated") > 0, 4).otherwise(0)
        out = out.join(audits.select("ein", points.alias("__a")), "ein", "left").withColumn("__up", F.col("__up") + F.coalesce("__a", F.lit(0))).drop("__a")
    if agreements is not None:
        known = agreements.select("name_key").distinct().withColumn("__c", F.lit(8))
        out = out.withColumn("name_key", name_key(F.col("name"))).join(known, "name_key", "left").withColumn("__up", F.col("__up") + F.coalesce("__c", F.lit(0))).drop("__c", "name_key")
    if revoked is not None:
        lost = revoked.select("ein").distinct().withColumn("__r", F.lit(10))
        out = out.join(lost, "ein", "left").withColumn("__up", F.col("__up") + F.coalesce("__r", F.lit(0))).drop("__r")
    return out.withColumn("score", F.least(F.lit(100.0), F.bround(F.col("score") + F.col("__up"), 1))).drop("__up")

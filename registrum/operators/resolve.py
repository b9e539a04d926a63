"""Cross-source operators: connected components of entities, rolled up and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registrum.functions.names import institution as institutional
from registrum.functions.text import first_of, operator_id, person_key
from registrum.session import staged

from . import assembly, graph, linkage


def rollup(members: DataFrame) -> DataFrame:
    """One row per component of members (root, uid, source, name, person, score, funds, barred, sanctioned, contradiction).

    People are counted once, and so are the yearly sources of contracts. A barred or sanctioned member is verified unless it is a health-care
    credential, which meets others by a person's name only. The base score is that of the first member by bar, score and money. The name is that of a verified barred member in this
    place, else of the organization with the most money, else the longest."""
    order = F.struct("barred", "score", "funds", "uid")
    org = F.col("source") != "healthcare"
    adverse = F.col("barred") | F.col("sanctioned")
    rows = members.groupBy("root").agg(
        operator_id(F.collect_set("uid")).alias("operator_id"), F.count_distinct("uid").alias("members"), F.count_distinct(assembly.program(F.col("source"))).alias("sources"),
        F.count_distinct(F.when(F.col("barred"), F.col("person"))).alias("barred_people"), F.count_distinct(F.when(F.col("sanctioned"), F.col("person"))).alias("sanctioned_people"), F.count_distinct(F.when(adverse & org, F.col("person"))).alias("verified"),
        F.round(F.sum("funds"), 2).alias("funds"), F.round(F.sum("contradiction"), 2).alias("contradiction"), F.coalesce(F.sum(F.when(F.col("sanctioned"), F.col("funds"))), F.lit(0.0)).alias("sanctioned_funds"),
        F.max_by(F.struct("source", "name", "barred", "score"), order).alias("top"), F.max_by(F.struct("name", "funds"), F.when(org, F.struct("funds", "uid"))).alias("paid"), F.max_by("name", F.struct(org, F.length("name"), F.col("uid"))).alias("longest"),
    )
    name = first_of((F.col("top.barred") & (F.col("top.source") != "healthcare"), F.col("top.name")), (F.col("paid.funds") > 0, F.col("paid.name")), default=F.col("longest"))
    unproven = (F.col("verified") == 0) & (F.col("barred_people") + F.col("sanctioned_people") > 0) & (F.col("top.source") == "healthcare")
    base = F.when(unproven, F.least(F.col("top.score"), F.lit(15.0))).otherwise(F.col("top.score"))
    return rows.withColumn("name", name).withColumn("base", base).drop("top", "paid", "longest")


def scored(rolled: DataFrame, bonus: Column | float = 0.0, institution: Column | bool = False, large: int = 20) -> DataFrame:
    """The operator's score, 100 at most: its base, the bonus of its structure, 30 for money that contradicts a bar, 15 for a barred person in an
    operator with money to sanctioned members, up to 12 for further barred people. Institutions without verified evidence count half, large
    groups without any 0.4; without money and verified evidence 45 is the most."""
    bonus = bonus if isinstance(bonus, Column) else F.lit(float(bonus))
    institution = institution if isinstance(institution, Column) else F.lit(institution)
    barred, calm = F.col("barred_people"), F.col("contradiction") == 0
    s = F.col("base") + bonus + F.when(calm, 0).otherwise(30) + F.when((barred >= 1) & (F.col("sanctioned_funds") > 0), 15).otherwise(0) + F.when(barred >= 2, F.least(F.lit(12), 4 * (barred - 1))).otherwise(0)
    s = F.least(s, F.lit(100.0))
    s = F.when(institution & (F.col("verified") == 0) & calm, s * 0.5).otherwise(s)
    s = F.when((F.col("members") >= large) & (barred == 0) & calm, s * 0.4).otherwise(s)
    s = F.when((F.col("funds") == 0) & (F.col("verified") == 0) & calm, F.least(s, F.lit(45.0))).otherwise(s)
    return rolled.withColumn("score", F.bround(s, 1)).drop("base")


def person(rows: DataFrame) -> Column:
    """Who a member of rows (uid, source, name, raw) is: credentials of one name and birth year are one person, all else stands for itself."""
    of = F.concat_ws("|", person_key(F.col("name")), F.coalesce(rows["raw"]["birthyear"], F.lit("")))
    return F.when(F.col("source").isin(*assembly.PEOPLE) & person_key(F.col("name")).isNotNull(), of).otherwise(F.col("uid"))


def resolved(entities: DataFrame, scores: DataFrame, facts: DataFrame, today: str, registry: DataFrame | None = None, owned: DataFrame | None = None, national: DataFrame | None = None, most: int = 8, least: float = 0.9, metres: float = 50.0, dense: int = 15) -> tuple[DataFrame, DataFrame]:
    """From entities to scored operators: the operators that surface, one row each, and their members in order.

    entities: the columns of assembly and lat, lon. scores: uid, score. facts: uid, funds, barred, sanctioned, contradiction of payments.member_facts();
    both may lack entities, which then count nothing. registry and owned: optional tables of assembly.registry_keys() and owner_keys(); national:
    how many in the country have a name. Entities meet by the keys that at most `most` share, by names alike by `least`, and by places within
    `metres` where at most `dense` are around. Bonus, institution (any member's name or mail address, or the operator's name) and
    verified evidence come from the members. Keys, pairs and members are staged, each once, and no operator is gathered in a row but for its uids.

    Members have operator_id, place (from 1: barred first, then by score and money), uid, source, name, status, score, funds, barred, sanctioned."""
    keys = assembly.match_keys(entities)
    if registry is not None:
        keys = keys.unionByName(assembly.registry_keys(entities, registry))
    if owned is not None:
        keys = keys.unionByName(assembly.owner_keys(entities, owned))
    source = F.col("source")
    named = linkage.near_names(entities.where(~source.isin(*assembly.PEOPLE)).select("uid", "name"), least)
    fuzzy = staged(named.select(F.col("uid").alias("a"), F.col("uid2").alias("b")), "fuzzy")
    near = staged(graph.geo_pairs(entities.where(source.isin(*assembly.STREETS)).select("uid", "lat", "lon"), metres, dense).select("a", "b"), "near")
    adverse = facts.where("barred or sanctioned").select("uid")
    members, found = assembly.assembled(entities, staged(keys.distinct(), "keys"), fuzzy, near, adverse, today, most, assembly.name_counts(entities), national, assembly.franchises(entities))
    found = staged(found.where("surfaces"), "surfacing")
    rows = members.join(found.select("root"), "root", "left_semi")
    rows = rows.join(scores.select("uid", "score"), "uid", "left").join(facts.select("uid", "funds", "barred", "sanctioned", "contradiction"), "uid", "left")
    rows = staged(rows.withColumn("person", person(rows)).fillna(0.0, ["score", "funds", "contradiction"]).fillna(False, ["barred", "sanctioned"]), "rated")
    public = rows.groupBy("root").agg(F.bool_or(institutional(F.col("name"), F.col("raw")["primarycontactemail"])).alias("__public"))
    rolled = rollup(rows).join(found.drop("members"), "root").join(public, "root")
    out = staged(scored(rolled, F.col("bonus"), F.col("__public") | institutional(F.col("name"))).drop("__public", "surfaces"), "operators")
    order = [F.desc("barred"), F.desc("score"), F.desc("funds"), F.desc("uid")]
    turn = F.row_number().over(Window.partitionBy("root").orderBy(*order)).alias("place")
    listed = rows.select("root", turn, "uid", "source", "name", "status", "score", "funds", "barred", "sanctioned")
    return out.drop("root"), listed.join(out.select("root", "operator_id"), "root").drop("root")


def identity_bonus(keys: DataFrame) -> DataFrame:
    """root and bonus of components whose members share hard identifiers: keys (root, uid, kind, key, brand) of the kinds ubi (16), agent (14),
    gov (12) and owner (16). Agents and officers count only across different brands."""
    shared = keys.groupBy("root", "kind", "key").agg(F.count_distinct("uid").alias("n"), F.count_distinct("brand").alias("brands"))
    shared = shared.where((F.col("n") >= 2) & (~F.col("kind").isin("agent", "gov") | (F.col("brands") >= 2))).select("root", "kind").distinct()
    points = first_of((F.col("kind").isin("ubi", "owner"), 16), (F.col("kind") == "agent", 14), (F.col("kind") == "gov", 12), default=0)
    return shared.groupBy("root").agg(F.sum(points).alias("bonus"))

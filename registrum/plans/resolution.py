"""Registered queries of the job from entities to scored operators, over customers that are dealt six to a family of registrations.

Names, people and places are words made of a hash of the family's number, so there are as many different ones as there are rows; money, bars and
scores are the customers' own balances and orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions.text import first_of
from registrum.operators import payments, resolve
from registrum.plans.catalogue import pick, query, sql_pick

ENDS = ["2024-01-01", "2012-05-05", "2017-06-30", "", "2008-01-01"]
DAY = "2024-06-01"


def dealt() -> tuple[Column, Column]:
    """A customer's family and place in it."""
    return F.floor(F.col("c_custkey") / 6), F.col("c_custkey") % 6


def word(kind: str) -> Column:
    """A word of eight letters of the family."""
    return F.translate(F.left(F.md5(F.concat(F.lit(kind), dealt()[0].cast("string"))), F.lit(8)), "0123456789", "ghijklmnop")


def _sql_word(kind: str) -> str:
    return f"translate(left(md5('{kind}' || g), 8), '0123456789', 'ghijklmnop')"


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def families(t) -> DataFrame:
    """A family: two sites, a credential (or two) of the contact or of a namesake, a contract in two years, a hospice."""
    g, r = dealt()
    toybox, contact = text(word("t"), " Toybox"), text(word("a"), " ", word("b"))
    chain, buyer, again = g % 9 == 8, r.isin(2, 3), g % 10 == 9
    source = first_of((r.isin(0, 4), "childcare"), (r == 1, "healthcare"), (r == 2, "contracts"), (r == 3, "contracts_2024"), (again, "healthcare"), default="hospice")
    second = first_of((chain, text("Quokka Meadow of ", word("k"))), (g % 7 < 3, text(word("t"), " Toyboxes")), (g % 7 == 5, text("City of ", word("k"))), default=text(word("k"), " Ark"))
    name = first_of(
        (r == 0, toybox), (r == 1, F.when(g % 3 == 0, text(word("x"), " ", word("y"))).otherwise(contact)), (buyer, F.when(g % 4 == 2, toybox).otherwise(text(word("s"), " Supply"))), (r == 4, second), (again, contact), default=text(word("r"), " Rest"),
    )
    elm = (r == 0) | ((r == 4) & (chain | (g % 7 == 3)))
    mail = first_of((g % 4 == 0, text("desk", g, "@x.org")), (g % 4 == 1, text(word("b"), "@x.org")), (g % 4 == 3, text("m", g, "@base.army.mil")), default="")
    lat, lon = 45.1 + (g % 400) * 0.01, -124.9 + F.floor(g / 400) * 0.02
    raw = F.create_map(
        F.lit("primarycontactpersonname"), first_of((r == 0, contact), (r == 4, text(word("p"), " ", word("q")))), F.lit("primarycontactemail"), F.when(r == 0, mail), F.lit("licenseeffectivedate"), F.when(r == 0, "2010-01-01"),
        F.lit("birthyear"), first_of((r == 1, F.when(g % 11 == 0, "2001").otherwise("1970")), (r == 5, "1980")), F.lit("expirationdate"), pick(ENDS, g), F.lit("procurement_type"), F.when(g % 5 == 0, "Data Sharing").otherwise("Sole source"),
    )
    return t("customer").select(
        text("e", F.col("c_custkey")).alias("uid"), source.alias("source"), first_of((r == 2, text("00", g)), (r == 3, g.cast("string")), default=F.col("c_custkey").cast("string")).alias("source_id"), name.alias("name"), F.when(buyer & (g % 4 == 1), toybox).otherwise("").alias("dba"),
        first_of((elm, text(g, " Elm Street")), (r == 4, text(g, " Oak Street")), default="").alias("address"), F.lit("Kent").alias("city"), F.lit("98101").alias("zip"), F.lit("Active").alias("status"), F.col("c_acctbal").cast("double").alias("amount"), raw.alias("raw"),
        first_of((r == 0, lat), ((r == 4) & ~chain & (g % 7 == 4), lat + 0.0001)).alias("lat"), F.when(r.isin(0, 4), lon).alias("lon"),
    )


def inputs(t) -> dict[str, DataFrame]:
    """Scores, flags and money of the families from balances and orders, a business registry and owners."""
    g, r = dealt()
    customers, uid, balance = t("customer"), text("e", F.col("c_custkey")), F.col("c_acctbal").cast("double")
    orders = t("orders").select(text("e", F.col("o_custkey")).alias("uid"), F.col("o_totalprice").cast("double").alias("amount"))
    none = F.lit(None).cast("string")
    standing = customers.where(balance < 1000).select(uid.alias("entity_uid"), F.when(balance < 0, "credential_revoked_or_suspended").otherwise("credential_active_with_conditions").alias("rule_id"), none.alias("evidence"))
    late = orders.where("amount > 400000").select(F.col("uid").alias("entity_uid"), F.lit("paid_after_barred").alias("rule_id"), F.to_json(F.struct(F.col("amount").alias("amount_after"))).alias("evidence"))
    flags = standing.unionByName(late).select("*", F.lit(1.0).alias("severity"), F.lit("").alias("title"))
    facts = payments.member_facts(flags, orders.groupBy("uid").agg(F.round(F.sum("amount"), 2).alias("funds")))
    site, agent, person = r == 0, text("Agent ", word("g")), text(word("v"), " ", word("w"))
    companies = families(t).select("uid", "name").join(customers.where((g % 7 > 1) & (site | ((r == 5) & (g % 10 != 9)))).select(
        uid.alias("uid"), F.when(site | (g % 6 == 0), text("u", g)).otherwise(text("z", g)).alias("ubi"), F.when(site | (g % 6 == 1), agent).otherwise(text("Other ", word("h"))).alias("agent"),
        F.when(site | (g % 6 == 2), F.array(person)).otherwise(F.array().cast("array<string>")).alias("governors"), F.when(g % 6 == 3, text("o", g)).alias("owner"),
    ), "uid")
    return {
        "scores": customers.select(uid.alias("uid"), (F.abs(balance) / 100).alias("score")), "facts": facts, "registry": companies.select("name", "ubi", "agent", "governors"),
        "owned": companies.where("owner is not null").select(F.upper("name").alias("org"), "owner"),
    }


_PERSON = "array_to_string(list_sort(string_split(upper({}), ' ')), ' ')"
#: The same families, their keys, components and facts, from the definitions; `op` has one row a component that surfaces, `ready` its members.
TWIN = f"""with recursive c as (select c_custkey as k, c_custkey // 6 as g, c_custkey % 6 as r, cast(c_acctbal as double) as bal from customer),
w as (select *, {_sql_word('t')} || ' Toybox' as toy, {_sql_word('a')} || ' ' || {_sql_word('b')} as contact, {_sql_word('k')} as other from c),
e as (select 'e' || k as uid, g, r, bal, toy, case when r in (0, 4) then 'childcare' when r = 1 then 'healthcare' when r = 2 then 'contracts' when r = 3 then 'contracts_2024' when g % 10 = 9 then 'healthcare' else 'hospice' end as source,
 case when r = 0 then toy when r = 1 then case when g % 3 = 0 then {_sql_word('x')} || ' ' || {_sql_word('y')} else contact end when r in (2, 3) then case when g % 4 = 2 then toy else {_sql_word('s')} || ' Supply' end
  when r = 4 then case when g % 9 = 8 then 'Quokka Meadow of ' || other when g % 7 < 3 then toy || 'es' when g % 7 = 5 then 'City of ' || other else other || ' Ark' end when g % 10 = 9 then contact else {_sql_word('r')} || ' Rest' end as name,
 case when r in (2, 3) and g % 4 = 1 then toy else '' end as dba, case when r = 0 or r = 4 and (g % 9 = 8 or g % 7 = 3) then g || ' Elm' when r = 4 then g || ' Oak' end as address,
 case r when 0 then contact when 4 then {_sql_word('p')} || ' ' || {_sql_word('q')} end as who, case when r = 0 then case g % 4 when 0 then 'desk' || g || '@x.org' when 1 then {_sql_word('b')} || '@x.org' when 3 then 'm' || g || '@base.army.mil' else '' end else '' end as mail,
 case when r = 1 then case when g % 11 = 0 then 2001 else 1970 end when r = 5 then 1980 end as birth, try_cast(left({sql_pick(ENDS, 'g')}, 4) as integer) as ends, g % 5 = 0 as routine from w),
reg as (select upper(name) as nk, case when r = 0 or g % 6 = 0 then 'u' || g else 'z' || g end as ubi, case when r = 0 or g % 6 = 1 then 'g' || g else 'h' || g end as agent, case when r = 0 or g % 6 = 2 then 'v' || g end as gov, case when g % 6 = 3 then 'o' || g end as own from e where g % 7 > 1 and (r = 0 or r = 5 and g % 10 <> 9)),
met as (select e.uid, coalesce(a.ubi, b.ubi) as ubi, coalesce(a.agent, b.agent) as agent, case when a.nk is null then b.gov else a.gov end as gov from e left join reg a on a.nk = upper(name) left join reg b on b.nk = upper(dba)),
every as (select uid, 'org:' || upper(name) as key from e where source <> 'healthcare' union select uid, 'org:' || upper(dba) from e where dba <> '' union select uid, 'person:' || {_PERSON.format('who')} from e where who is not null union select uid, 'person:' || {_PERSON.format('name')} from e where source = 'healthcare'
 union select uid, 'email:' || mail from e where mail <> '' union select uid, 'addr:' || address from e where address is not null union select uid, 'ubi:' || ubi from met where ubi is not null union select uid, 'agent:' || agent from met where agent is not null union select uid, 'gov:' || gov from met where gov is not null
 union select e.uid, 'owner:' || own from e join reg on nk = upper(name) where own is not null and source <> 'healthcare'),
keys as (select every.* from every join (select key from every group by 1 having count(*) between 2 and 8) using (key)),
fuzzy as (select a.uid as a, b.uid as b from e a join e b on upper(b.name) = upper(a.name) || 'ES' where a.source <> 'healthcare'), near as (select a.uid as a, b.uid as b from e a join e b on a.g = b.g and a.r = 0 and b.r = 4 where a.g % 9 <> 8 and a.g % 7 = 4),
tied as (select k.uid as a, m.b from keys k join (select key, min(uid) as b from keys group by 1) m using (key) union select * from fuzzy union select * from near), ways as (select a, b from tied union select b, a from tied),
reach as (select uid as a, uid as b from e union select reach.a, ways.b from reach join ways on reach.b = ways.a), roots as (select a as uid, min(b) as root from reach group by 1),
everyone as (select e.*, root, starts_with(source, 'contracts') as buys, case when name like 'Quokka%' then 'QUOKKA MEADOW' when name like 'City of %' then 'CITY' else upper(name) end as brand from e join roots using (uid)),
m as (select *, case when buys then 'contracts' else source end as program, buys and bal > 0 and not routine as real from everyone where not buys or uid not in (select o.uid from everyone o join everyone n on o.root = n.root and o.name = n.name and o.g = n.g and o.r = 2 and n.r = 3)),
late as (select 'e' || o_custkey as uid, round(sum(cast(o_totalprice as double)), 2) as funds, sum(case when o_totalprice > 400000 then cast(o_totalprice as double) end) as after from orders group by 1),
f as (select m.*, abs(bal) / 100 as score, coalesce(funds, 0) as funds, bal < 0 or after is not null as barred, bal < 1000 or after is not null as sanctioned, coalesce(after, 0) as contradiction, source <> 'healthcare' as org, case when source = 'healthcare' then {_PERSON.format('name')} || '|' || birth else uid end as person from m left join late using (uid)),
sites as (select brand from everyone where source = 'childcare' group by 1 having count(*) >= 10 and count(distinct who) >= 3),
per as (select root, list_distinct(list(program)) as programs, bool_or(real) as real, bool_or(org and (barred or sanctioned)) as adverse from f group by 1),
placed as (select distinct root from (select root, key from f join keys using (uid) where key like 'addr:%' group by 1, 2 having count(distinct uid) >= 2 and count(distinct brand) >= 2)),
alike as (select root from f where uid in (select a from fuzzy union select b from fuzzy) group by 1 having count(distinct uid) >= 2 and count(distinct name) >= 2), closeby as (select root from f where uid in (select a from near union select b from near) group by 1 having count(distinct uid) >= 2 and count(distinct name) >= 2 and count(distinct address) >= 2),
told as (select distinct x.root from f x join f y on x.root = y.root and upper(y.name) = upper(x.dba) where x.buys and x.dba <> '' and x.dba <> x.name),
hard as (select root, bool_or(kind = 'ubi') as ubi, bool_or(kind = 'agent') as agent, bool_or(kind = 'gov') as gov, bool_or(kind = 'owner') as own from (select root, split_part(key, ':', 1) as kind, key from f join keys using (uid) where split_part(key, ':', 1) in ('ubi', 'agent', 'gov', 'owner') group by 1, 2, 3 having count(distinct uid) >= 2 and (kind not in ('agent', 'gov') or count(distinct brand) >= 2)) group by 1),
said as (select root, brand from f where org union all select root, upper(dba) from f where org and dba <> ''),
branded as (select root from (select root, brand, count(*) as n, sum(count(*)) over (partition by root) as all_ from said group by 1, 2) group by root having max(all_) >= 3 and max(n) / max(all_) >= 0.7),
chain as (select root from (select root, min_by(brand, (-n, brand)) as brand, max(n) / sum(n) as share from (select root, brand, count(*) as n from f where org group by 1, 2) group by 1) where share >= 0.5 and brand in (from sites)),
often as (select person from (select {_PERSON.format('who')} as person from e where who is not null union all select {_PERSON.format('name')} from e where source = 'healthcare') group by 1 having count(*) > 2),
held as (select root, list({_PERSON.format('name')}) as people, list(upper(split_part(name, ' ', 2))) as surnames, max(ends) as ends, max(birth) as birth, bool_or({_PERSON.format('name')} in (from often)) as common from f where not org group by 1),
bridge as (select root, any_value(common) as common, coalesce(2024 - any_value(ends), 0) as dead, bool_or(linked and mail <> '' and len(list_filter(surnames, lambda s: contains(upper(split_part(mail, '@', 1)), s))) = 0) as differs, bool_or(linked and r = 0 and 2010 - birth < 16) as refuted from (select f.root, f.mail, f.r, held.* exclude (root), list_contains(people, {_PERSON.format('f.who')}) as linked from f join held using (root) where f.source = 'childcare') group by 1),
carried as (select root, case when refuted then 0 when dead > 10 then round_even(p * 0.25, 0) when dead > 5 then round_even(p * 0.5, 0) else p end as points from (select *, case when differs then round_even(q * 0.5, 0) else q end as p from (select *, case when common then 10 else 25 end as q from bridge))),
s as (select root, adverse, list_filter(programs, lambda x: x <> 'contracts' or real) as counted, root in (from placed) as colo, root in (from alike) as fuzzy, root in (from closeby) as geo, root in (from told) as dba, root in (from branded) or root in (from chain) as branded, coalesce(ubi, false) as ubi, coalesce(agent, false) as agent, coalesce(gov, false) as gov, coalesce(own, false) as own, coalesce(points, 0) as carried from per left join hard using (root) left join carried using (root)),
p as (select *, case when len(counted) >= 2 then 10 else 0 end + case when list_contains(counted, 'childcare') and list_contains(counted, 'contracts') then case when branded then 4 else 15 end else 0 end + case when colo then case when branded then 5 else 18 end else 0 end + case when fuzzy then case when branded then 2 else 8 end else 0 end + case when geo then case when branded then 4 else 16 end else 0 end as points,
 case when ubi then 16 else 0 end + case when agent then 14 else 0 end + case when gov then 12 else 0 end + case when own then 16 else 0 end as ids from s where len(counted) >= 2 or colo or fuzzy or geo or ubi or agent or gov or own),
op as (select root, len(counted) >= 2 as cross_program, case when ubi or own then 'hard' when dba then 'dba' when agent or gov then 'shell' when colo then 'address' when geo then 'geo' when fuzzy then 'fuzzy' when len(counted) >= 2 then 'cross-program' else 'name' end as strongest_link,
 case when adverse then points else round_even(points * 0.3, 0) end + case when list_contains(counted, 'childcare') and list_contains(counted, 'healthcare') then carried else 0 end + case when adverse then ids else round_even(ids * 0.3, 0) end as bonus from p),
ready as (select f.* from f semi join op using (root)),
ids as (select root, 'op:' || left(md5(string_agg(uid, '|' order by uid)), 12) as operator_id from ready group by 1),
lead as (select root, source, name, barred, score from ready qualify row_number() over (partition by root order by barred desc, score desc, funds desc, uid desc) = 1),
paid as (select root, name, funds from ready where org qualify row_number() over (partition by root order by funds desc, uid desc) = 1), longest as (select root, name from ready qualify row_number() over (partition by root order by org desc, length(name) desc, uid desc) = 1),
roll as (select root, count(distinct uid) as members, count(distinct program) as sources, count(distinct case when barred then person end) as barred_people, count(distinct case when sanctioned then person end) as sanctioned_people, count(distinct case when org and (barred or sanctioned) then person end) as verified, round(sum(funds), 2) as funds, round(sum(contradiction), 2) as contradiction,
 sum(case when sanctioned then funds else 0 end) as tainted, bool_or(contains(upper(name), 'CITY OF') or mail like '%.mil') as public from ready group by 1),
a as (select roll.*, operator_id, op.* exclude (root), case when lead.barred and lead.source <> 'healthcare' then lead.name when paid.funds > 0 then paid.name else longest.name end as name, case when verified = 0 and barred_people + sanctioned_people > 0 and lead.source = 'healthcare' then least(lead.score, 15.0) else lead.score end as base from roll join ids using (root) join op using (root) join lead using (root) join longest using (root) left join paid using (root)),
b as (select *, least(100.0, base + bonus + case when contradiction = 0 then 0 else 30 end + case when barred_people >= 1 and tainted > 0 then 15 else 0 end + case when barred_people >= 2 then least(12, 4 * (barred_people - 1)) else 0 end) as s1 from a),
d as (select *, case when public and verified = 0 and contradiction = 0 then s1 * 0.5 else s1 end as s2 from b), x as (select *, case when members >= 20 and barred_people = 0 and contradiction = 0 then s2 * 0.4 else s2 end as s3 from d)"""


@query(
    f"""{TWIN} select operator_id, x.name, members, sources, barred_people, sanctioned_people, verified, x.funds, x.contradiction, cross_program, strongest_link, cast(bonus as double) as bonus, round_even(case when x.funds = 0 and verified = 0 and x.contradiction = 0 then least(s3, 45.0) else s3 end, 1) as score,
    row_number() over (partition by root order by r.barred desc, r.score desc, r.funds desc, uid desc) as place, uid, r.score as member_score, cast(r.funds as double) as member_funds from x join ready r using (root)"""
)
def resolved_operators(t):
    """The operators that surface, each beside its members in order."""
    found, members = resolve.resolved(families(t), today=DAY, **inputs(t))
    listed = members.select("operator_id", "place", "uid", F.col("score").alias("member_score"), F.col("funds").alias("member_funds"))
    return found.select("operator_id", "name", "members", "sources", "barred_people", "sanctioned_people", "verified", "funds", "contradiction", "cross_program", "strongest_link", "bonus", "score").join(listed, "operator_id")

"""Registered queries: the engine's operators over the provided tables, each with its DuckDB twin.

The tables stand in for registries: customers, suppliers and parts are entities, orders and line items are dated money.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import names as N
from registrum.functions import text as T
from registrum.operators import bars, graph, linkage, money, resolve, rules, scoring, serve
from registrum.operators import context_rules as context
from registrum.session import table
from registrum.sources import bulk, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TODAY = "2000-12-31"


def query(sql: str | None):
    """Registers a function of t, where t(name) is a provided table."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return ORACLES


# Adapters -------------------------------------------------------------------------------------------------------------------------


def yearly(t) -> DataFrame:
    return t("orders").groupBy(F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("amount"))


YEARLY = "yearly as (select o_custkey as uid, cast(year(o_orderdate) as integer) as period, round(sum(o_totalprice), 2) as amount from orders group by 1, 2)"


def shipped(t) -> DataFrame:
    return t("lineitem").select(F.col("l_suppkey").alias("uid"), F.col("l_returnflag").alias("program"), F.year("l_shipdate").alias("period"), (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("amount"))


SHIPPED = "shipped as (select l_suppkey as uid, l_returnflag as program, cast(year(l_shipdate) as integer) as period, cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as amount from lineitem)"
DOMINANT = f"""{SHIPPED}, per as (select uid, program, cast(round(sum(amount), 2) as double) as amount from shipped group by 1, 2),
dominant as (select uid, program, amount, round(sum(amount) over (partition by uid), 2) as total, row_number() over (partition by uid order by amount desc, program) as turn from per)"""


#: Texts that the predicates must read: names, addresses, statuses, cities and credentials as registries write them.
NAMES = [
    "Kessel Child Care LLC", "The Kessel Child Care", "KESSEL CHILD CARE, INC.", "Quillback Kids of Tacoma", "Marrow & Finch Kindergarten", "Finch and Marrow", "Mt Tolmie Otters", "Otters of St Brannoc", "Kids Academy Center", "XII Dolphins 3", "7 Brambles",
    "At Ermine Burrow", "Harbor Seal Limited", "P.L.L.C. of Health", "Elk", "Fernhollow on College Street, LLC", "Of Voles Inc", "Saint Mark Church", "Acme Rehabilitation University, Inc.", "", "Mellowcare 12", "YMCA of Yakima", "City of Kent", "The LLC", "Of The Sea - 02",
]
ADDRESSES = ["{} Main Street", "1 Main, PO Box {}", "POST OFFICE BOX 9", "PO Box {}", "MAILBOX 3, 5 Elm", "Suite 4 PMB 12", "Box 7 Rural Route", "The UPS Store 5", "Regus 9 Pine", "", "p. o. box 4", "Boxwood 3 Lane", "UPS Storefront 8"]
STATUSES = ["Active", "Closed", "Revoked", " suspended", "SURRENDER", "Voluntary Surrender", "Active with conditions", "Surrendered", "ACTIVE - PENDING", "Expired", "Summary Suspension"]


def pick(values: list, k) -> F.Column:
    """The value of the list in turn of k."""
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def sql_pick(values: list, k: str) -> str:
    shown = ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
    return f"[{shown}][cast(({k}) % {len(values)} + 1 as integer)]"


#: A name key in SQL.
def sql_key(name: str) -> str:
    words = "LLC|INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LLP|LP|PLLC|PS|PC|LTD|DBA|ENTERPRISE|ENTERPRISES"
    s = f"trim(regexp_replace(regexp_replace(replace(upper(coalesce({name}, '')), '.', ''), '[^A-Z0-9 ]', ' ', 'g'), '\\b({words})\\b', ' ', 'g'))"
    return f"trim(regexp_replace(case when starts_with({s}, 'THE ') then substr({s}, 5) else {s} end, ' +', ' ', 'g'))"


def people(t) -> DataFrame:
    """Customers as entities with statuses, addresses, dates and contacts made of their keys."""
    k = F.col("c_custkey")
    street = F.replace(pick(ADDRESSES, k), F.lit("{}"), k.cast("string"))
    rows = t("customer").select(
        k.alias("id"), F.col("c_name").alias("name"), pick(STATUSES, k).alias("state_of"), street.alias("street"),
        F.col("c_acctbal").cast("string").alias("money"), F.when(k % 4 == 0, "01/15/1999").otherwise("2005-06-30").alias("licenseexpirationdate"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("A@"), (k % 50).cast("string"))).alias("primarycontactemail"),
        F.when(k % 10 == 0, "1").otherwise(F.concat(F.lit("(206) 555-"), F.lpad((k % 1000).cast("string"), 4, "0"))).alias("primarycontactphonenumber"), F.when(k % 6 != 0, (k % 90).cast("string")).alias("licensecapacity"),
        F.when(k % 13 == 0, "Yes").when(k % 17 == 0, "Pending").otherwise("No").alias("actiontaken"), pick(["Proprietary", "non-profit", "For-Profit LLC", "Government", "profit"], k).alias("_ownership"), pick(["2", "Not Available", "4.5", "1"], k).alias("five_star"), pick(["", "1", "N/A"], k).alias("overall_rating"),
    )
    return readers.entities(rows, "customer", {"source_id": "id", "name": "name", "status": "state_of", "address": "street", "amount": "money"})


@query(
    f"""with {YEARLY}, listed as (select uid, list(amount order by period) as a, max(period) as period from yearly group by 1),
    sized as (select *, len(a) as n from listed where len(a) >= 2)
    select uid, period, a[n] as amount, a[n - 1] as prev, round(a[n] / a[n - 1], 4) as ratio from sized
    where a[n - 1] > 0 and a[n] / a[n - 1] >= 2 and a[n] >= 25000 and a[n] - a[n - 1] >= 10000 and not (n >= 4 and len(list_filter(range(1, n - 2), lambda i: a[i] < a[i + 1])) = 0)"""
)
def billing_spike(t):
    return money.spikes(yearly(t))


@query(
    f"""with e as (select 'customer:' || c_custkey as uid, {sql_pick(NAMES, "c_custkey")} as name from customer union all select 'supplier:' || s_suppkey, s_name from supplier union all select 'part:' || p_partkey, p_name from part)
    select uid, name, {sql_key("name")} as name_key from e"""
)
def entity_normalize(t):
    made = [readers.entities(t(n).select(F.col(f"{p}_{k}").alias("id"), (pick(NAMES, F.col("c_custkey")) if p == "c" else F.col(f"{p}_name")).alias("name")), n, {"source_id": "id", "name": "name"}) for n, p, k in (("customer", "c", "custkey"), ("supplier", "s", "suppkey"), ("part", "p", "partkey"))]
    return rules.union(*made).select("uid", "name", T.name_key(F.col("name")).alias("name_key"))


@query(f"with {SHIPPED} select uid, program, period, cast(round(sum(amount), 2) as double) as amount from shipped group by 1, 2, 3")
def payments_rollup(t):
    return money.rollup(shipped(t))


@query(f"with {DOMINANT} select uid, program, amount, total from dominant where turn = 1")
def dominant_program(t):
    return money.dominant_program(shipped(t))


@query(
    f"""with {DOMINANT}, d as (select * from dominant where turn = 1), ranked as (select program, total, row_number() over (partition by program order by total) - 1 as r, count(*) over (partition by program) as n from d),
    cut as (select program, total as at_rank from ranked where r = round_even(0.95 * (n - 1), 0)) select uid, program, total, at_rank from d join cut using (program) where total >= at_rank and total >= 100000"""
)
def payment_outlier(t):
    return money.outliers(money.dominant_program(shipped(t))).select("uid", "program", "total", "at_rank")


@query(
    f"""with {YEARLY}, s as (select *, lag(amount) over w as prev, lead(period) over w as next from yearly window w as (partition by uid order by period))
    select uid, period, amount, prev, round(amount / prev, 6) as ratio from s where next is null and prev > 10000 and amount >= 100000 and amount / prev >= 1.6 order by amount / prev desc, uid desc limit 12"""
)
def movers_top12(t):
    return money.movers(yearly(t)).withColumn("ratio", F.round("ratio", 6))


@query(f"with {YEARLY} select uid, array_to_string(list(period order by period), ',') as periods, round(sum(amount), 2) as total from yearly group by 1")
def spark_series(t):
    s = money.series(yearly(t))
    return s.select("uid", F.array_join(F.transform("periods", lambda y: y.cast("string")), ",").alias("periods"), F.round(F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(f"with {YEARLY} select uid, min(period) as first, max(period) as last, count(distinct period) as years from yearly group by 1 having max(period) - min(period) + 1 = count(distinct period) and count(distinct period) >= 3")
def contiguous_years(t):
    return money.contiguous(yearly(t))


@query("with m as (select event_type, avg(value) as mean, stddev_pop(value) as sigma, count(value) as n from events group by 1) select event_id as uid, event_type as kind, value from events join m using (event_type) where n >= 20 and value > mean + 3 * sigma")
def capacity_outlier(t):
    return rules.capacity_outliers(t("events").select(F.col("event_id").alias("uid"), F.col("event_type").alias("kind"), "value")).select("uid", "kind", "value")


@query(f"with c as (select quantile_cont(o_totalprice, 0.9) as cut from orders where o_totalprice > 0) select o_orderkey as uid, o_totalprice as value from orders, c where date_diff('day', cast(o_orderdate as date), date '{TODAY}') between 0 and 365 and o_totalprice >= cut")
def recent_high_capacity(t):
    rows = t("orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"))
    return rules.recent_large(rows, TODAY).select("uid", "value")


@query("select l_suppkey, l_quantity, l_discount, l_tax, count(distinct l_orderkey) as n from lineitem group by all having count(distinct l_orderkey) >= 2")
def duplicate_amount(t):
    return rules.duplicate_values(t("lineitem").withColumn("uid", F.col("l_orderkey")), ["l_suppkey", "l_quantity", "l_discount", "l_tax"])


@query("select p_partkey, p_retailprice from part where p_retailprice >= 100 and p_retailprice % 10 = 0")
def round_amount(t):
    rows = t("part").select("p_partkey", F.col("p_partkey").alias("uid"), F.col("p_retailprice").alias("amount"))
    return rules.round_amounts(rows, 100, 10).select("p_partkey", F.col("amount").alias("p_retailprice"))


PART_KEY = "p_brand || '|' || p_size || '|' || p_type"


@query(f"with r as (select p_partkey as uid, {PART_KEY} as key, p_name as brand from part), s as (select key, count(distinct uid) as members, count(distinct brand) as brands from r group by 1) select uid, key, members, brands from r join s using (key) where members between 2 and 8 and brands >= 2")
def shared_key_cluster(t):
    return rules.shared_key(t("part").select(F.col("p_partkey").alias("uid"), F.concat_ws("|", "p_brand", "p_size", "p_type").alias("key"), F.col("p_name").alias("brand")))


@query("with p as (select p_brand as cluster, split_part(p_name, ' ', 1) as root, count(*) as n from part group by 1, 2), r as (select *, sum(n) over (partition by cluster) as total, row_number() over (partition by cluster order by n desc, ascii(root), root desc) as turn from p) select cluster, root, n, cast(total as bigint) as total from r where turn = 1 and n / total >= 0.1")
def majority_root(t):
    return rules.majority_root(t("part").select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("name")), 0.1)


@query("with p as (select o_custkey as uid, o_orderpriority as code, round(sum(o_totalprice), 2) as amount from orders group by 1, 2), r as (select *, round(sum(amount) over (partition by uid), 2) as total0, row_number() over (partition by uid order by amount desc, code) as turn from p), w as (select o_custkey as uid, round(sum(o_totalprice), 2) as total from orders group by 1) select uid, code, amount, total, round(amount / total, 4) as share from r join w using (uid) where turn = 1 and round(amount / total, 4) >= 0.5 and total >= 50000")
def single_code_dominance(t):
    return money.dominance(t("orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("code"), F.col("o_totalprice").alias("amount")), 0.5)


@query("with p as (select l_suppkey as uid, l_partkey as code, round(sum(l_extendedprice), 2) as amount from lineitem group by 1, 2) select uid, code, amount, cast(row_number() over (partition by uid order by amount desc, code) as integer) as rank from p qualify rank <= 5")
def top5_codes(t):
    return money.top_codes(t("lineitem").select(F.col("l_suppkey").alias("uid"), F.col("l_partkey").alias("code"), F.col("l_extendedprice").alias("amount")))


@query("select o_custkey as uid, count(*) as n, count_if(o_orderpriority = '1-URGENT') as urgent, count_if(o_orderstatus = 'F' and o_totalprice >= 100000) as large_closed, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) as closed from orders group by 1")
def audit_counts(t):
    closed = F.col("o_orderstatus") == "F"
    counts = {"urgent": F.col("o_orderpriority") == "1-URGENT", "large_closed": closed & (F.col("o_totalprice") >= 100_000)}
    return money.conditional(t("orders").withColumn("uid", F.col("o_custkey")), "uid", counts, {"closed": (closed, "o_totalprice")})


@query("with d as (select distinct l_suppkey as uid, cast(l_shipdate as date) as date from lineitem), n as (select date, count(*) as n from d group by 1) select uid, cast(count_if(n < 4) as bigint) as own, cast(count_if(n >= 4) as bigint) as chain from d join n using (date) group by 1")
def chain_dates(t):
    return money.chain_dates(t("lineitem").select(F.col("l_suppkey").alias("uid"), F.col("l_shipdate").cast("date").alias("date")))


@query("select c_custkey as uid, c_acctbal as value, round_even(6 + 14 * cume_dist() over (order by c_acctbal), 0) as severity from customer where c_acctbal > 0")
def percentile_severity(t):
    return money.rank_severity(t("customer").select(F.col("c_custkey").alias("uid"), F.col("c_acctbal").alias("value")), "value").select("uid", "value", "severity")


@query("with b as (select c_custkey as uid, c_mktsegment as segment, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by 1, 2) select uid, segment, total, count(*) over (partition by segment) as peers, round((rank() over (partition by segment order by total) - 1) / count(*) over (partition by segment), 4) as percentile from b")
def peer_stats(t):
    rows = t("orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).join(t("customer").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("segment")), "uid")
    return serve.peers(rows, "segment", "total").select("uid", "segment", "total", "peers", "percentile")


REGISTRY = f"""r as (select {sql_key("name")} as name_key, bool_or(upper(trim(status)) in ('ACTIVE', 'OPEN')) as active from (select {sql_pick(NAMES[::2], "p_partkey")} as name, {sql_pick(["Active", "CLOSED", "open", "Dissolved"], "p_partkey % 12 // 3")} as status from part) where {sql_key("name")} <> '' group by 1)"""


def registry(t) -> DataFrame:
    """Registered businesses with their statuses; of a name any active one counts."""
    return linkage.registry_index(t("part").select(pick(NAMES[::2], F.col("p_partkey")).alias("name"), pick(["Active", "CLOSED", "open", "Dissolved"], F.floor(F.col("p_partkey") % 12 / 3)).alias("status")))


@query(f"with {REGISTRY} select c_custkey as uid, case when coalesce(a.active, false) or coalesce(b.active, false) then 'active' when coalesce(a.active, b.active) is not null then 'inactive' else 'none' end as found from (select c_custkey, {sql_key(sql_pick(NAMES, 'c_custkey'))} as key, {sql_key(sql_pick(NAMES, 'c_custkey + 3'))} as key2 from customer) c left join r a on a.name_key = c.key left join r b on b.name_key = c.key2")
def registry_best_match(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.alias("uid"), T.name_key(pick(NAMES, k)).alias("key"), T.name_key(pick(NAMES, k + 3)).alias("key2"))
    return linkage.active_match(rows, registry(t), ["key", "key2"]).select("uid", "found")


@query(
    f"""with l as (select case when c_custkey % 3 = 0 then c_custkey end as npi, case when c_custkey % 3 <> 2 then c_custkey * 7 end as lic, {sql_pick(NAMES, "c_custkey")} as name, c_nationkey as nation, c_custkey as ord from customer)
    select s_suppkey as uid, case when a.ord is not null then 'npi' when b.ord is not null then 'licence' when c.ord is not null then 'name' end as tier, coalesce(a.ord, b.ord, c.ord) as hit
    from supplier s left join l a on a.npi = s_suppkey left join l b on b.lic = s_suppkey left join (select name, nation, min(ord) as ord from l group by 1, 2) c on c.name = {sql_pick(NAMES, "s_suppkey")} and c.nation = s_nationkey"""
)
def cascading_match(t):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    listed = t("customer").select(F.when(k % 3 == 0, k).alias("npi"), F.when(k % 3 != 2, k * 7).alias("lic"), pick(NAMES, k).alias("name"), F.col("c_nationkey").alias("nation"), k.alias("ord"))
    left = t("supplier").select(s.alias("uid"), s.alias("npi"), s.alias("lic"), pick(NAMES, s).alias("name"), F.col("s_nationkey").alias("nation"))
    return linkage.cascade(left, listed, [("npi", ["npi"]), ("licence", ["lic"]), ("name", ["name", "nation"])], "ord").select("uid", "tier", F.col("hit.ord").alias("hit"))


@query("with u as (select p_name, p_brand, any_value(p_partkey) as owner from part group by 1, 2 having count(*) = 1) select p_partkey as uid, owner from part join u using (p_name, p_brand)")
def unique_only_join(t):
    key = ["p_name", "p_brand"]
    return linkage.unique_only(t("part").select(F.col("p_partkey").alias("uid"), *key), t("part").select(*key, F.col("p_partkey").alias("owner")), key).select("uid", "owner")


@query("select o_custkey as uid, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1")
def first_wins_join(t):
    return linkage.first_wins(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select(F.col("o_custkey").alias("uid"), "o_orderkey", "o_totalprice")


@query("select l_suppkey as uid, count(*) as n, round(sum(l_extendedprice), 2) as amount from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') group by 1")
def semi_scan(t):
    tracked = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return money.tracked_sums(t("lineitem").withColumn("uid", F.col("l_suppkey")), tracked, "l_orderkey", "uid", "l_extendedprice")


@query("select c_custkey as uid from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def anti_resume(t):
    return bulk.still_to_fetch(t("customer").select(F.col("c_custkey").alias("uid")), t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("uid")))


@query("select c_custkey as uid, o_orderstatus as program, cast(year(o_orderdate) as integer) as year, round(sum(o_totalprice), 2) as amount from orders join customer on o_custkey = c_custkey where c_acctbal < 0 and year(o_orderdate) > 1995 + c_custkey % 6 and o_orderstatus <> 'P' group by 1, 2, 3")
def paid_after_bar(t):
    facts = t("orders").groupBy(F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("program"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("amount"))
    barred = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("uid"), (1995 + F.col("c_custkey") % 6).alias("bar_year"))
    return linkage.after(facts, barred, F.col("program") != "P").select("uid", "program", "year", "amount")


@query("select o_orderkey as uid, o_custkey as key from orders join customer on o_custkey = c_custkey where c_acctbal < 0 and strftime(o_orderdate, '%Y-%m-%d') <= coalesce(case when c_custkey % 3 > 0 then (1997 + c_custkey % 4) || '-06-30' end, '9999-12-31') and strftime(o_orderdate + interval 30 day, '%Y-%m-%d') >= (1996 + c_custkey % 4) || '-01-01'")
def interval_overlap(t):
    k = F.col("c_custkey")
    left = t("orders").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("end"))
    right = t("customer").where("c_acctbal < 0").select(k.alias("key"), F.concat((1996 + k % 4).cast("string"), F.lit("-01-01")).alias("start"), F.when(k % 3 > 0, F.concat((1997 + k % 4).cast("string"), F.lit("-06-30"))).alias("end"))
    return linkage.overlapping(left, right, "key").select("uid", "key")


@query("select o_custkey as uid, round(sum(o_totalprice), 2) as amount, count(*) as n from orders join customer on o_custkey = c_custkey where c_acctbal < 0 and year(o_orderdate) > 1995 + c_custkey % 6 group by 1")
def paid_after_deactivation(t):
    facts = t("orders").select(F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("amount"))
    off = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("uid"), (1995 + F.col("c_custkey") % 6).alias("bar_year"))
    return linkage.after(facts, off).groupBy("uid").agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n"))


ENDINGS = [" Light Services LLC", " Lights Services", " Lite Services, Inc.", " Counsel", " Services Light"]


def organizations(t) -> DataFrame:
    """Customers with names of which a few in a row are nearly alike."""
    k = F.col("c_custkey")
    number = F.lpad(F.floor(k / 5).cast("string"), 6, "0")
    return t("customer").select(k.alias("uid"), F.concat(F.lit("Harbor"), number, pick(ENDINGS, k)).alias("name"))


ORGANIZATIONS = f"o as (select c_custkey as uid, 'Harbor' || lpad(cast(c_custkey // 5 as varchar), 6, '0') || {sql_pick(ENDINGS, 'c_custkey')} as name from customer)"


@query(
    f"""with {ORGANIZATIONS}, r as (select uid, {sql_key("name")} as key from o), w as (select uid, key, unnest(list_distinct(list_filter(string_split(key, ' '), lambda x: length(x) >= 5))) as word from r), s as (select word from w group by 1 having count(*) between 2 and 40)
    select distinct a.uid, b.uid as uid2, cast(levenshtein(a.key, b.key) as integer) as edits from w a join s using (word) join w b using (word) where a.uid < b.uid and a.key <> b.key and levenshtein(a.key, b.key) <= 8"""
)
def fuzzy_block_pairs(t):
    pairs = linkage.name_pairs(organizations(t), F.expr("abs(n - n2) <= 8"))
    return pairs.withColumn("edits", F.levenshtein("text", "text2", 8)).where("edits >= 0").select("uid", "uid2", "edits")


@query(None)
def fuzzy_ratio(t):
    return linkage.near_names(organizations(t)).select("uid", "uid2", F.round("ratio", 6).alias("ratio"))


PLACES = "p as (select vec_id as uid, 47 + round(cast(embedding[1] as double), 2) / 100 as lat, -122 + round(cast(embedding[2] as double), 2) / 100 as lon from embeddings)"


@query(
    f"""with {PLACES}, c as (select *, trunc(lat / (50 / 111320.0)) as x, trunc(lon / (50 / (111320.0 * cos(radians(47.5))))) as y from p where lat between 45 and 49.5 and lon between -125 and -116), n as (select x, y, count(*) as n from c group by 1, 2),
    a as (select c.x, c.y, sum(n.n) as around from (select distinct x, y from c) c join n on abs(n.x - c.x) <= 1 and abs(n.y - c.y) <= 1 group by 1, 2),
    e as (select c.*, around from c join a on a.x = c.x and a.y = c.y), m as (
    select s.uid as a, t.uid as b, 2 * 6371000.0 * asin(sqrt(sin(radians(t.lat - s.lat) / 2) ** 2 + cos(radians(s.lat)) * cos(radians(t.lat)) * sin(radians(t.lon - s.lon) / 2) ** 2)) as metres
    from e s join e t on abs(s.x - t.x) <= 1 and abs(s.y - t.y) <= 1 and s.uid < t.uid where s.around <= 15 or t.around <= 15) select a, b, round(metres, 3) as metres from m where metres <= 50"""
)
def geo_pairs(t):
    place = t("embeddings").select(F.col("vec_id").alias("uid"), (47 + F.round(F.col("embedding")[0].cast("double"), 2) / 100).alias("lat"), (-122 + F.round(F.col("embedding")[1].cast("double"), 2) / 100).alias("lon"))
    return graph.geo_pairs(place).select("a", "b", F.round("metres", 3).alias("metres"))


KEYS = "keys as (select p_partkey as uid, 'a' || p_brand || p_size || p_type as key from part union all select p_partkey, 'b' || cast(p_retailprice as bigint) || p_size from part), sized as (select key, min(uid) as b from keys group by 1 having count(distinct uid) between 2 and 8), edges as (select distinct uid as a, b from keys join sized using (key))"
ROOTS = f"with recursive {KEYS}, both_ as (select a, b from edges union select b, a from edges), walk as (select a as node, b as seen from both_ union select w.node, e.b from walk w join both_ e on w.seen = e.a), roots as (select node, min(seen) as root from walk group by 1)"


def _roots(t):
    p = t("part")
    keys = p.select(F.col("p_partkey").alias("uid"), F.concat(F.lit("a"), "p_brand", "p_size", "p_type").alias("key")).unionByName(p.select(F.col("p_partkey").alias("uid"), F.concat(F.lit("b"), F.bround("p_retailprice", 0).cast("long").cast("string"), F.col("p_size").cast("string")).alias("key")))
    return graph.components(graph.key_edges(keys, 2, 8))


@query(f"{ROOTS} select node, root from roots")
def connected_components(t):
    return _roots(t)


@query(
    f"""{ROOTS}, m as (select root, 'part:' || node as uid, case when node % 3 = 0 then 'healthcare' else p_brand end as source, p_name as person, cast(p_size as double) as score, case when node % 5 = 0 then 0 else p_retailprice end as funds, p_size > 40 as barred, p_size > 30 and node % 2 = 0 as sanctioned, case when p_size > 45 then p_retailprice else 0 end as contradiction from roots join part on node = p_partkey),
    r as (select root, 'op:' || left(md5(string_agg(uid, '|' order by uid)), 12) as operator_id, count(*) as members, count(distinct source) as sources, count(distinct case when barred then person end) as barred_people, count(distinct case when sanctioned then person end) as sanctioned_people, count(distinct case when (barred or sanctioned) and source <> 'healthcare' then person end) as verified,
      round(sum(funds), 2) as funds, round(sum(contradiction), 2) as contradiction, coalesce(sum(funds) filter (sanctioned), 0) as sanctioned_funds from m group by 1),
    top as (select root, source, score from m qualify row_number() over (partition by root order by barred desc, score desc, funds desc, uid desc) = 1),
    s as (select r.*, least(100.0, case when verified = 0 and barred_people + sanctioned_people > 0 and source = 'healthcare' then least(score, 15) else score end + case when contradiction > 0 then 30 else 0 end + case when barred_people >= 1 and sanctioned_funds > 0 then 15 else 0 end + case when barred_people >= 2 then least(12, 4 * (barred_people - 1)) else 0 end) as raw from r join top using (root))
    select operator_id, members, sources, barred_people, verified, funds, contradiction, round_even(cast(case when funds = 0 and verified = 0 and contradiction = 0 then least(kept, 45) else kept end as double), 1) as score from (select *, case when members >= 20 and barred_people = 0 and contradiction = 0 then raw * 0.4 else raw end as kept from s)"""
)
def operator_rollup(t):
    p = t("part")
    node = F.col("node")
    members = _roots(t).join(p, node == F.col("p_partkey")).select(
        "root", F.concat(F.lit("part:"), "node").alias("uid"), F.when(node % 3 == 0, "healthcare").otherwise(F.col("p_brand")).alias("source"), F.col("p_name").alias("name"), F.col("p_name").alias("person"), F.col("p_size").cast("double").alias("score"),
        F.when(node % 5 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("funds"), (F.col("p_size") > 40).alias("barred"), ((F.col("p_size") > 30) & (node % 2 == 0)).alias("sanctioned"), F.when(F.col("p_size") > 45, F.col("p_retailprice")).otherwise(0.0).alias("contradiction"),
    )
    return resolve.scored(resolve.rollup(members)).select("operator_id", "members", "sources", "barred_people", "verified", "funds", "contradiction", "score")


@query(
    """with k as (select s_suppkey // 4 as root, s_suppkey as uid, ['ubi', 'agent', 'gov', 'owner'][s_nationkey % 4 + 1] as kind, s_nationkey % 3 as key, s_suppkey % 3 as brand from supplier),
    f as (select distinct root, kind from (select root, kind, key from k group by 1, 2, 3 having count(distinct uid) >= 2 and (kind not in ('agent', 'gov') or count(distinct brand) >= 2)))
    select root, cast(sum(case kind when 'agent' then 14 when 'gov' then 12 else 16 end) as bigint) as bonus from f group by 1"""
)
def identity_bonus(t):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    kind = F.element_at(F.array(*map(F.lit, ["ubi", "agent", "gov", "owner"])), (n % 4 + 1).cast("int"))
    return resolve.identity_bonus(t("supplier").select(F.floor(k / 4).alias("root"), k.alias("uid"), kind.alias("kind"), (n % 3).alias("key"), (k % 3).alias("brand")))


@query(
    f"""with w as (select upper(unnest(regexp_extract_all(lower(text), '[a-z]+'))) as word from documents), c as (select word, count(*) as n from w group by 1), seeds as (select unnest({list(rules.SEEDS)!r}) as word), anchors as (select unnest({list(rules.ANCHORS)!r}) as likely),
    usual as (select coalesce(c.word, s.word) as likely, coalesce(n, 0) as n from c full join seeds s on s.word = c.word where (n >= 25 and length(c.word) >= 4) or s.word is not null),
    odd as (select word from c where length(word) >= 5 and n <= 3 and word not in (select word from seeds)),
    cuts as (select word, unnest(list_distinct(list_append(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)), word))) as cut from odd),
    cuts2 as (select likely, n, unnest(list_distinct(list_append(list_transform(range(1, length(likely) + 1), lambda i: left(likely, i - 1) || substr(likely, i + 1)), likely))) as cut from usual where length(likely) >= 5),
    pairs as (select distinct word, likely, n from cuts join cuts2 using (cut) where damerau_levenshtein(word, likely) = 1 and word not in (likely || 'S', likely || 'ES') and likely not in (word || 'S', word || 'ES')),
    far as (select odd.word, likely, coalesce(c.n, 0) as n from odd, anchors left join c on c.word = likely where length(odd.word) >= 8 and odd.word not in (select p.word from pairs p) and levenshtein(odd.word, likely) <= 2 and odd.word not in (likely || 'S', likely || 'ES') and likely not in (odd.word || 'S', odd.word || 'ES')),
    found as (select word, likely, n from pairs union all select * from far)
    select word, likely, n as frequency from found qualify row_number() over (partition by word order by n desc, likely) = 1"""
)
def misspelled_words(t):
    return rules.misspelled(t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")))


@query("with n as (select distinct p_name as subset from part) select p_partkey as uid, subset from part join n on len(list_filter(string_split(subset, ' '), lambda x: not list_contains(string_split(part.p_name, ' '), x))) = 0")
def token_subset(t):
    return linkage.supersets(t("part").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("name")), t("part").select(F.col("p_name").alias("subset")).distinct())


@query("select doc_id as uid, item_id from documents, benchmark where contains(documents.text, benchmark.text) and benchmark.text <> ''")
def containment(t):
    return linkage.containing(t("documents").select(F.col("doc_id").alias("uid"), "text"), t("benchmark").select("item_id", F.col("text").alias("needle")))


@query("select page_id as uid, length(trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&nbsp;', ' '), '[\\s]+', ' ', 'g'))) as n, md5(trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&nbsp;', ' '), '[\\s]+', ' ', 'g'))) as digest from pages")
def html_strip(t):
    plain = T.plain_html(F.col("html"))
    return t("pages").select(F.col("page_id").alias("uid"), F.length(plain).cast("long").alias("n"), F.md5(plain).alias("digest"))


@query("select doc_id as uid, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z]')) as email from documents")
def entry_extract(t):
    return readers.extracted(t("documents").select(F.col("doc_id").alias("uid"), "text"), "text", "[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z]", "email")


@query("select event_type as kind, count(*) as n, sum(cast(json_extract(props, '$.k') as bigint)) as total from events group by 1")
def json_story(t):
    return serve.story_totals(t("events"), "event_type", "props", "$.k")


# Rules and scores over the customer entities ---------------------------------------------------------------------------------------

ENTITIES = f"""d as (select c_custkey as k, upper(trim({sql_pick(STATUSES, "c_custkey")})) as status, upper(trim(replace({sql_pick(ADDRESSES, "c_custkey")}, '{{}}', cast(c_custkey as varchar)))) as address, upper({sql_pick(["Proprietary", "non-profit", "For-Profit LLC", "Government", "profit"], "c_custkey")}) as owned,
  coalesce(try_cast({sql_pick(["2", "Not Available", "4.5", "1"], "c_custkey")} as double), try_cast({sql_pick(["", "1", "N/A"], "c_custkey")} as double)) as stars, c_acctbal as amount from customer),
 e as (select 'customer:' || k as uid, k, starts_with(status, 'ACTIVE') as active, amount, address, owned, stars, k % 4 = 0 as expired, k % 5 = 0 as no_mail, k % 10 = 0 as no_phone, case when k % 6 <> 0 then k % 90 else 0 end as capacity, status as credential, k % 13 = 0 as acted, k % 13 <> 0 and k % 17 = 0 as pending,
  case when regexp_matches(address, '\\b(PMB|UPS STORE|MAIL ?BOXES ?ETC|POSTAL ANNEX|PAK ?MAIL|PACKAGING|PARCEL|GOIN ?POSTAL|POSTNET|MAILBOX)\\b') then 'commercial_mailbox' when regexp_matches(address, '\\b(REGUS|WEWORK|INTELLIGENT OFFICE|DAVINCI|OPUS VIRTUAL)\\b') then 'virtual_office' when regexp_matches(address, '^\\s*(P\\.?\\s*O\\.?\\s*BOX|POST OFFICE BOX|BOX\\s+\\d)') then 'po_box_address' end as boxed from d),
flags as (select uid, k, unnest([case when active and expired then {{'r': 'license_expired_active', 's': 30.0}} end, case when active and capacity = 0 then {{'r': 'capacity_missing_or_zero', 's': 10.0}} end, case when active then {{'r': 'ungeocoded_address', 's': case when address = '' then 10.0 else 5.0 end}} end, case when active and no_mail and no_phone then {{'r': 'missing_contact_info', 's': 8.0}} end,
 case when boxed is not null then {{'r': boxed, 's': case when boxed = 'po_box_address' then 8.0 else 12.0 end}} end, case when owned in ('FOR-PROFIT', 'PROFIT', 'PROPRIETARY', 'FOR PROFIT') or contains(owned, 'FOR-PROFIT') or contains(owned, 'PROPRIETARY') then {{'r': 'for_profit_ownership', 's': 5.0}} end, case when stars <= 2 then {{'r': 'low_quality_rating', 's': 8.0}} end, case when credential in ('REVOKED', 'SUSPENDED') then {{'r': 'credential_revoked_or_suspended', 's': 30.0}} end, case when credential in ('SURRENDER', 'VOLUNTARY SURRENDER') then {{'r': 'credential_surrendered', 's': 16.0}} end,
 case when credential = 'ACTIVE WITH CONDITIONS' then {{'r': 'credential_active_with_conditions', 's': 18.0}} end, case when acted then {{'r': 'disciplinary_action_taken', 's': 22.0}} end, case when pending then {{'r': 'disciplinary_action_pending', 's': 12.0}} end]) as f from e),
hits as (select uid as entity_uid, k, f.r as rule_id, cast(f.s as double) as severity, case when f.r in ('credential_revoked_or_suspended', 'credential_surrendered', 'credential_active_with_conditions', 'disciplinary_action_taken', 'disciplinary_action_pending') then 'doh_sanction' when f.r = 'capacity_missing_or_zero' then 'capacity' else f.r end as grp,
 case when f.r in ('capacity_missing_or_zero', 'ungeocoded_address', 'missing_contact_info', 'for_profit_ownership', 'low_quality_rating') then 'quality' when f.r in ('commercial_mailbox', 'virtual_office', 'po_box_address') then 'network' else 'integrity' end as family from flags where f is not null),
parts as (select entity_uid, k, grp, severity, rule_id from hits qualify row_number() over (partition by entity_uid, grp order by severity desc, rule_id) = 1),
scores as (select entity_uid, p.k, risk_score, flag_count, family_count, top_rule from (select entity_uid, k, round_even(least(sum(severity), 100.0), 1) as risk_score from parts group by 1, 2) p join (select entity_uid, count(*) as flag_count, count(distinct family) as family_count from hits group by 1) h using (entity_uid) join (select entity_uid, rule_id as top_rule from parts qualify row_number() over (partition by entity_uid order by severity desc, rule_id) = 1) t using (entity_uid))"""


def _flags(t):
    return rules.simple_flags(people(t), TODAY)


@query(f"with {ENTITIES} select entity_uid, rule_id, severity from hits")
def rule_flags(t):
    return _flags(t).select("entity_uid", "rule_id", "severity")


@query(f"with {ENTITIES} select entity_uid, grp, severity, rule_id from parts")
def score_parts(t):
    return scoring.parts(_flags(t))


@query(f"with {ENTITIES} select entity_uid, risk_score, flag_count, family_count, top_rule from scores")
def risk_score(t):
    return scoring.scores(_flags(t))


def _institutions(name: str) -> str:
    """Whether a name is an institution's, in SQL."""
    pattern = "|".join(N.INSTITUTIONS).replace("'", "''")
    n = f"upper(coalesce({name}, ''))"
    return f"case when regexp_matches({n}, '{N.SCHOOLS}') and regexp_matches({n}, '{N.COMPANIES}') then regexp_matches(regexp_replace({n}, '{N.SCHOOLS}', ' ', 'g'), '{pattern}') else regexp_matches({n}, '{pattern}') end"


@query(f"with {ENTITIES} select entity_uid, case when {_institutions(sql_pick(NAMES, 'k'))} then round_even(risk_score * 0.5, 1) else risk_score end as risk_score from scores")
def institution_suppression(t):
    k = F.col("c_custkey")
    named = t("customer").select(F.concat(F.lit("customer:"), k.cast("string")).alias("entity_uid"), pick(NAMES, k).alias("name"))
    return scoring.suppressed(scoring.scores(_flags(t)), named.where(N.institution(F.col("name")))).select("entity_uid", "risk_score")


@query(f"with {ENTITIES} select case when risk_score < 20 then '0-19' when risk_score < 40 then '20-39' when risk_score < 60 then '40-59' when risk_score < 80 then '60-79' else '80-100' end as band, count(*) as n from scores group by 1")
def score_buckets(t):
    return scoring.buckets(scoring.scores(_flags(t)))


@query(f"with {ENTITIES} select upper(trim(n_name)) as place, count(*) as n, round(sum(c_acctbal), 2) as funds, cast(count_if(risk_score >= 40) as bigint) as high from scores join customer on k = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def nation_density(t):
    at = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity_uid"), F.col("n_name").alias("place"), F.col("c_acctbal").alias("funds"))
    return serve.density(scoring.scores(_flags(t)).join(at, "entity_uid").withColumnRenamed("risk_score", "score"), "place")


@query(f"with {ENTITIES} select uid, name, risk_score, flag_count, coalesce(state, 'new') as state from (select entity_uid as uid, 'Customer' as x, c_name as name, risk_score, flag_count, family_count, case when k % 8 = 0 then 'reviewed' end as state from scores join customer on k = c_custkey) where risk_score >= 30 and name ilike '%1%' and uid in (select entity_uid from hits where rule_id = 'license_expired_active') order by risk_score desc, family_count desc, flag_count desc, uid limit 1000")
def review_queue(t):
    e, f = people(t), _flags(t)
    triage = t("customer").where("c_custkey % 8 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("uid"), F.lit("reviewed").alias("state"))
    rows = serve.review_queue(e.drop("state"), scoring.scores(f), triage, serve.predicates(least=30, text="1"), f.where("rule_id = 'license_expired_active'"))
    return rows.where(F.col("name").ilike("%1%")).select("uid", "name", "risk_score", "flag_count", "state")


@query(f"with {ENTITIES}, r as (select entity_uid, severity, grp, row_number() over (partition by entity_uid order by severity desc, grp) as n from parts) select entity_uid, count(*) as titles, max(severity) as top from r where n <= 6 group by 1")
def top_titles(t):
    return serve.top_titles(_flags(t)).groupBy("entity_uid").agg(F.count("*").alias("titles"), F.max("severity").alias("top"))


@query("""select c_custkey as uid, case when pre and not t1 then 'D' when bad and (t1 or (t2 and funds > 0 and not (pre and not t1))) then 'C' when t1 and good and ((amt >= 1000 and not run) or amt >= 100000) and (ly >= 2022 or amt >= 100000) then 'A' when t1 then 'B' when t2 and funds > 0 and not (pre and not t1) and good then 'B' when (t2 and funds > 0 and not (pre and not t1)) or (strong and funds > 0) then 'C' else 'D' end as grade
 from (select c_custkey, c_custkey % 2 = 0 as t1, c_custkey % 5 = 0 as pre, c_custkey % 3 = 0 as t2, c_custkey % 7 = 0 as strong, c_acctbal as funds, c_custkey % 11 in (1, 2) as good, c_custkey % 11 in (3, 4, 5, 6) as bad, c_acctbal * 20 as amt, c_custkey % 13 = 0 as run, 2018 + c_custkey % 8 as ly from customer)""")
def grade(t):
    k, money_ = F.col("c_custkey"), F.col("c_acctbal")
    identity = pick(["name-only", "license-confirmed", "dob-confirmed", "license-mismatch", "dob-mismatch", "city-mismatch", "taxonomy-mismatch", "exclusion-npi", "city-match", "", "name-only-mismatch"], k)
    return t("customer").select(k.alias("uid"), scoring.grade(k % 2 == 0, k % 5 == 0, k % 3 == 0, k % 7 == 0, money_, identity, money_ * 20, k % 13 == 0, 2018 + k % 8).alias("grade"))


@query("""with f as (select o_custkey as uid, round(sum(o_totalprice), 2) as total, max(case when o_orderstatus = 'F' then 2 when o_orderpriority = '1-URGENT' then 1 else 0 end) as tier from orders group by 1)
 select case tier when 2 then 'closed' when 1 then 'urgent' else 'other' end as tier, count(*) as n, round(sum(total), 2) as funds from f group by 1""")
def funds_tiers(t):
    tiers = [("closed", F.col("o_orderstatus") == "F"), ("urgent", F.col("o_orderpriority") == "1-URGENT")]
    return money.tiered(t("orders"), "o_custkey", "o_totalprice", tiers, "other")


SNAPSHOTS = "snap as (select o_custkey as uid, year(o_orderdate) as y, cast(count(*) * 15 as double) as score, round(sum(o_totalprice), 2) as funds, max(o_orderstatus) as status from orders group by 1, 2)"


@query(
    f"""with {SNAPSHOTS}, c as (select n.uid, n.score, o.score as score0, n.funds, o.funds as funds0, n.status, o.status as status0, n.uid % 4 = 0 as watched from snap n left join (select * from snap where y = 1999) o using (uid) where n.y = 2000)
    select uid, 'new' as kind, score, score0, funds, funds0, status, status0, watched from c where score0 is null and score >= 40 union all select uid, 'risk', score, score0, funds, funds0, status, status0, watched from c where score - score0 >= 10
    union all select uid, 'funds', score, score0, funds, funds0, status, status0, watched from c where funds - funds0 > 25000 union all select uid, 'status', score, score0, funds, funds0, status, status0, watched from c where status <> status0"""
)
def change_feed(t):
    snap = t("orders").groupBy(F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("y")).agg((F.count("*") * 15).cast("double").alias("score"), F.round(F.sum("o_totalprice"), 2).alias("funds"), F.max("o_orderstatus").alias("status"))
    triage = t("customer").select(F.col("c_custkey").alias("uid"), (F.col("c_custkey") % 4 == 0).alias("watched"))
    return serve.changes(snap.where("y = 2000").drop("y"), snap.where("y = 1999").drop("y"), triage=triage)


@query("select o_orderstatus as status, min(year(o_orderdate)) || '–' || max(year(o_orderdate)) as range, count(distinct year(o_orderdate)) as years from orders group by 1")
def period_range(t):
    return money.year_span(t("orders").withColumn("status", F.col("o_orderstatus")), "status", F.year("o_orderdate"))


@query("select c_custkey as uid, c_name as name, c_acctbal as score from customer where c_name ilike '%00012%' order by c_acctbal desc, c_custkey limit 10")
def search(t):
    return serve.search(t("customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score")), "00012")


@query("with o as (select o_orderkey as uid, o_orderstatus as status, o_totalprice as amount from orders where o_orderkey % 3 > 0), n as (select o_orderkey as uid, case when o_orderkey % 2 = 0 then 'Z' end as status, case when o_orderkey % 5 = 0 then 0.0 end as amount from orders where o_orderkey % 3 < 2) select coalesce(n.uid, o.uid) as uid, coalesce(n.status, o.status, 'new') as status, coalesce(n.amount, o.amount) as amount from o full join n on o.uid = n.uid")
def upsert_merge(t):
    k = F.col("o_orderkey")
    old = t("orders").where(k % 3 > 0).select(k.alias("uid"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    new = t("orders").where(k % 3 < 2).select(k.alias("uid"), F.when(k % 2 == 0, "Z").alias("status"), F.when(k % 5 == 0, 0.0).alias("amount"))
    return linkage.merge(old, new, "uid", {"status": "new"})


@query("select o_custkey as uid, round(sum(case when year(o_orderdate) > 1996 + o_custkey % 4 and year(o_orderdate) <= 2002 + o_custkey % 4 then o_totalprice else 0 end), 2) as after_amount from orders where o_custkey % 9 in (0, 1) group by 1")
def bar_after_amounts(t):
    facts = t("orders").groupBy(F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("program"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("amount"))
    k = F.col("c_custkey")
    barred = t("customer").where(k % 9 < 2).select(k.alias("uid"), F.when(k % 9 == 0, "REVOKED").otherwise("SUSPENDED").alias("status"), F.lit("license-confirmed").alias("identity"), (1996 + k % 4).cast("int").alias("expiry_year"), F.lit(None).cast("int").alias("reissue_year"))
    none = barred.where("false").select("uid", F.lit("").alias("list"), F.col("expiry_year").alias("bar_year"), F.lit("").alias("scope"))
    return bars.dispositions(barred, facts, none, 2001, first=1990).select("uid", "after_amount")


@query(
    """with p as (select c_custkey as uid, c_custkey as k, ['REVOKED', 'SUSPENDED', 'EXPIRED', 'TERMINATED', 'ACTIVE'][c_custkey % 5 + 1] as status, case when c_custkey % 4 = 0 then 'license-confirmed' when c_custkey % 11 = 0 then 'license-mismatch' else 'name-only' end as identity, 1994 + c_custkey % 6 as expiry, case when c_custkey % 13 = 0 then 2000 else 0 end as reissue from customer),
    e as (select *, case when status in ('REVOKED', 'SUSPENDED', 'TERMINATED') and reissue <= expiry then expiry end as proxy, case when k % 3 = 0 then 1995 + k % 8 end as formal, case when k % 2 = 0 then 'MEDICAID' else '' end as scope from p where status <> 'ACTIVE'),
    f as (select o_custkey as uid, case o_orderstatus when 'F' then 'Medicare Part D' when 'O' then 'Medicaid' else 'WA state grants' end as program, year(o_orderdate) as year, floor(cast(sum(cast(o_totalprice as decimal(14, 2))) as double) / power(10, o_custkey % 4)) as amount from orders group by 1, 2, 3, o_custkey),
    d as (select f.*, identity, case when formal is not null and contains(upper(program), scope) then formal else proxy end as bar from f join e using (uid)),
    g as (select uid, program, identity, bar, sum(amount) as total, max(year) as last, coalesce(sum(amount) filter (year = bar), 0) as same, min(year) filter (year > bar) as lf, max(year) filter (year > bar) as lt, count(*) filter (year > bar) as ln, coalesce(sum(amount) filter (year > bar), 0) as ls, max(year) filter (year > bar and year <= bar + 2) as nt, coalesce(sum(amount) filter (year > bar and year <= bar + 2), 0) as ns from d group by 1, 2, 3, 4),
    h as (select *, coalesce(identity = 'license-confirmed' and lt - lf + 1 = ln and lf - bar <= 2, false) as whole, contains(program, 'Part D') as refills from g),
    a as (select *, case when whole then ls else ns end as after, case when whole then lt else nt end as aft from h),
    rb as (select uid, max(bar) as rbar from a where refills and aft is not null group by 1),
    pr as (select uid, sum(amount) as prior from a join rb using (uid) join f using (uid, program) where refills and aft is not null and year between rbar - 1 and rbar group by 1),
    u as (select uid, sum(total) as total, max(last) as last, sum(after) as after, max(aft) as aft, sum(same) as same, sum(ls - after) as dropped, bool_and(refills) filter (aft is not null) as only_refills, bool_and(starts_with(program, 'WA state')) as named from a group by 1),
    v as (select *, coalesce(formal, proxy) as any_bar, identity = 'license-mismatch' or named as doubtful, aft is not null and after < greatest(1000, 0.02 * total) and after <= 0.5 * total as trivial from u join e using (uid) left join rb using (uid) left join pr using (uid)),
    w as (select *, aft is not null and not trivial and not doubtful as counted, case when after < 1000 then 22 when after < 25000 then 35 when after < 100000 then 45 else 50 end as dollars from v),
    x as (select *, counted and coalesce(only_refills and aft <= rbar + 1 and prior > 0 and after < 0.35 * prior, false) as runoff, not counted and not doubtful and coalesce(last < any_bar or (2001 > any_bar and (last = any_bar or trivial)), false) as ceased, coalesce(any_bar > 2001, false) as unseen, coalesce(last > any_bar, false) as beyond from w),
    y as (select *, case when runoff then least(dollars, 20) else dollars end as hard, case when total < 1000 then least(soft, 15) when total < 25000 then least(soft, 28) else soft end as mild from (select *, case when unseen then 14 when beyond then 18 else 35 end as soft from x))
    select uid, case when doubtful then 'paid_attribution_unconfirmed' when counted then 'paid_after_barred' when ceased then 'paid_before_bar' else 'paid_while_sanctioned' end as rule_id,
    cast(case when doubtful then 8 when counted then case when after >= 100000 or 2001 - aft < 5 then hard when 2001 - aft >= 8 then greatest(8, round_even(hard * 0.3, 0)) else greatest(10, round_even(hard * 0.6, 0)) end when ceased then 10
      else case when 2001 - last >= 8 then greatest(8, round_even(mild * 0.3, 0)) when 2001 - last >= 5 then greatest(10, round_even(mild * 0.6, 0)) else mild end end as double) as severity,
    round(after, 2) as after_amount, runoff, round(same, 2) as same_amount, round(dropped, 2) as dropped, not counted and not doubtful and not ceased and beyond and not unseen as out_of_scope from y"""
)
def dated_bar_tree(t):
    k = F.col("c_custkey")
    people_ = t("customer").select(
        k.alias("uid"), F.element_at(F.array(*map(F.lit, ["Revoked", "SUSPENDED", "Expired", "TERMINATED", "ACTIVE"])), (k % 5 + 1).cast("int")).alias("status"), F.when(k % 4 == 0, "license-confirmed").when(k % 11 == 0, "license-mismatch").otherwise("name-only").alias("identity"),
        (1994 + k % 6).cast("int").alias("expiry_year"), F.when(k % 13 == 0, 2000).alias("reissue_year"),
    )
    program = F.when(F.col("o_orderstatus") == "F", "Medicare Part D").when(F.col("o_orderstatus") == "O", "Medicaid").otherwise("WA state grants")
    facts = t("orders").groupBy(F.col("o_custkey").alias("uid"), program.alias("program"), F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("sum"))
    facts = facts.select("uid", "program", "year", F.floor(F.col("sum") / F.pow(F.lit(10), F.col("uid") % 4)).cast("double").alias("amount"))
    listed = t("customer").where(k % 3 == 0).select(k.alias("uid"), F.lit("list").alias("list"), (1995 + k % 8).cast("int").alias("bar_year"), F.when(k % 2 == 0, "Medicaid").otherwise("").alias("scope"))
    return bars.dispositions(people_, facts, listed, 2001, recent=2, first=1990).select("uid", "rule_id", "severity", "after_amount", "runoff", "same_amount", "dropped", "out_of_scope")


# Rules with side tables -----------------------------------------------------------------------------------------------------------


@query("select l_suppkey as uid, 'ownership_churn' as rule_id, case when count_if(n < 4) >= 2 then 14.0::double else 6.0::double end as severity from (select distinct l_suppkey, cast(l_shipdate as date) as d from lineitem) join (select d, count(*) as n from (select distinct l_suppkey, cast(l_shipdate as date) as d from lineitem) group by 1) using (d) group by 1")
def ownership_churn(t):
    return context.ownership_churn(t("lineitem").select(F.col("l_suppkey").alias("uid"), F.col("l_shipdate").cast("date").alias("date")))


@query("with o as (select p_partkey as uid, p_brand || p_size as owner, p_name as org from part), b as (select owner from o group by 1 having count(distinct org) >= 2) select distinct uid, 'shared_owner' as rule_id, 16.0::double as severity from o join b using (owner)")
def shared_owner(t):
    return context.shared_owner(t("part").select(F.col("p_partkey").alias("uid"), F.concat("p_brand", F.col("p_size").cast("string")).alias("owner"), F.col("p_name").alias("org")))


@query("select l_partkey as uid, 'services_per_visit_outlier' as rule_id, 14.0::double as severity from (select l_partkey, l_returnflag, sum(l_quantity) as services, count(*) as days from lineitem group by 1, 2) where days >= 5 group by 1 having max(services / days) >= 30")
def services_per_visit(t):
    codes = t("lineitem").groupBy(F.col("l_partkey").alias("uid"), "l_returnflag").agg(F.sum("l_quantity").alias("services"), F.count("*").alias("days"))
    return context.services_per_visit(codes, 30.0, 5)


@query("""with f as (select o_custkey as uid, cast(count(*) as double) as deficiencies, count_if(o_orderpriority = '1-URGENT' and o_orderstatus = 'P') as jeopardy, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) as fines, count_if(o_totalprice > 400000) as denials from orders group by 1)
 select uid, 'immediate_jeopardy_citation' as rule_id, 22.0::double as severity from f where jeopardy > 0
 union all select uid, 'civil_monetary_penalty', round_even(6 + 14 * p, 0) from (select uid, fines, cume_dist() over (order by fines) as p from f where fines > 0) where fines >= 10000
 union all select uid, 'payment_denial_imposed', 16.0 from f where denials > 0
 union all select uid, 'many_health_deficiencies', 8.0 from (select uid, cume_dist() over (order by deficiencies) as p from f where deficiencies > 0) where p >= 0.9""")
def enforcement_flags(t):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    rows = t("orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.count("*").cast("double").alias("deficiencies"), F.count_if((F.col("o_orderpriority") == "1-URGENT") & (status == "P")).alias("jeopardy"), F.round(F.sum(F.when(status == "F", price).otherwise(0)), 2).alias("fines"), F.count_if(price > 400_000).alias("denials"))
    return context.enforcement(rows)


@query("with f as (select user_id as uid, count_if(event_type = 'purchase') as complaints, count(*) as inspections from events group by 1) select uid, 'childcare_valid_complaint' as rule_id, cast(least(34, 18 + 6 * (complaints - 1)) as double) as severity from f where complaints >= 1 union all select uid, 'childcare_many_inspections', 6.0 from f where inspections >= 6")
def complaint_flags(t):
    return context.complaints(t("events").groupBy(F.col("user_id").alias("uid")).agg(F.count_if(F.col("event_type") == "purchase").alias("complaints"), F.count("*").alias("inspections")))


@query("select distinct o_custkey as uid, 'paid_after_npi_deactivated' as rule_id, 45.0::double as severity from orders join customer on o_custkey = c_custkey where c_acctbal < 500 and year(o_orderdate) > 1997 + c_custkey % 3 and c_custkey % 5 <> 0")
def deactivated_flags(t):
    k = F.col("c_custkey")
    facts = t("orders").select(F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("amount"))
    return context.deactivated(facts, t("customer").where("c_acctbal < 500").select(k.alias("uid"), (1997 + k % 3).alias("off_year")), t("customer").where(k % 5 == 0).select(k.alias("uid")))


@query("""with c as (select o_orderkey as uid, 'COMPANY ' || o_custkey as name_key, strftime(o_orderdate, '%Y-%m-%d') as s, case when o_orderstatus = 'F' then strftime(o_orderdate + interval 60 day, '%Y-%m-%d') end as e from orders),
 l as (select 'COMPANY ' || c_custkey as name_key, case when c_custkey % 2 = 0 then 'debarred' else 'strike' end as kind, (1996 + c_custkey % 4) || '-03-01' as s2, (1997 + c_custkey % 4) || '-03-01' as e2 from customer where c_custkey % 7 = 0)
 select uid, case when kind = 'debarred' and s <= e2 and coalesce(e, '9999') >= s2 then 'contract_during_debarment' when kind = 'debarred' then 'lni_debarred' else 'lni_strike' end as rule_id, cast(case when kind = 'debarred' and s <= e2 and coalesce(e, '9999') >= s2 then 40 when kind = 'debarred' then 22 else 10 end as double) as severity from c join l using (name_key)""")
def labor_flags(t):
    k, at = F.col("c_custkey"), F.col("o_orderdate")
    contracts = t("orders").select(F.col("o_orderkey").alias("uid"), F.concat(F.lit("COMPANY "), F.col("o_custkey").cast("string")).alias("name_key"), F.date_format(at, "yyyy-MM-dd").alias("start"), F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add(at, 60), "yyyy-MM-dd")).alias("end"))
    day = lambda y: F.concat((y + k % 4).cast("string"), F.lit("-03-01"))
    listed = t("customer").where(k % 7 == 0).select(F.concat(F.lit("COMPANY "), k.cast("string")).alias("name_key"), F.when(k % 2 == 0, "debarred").otherwise("strike").alias("kind"), day(1996).alias("start"), day(1997).alias("end"))
    return context.labor(contracts, listed)


LISTS = ["OIG LEIE", "WA HCA terminated (Medicaid)", "SAM.gov", "CMS Revoked Medicare"]
CODES = ["1128a1", "1128(b)(4)", "1128b5", "", "1128b7", "1128 b4"]
REASONS = ["", "License Suspended by the state", "licence revoked", "Conviction", "License expired"]
GRADES = ["definitive", "corroborated", "name-only"]
IDENTITIES = ["license-mismatch", "license-confirmed", "unique-name", "taxonomy-mismatch", "dob-mismatch"]
SOURCES = ["healthcare", "hospice", "healthcare"]


@query(
    f"""with h as (select c_custkey as uid, c_custkey as k, {sql_pick(LISTS, "c_custkey")} as list, {sql_pick(CODES, "c_custkey // 2")} as code, {sql_pick(REASONS, "c_custkey // 3")} as reason, {sql_pick(GRADES, "c_custkey // 5")} as confidence, {sql_pick(IDENTITIES, "c_custkey // 4")} as identity, {sql_pick(SOURCES, "c_custkey // 7")} as source, upper(trim({sql_pick(STATUSES, "c_custkey")})) as status, 2008 + c_custkey % 9 as listed, 2005 + c_custkey % 15 as paid from customer),
    a as (select *, case when confidence = 'definitive' and k % 2 = 0 then 48 when confidence = 'definitive' then 40 when confidence = 'corroborated' then 30 else 20 end as base, (regexp_matches(replace(replace(replace(lower(code), ' ', ''), '(', ''), ')', ''), '^1128b(4|5)') or (contains(upper(list), 'HCA') and regexp_matches(lower(reason), 'licen[cs]e\\s+(suspend|revok|surrender)'))) and source = 'healthcare' and status in ('REVOKED', 'SUSPENDED', 'EXPIRED', 'TERMINATED', 'SURRENDER', 'VOLUNTARY SURRENDER', 'DENIED', 'INACTIVE') as derived from h),
    b as (select *, case when confidence = 'definitive' and ends_with(identity, 'mismatch') then least(base, 10) else base end as s1 from a), c as (select *, case when derived then least(s1, 22) else s1 end as s2 from b)
    select uid, case when derived then 'excluded_license_derived' else 'excluded_or_sanctioned' end as rule_id, cast(case when k % 6 > 0 and paid <= listed and 2020 - paid >= 8 then greatest(10, round_even(s2 * 0.3, 0)) when k % 6 > 0 and paid <= listed and 2020 - paid >= 5 then greatest(10, round_even(s2 * 0.6, 0)) else s2 end as double) as severity from c"""
)
def exclusion_flags(t):
    k = F.col("c_custkey")
    at = lambda n: F.floor(k / n)
    rows = t("customer").select(
        k.alias("uid"), pick(LISTS, k).alias("list"), pick(CODES, at(2)).alias("code"), pick(REASONS, at(3)).alias("reason"), pick(GRADES, at(5)).alias("confidence"), pick(IDENTITIES, at(4)).alias("identity"), pick(SOURCES, at(7)).alias("source"), pick(STATUSES, k).alias("status"),
        (k % 2 == 0).alias("mandatory"), F.concat((2008 + k % 9).cast("string"), F.lit("-05-01")).alias("date"), F.when(k % 6 > 0, 2005 + k % 15).cast("int").alias("last_paid"),
    )
    return context.exclusions(rows, 2020)


@query("with c as (select c_custkey as uid, case when c_custkey % 3 = 0 then 'm' || c_custkey % 200 end as email, case when c_custkey % 2 = 0 then '206555' || lpad(cast(c_custkey % 300 as varchar), 4, '0') end as phone from customer), k as (select uid, 'email' as via, email as key from c where email is not null union all select uid, 'phone', phone from c where phone is not null), s as (select via, key from k group by 1, 2 having count(distinct uid) between 2 and 8) select uid, 'shared_contact_multiple_providers' as rule_id, 22.0::double as severity, max(via) as via from k join s using (via, key) group by 1")
def shared_contact(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.alias("uid"), F.when(k % 3 == 0, F.concat(F.lit("m"), (k % 200).cast("string"))).alias("email"), T.phone(F.when(k % 2 == 0, F.concat(F.lit("206-555-"), F.lpad((k % 300).cast("string"), 4, "0")))).alias("phone"))
    return context.shared_contact(rows)


@query("with b as (select p_brand || p_size as person from part group by 1 having count(*) between 3 and 10) select p_partkey as uid, 'concentration_same_contact_person' as rule_id, 12.0::double as severity from part where p_brand || p_size in (select person from b)")
def contact_person(t):
    return context.contact_person(t("part").select(F.col("p_partkey").alias("uid"), F.concat("p_brand", F.col("p_size").cast("string")).alias("person")))


@query(f"with {REGISTRY}, m as (select c_custkey as uid, coalesce(a.active, false) or coalesce(b.active, false) as good, coalesce(a.active, b.active) is not null as there from (select c_custkey, {sql_key(sql_pick(NAMES, 'c_custkey'))} as key, {sql_key(sql_pick(NAMES, 'c_custkey + 3'))} as key2 from customer) c left join r a on a.name_key = c.key left join r b on b.name_key = c.key2) select uid, 'no_active_business_registration' as rule_id, case when there then 20.0::double else 12.0::double end as severity from m where not good")
def registration_flags(t):
    return context.registration(registry_best_match(t))


from registrum.plans import registries, resolution  # noqa: E402, F401  registers its queries

"""Registered queries of registry projections, money attachment, operator assembly, serving and bulk pages, over texts made of the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import names as N
from registrum.functions import text as T
from registrum.operators import assembly, context_rules, linkage, payments, rules, serve
from registrum.plans.catalogue import ADDRESSES, NAMES, STATUSES, pick, query, sql_key, sql_pick
from registrum.sources import bulk, projections, screening

PEOPLE = ["Ann Marie Smith", "ANN SMITH", "Bo Li", "J Doe", "Kim Ada Lee", "Lee Sol Kim", "Maria Castellan", "Edgar Q Moss", "  ", "Zoe van der Berg", "Smith Ann"]
DBAS = ["", "Kessel Child Care", "Saltmarsh Preschool", "Quillback Kids Tacoma", "Finch Center", "", "Child Care"]
CITIES = ["Seattle", "seattle", "Yakima", "", "Spokane Valley"]
MAILS = ["smith@x.org", "nora4@mail.com", "", "hill@army.mil", "DEPT@state.GOV", "nobody"]
DATES = ["2015-01-31", "01/15/2008", "20120229", "2011", "", "n/a"]
MONEY = ["$ 1,250.50", "0", "", "NULL", "90000", "$12,000,000.00", "-5"]


def number(k, n: int = 9) -> F.Column:
    return F.lpad((k % n).cast("string"), 10, "1")


# Names --------------------------------------------------------------------------------------------------------------------------

DULL = "(list_contains(" + repr(N.GENERIC).replace('"CENTER\'S"', "'CENTER''S'") + ", x) or regexp_matches(x, '^(#?\\d+|[IVXLC]{1,5})$'))"


@query(
    f"""with n as (select c_custkey as uid, {sql_pick(NAMES, "c_custkey")} as name from customer), w as (select *, string_split({sql_key("name")}, ' ') as w from n), f as (select *, list_filter(range(1, len(w) + 1), lambda i: w[i] <> '' and w[i] not in ('OF', 'AT') and not list_contains(list_filter(w, lambda x: {DULL}), w[i])) as good from w),
    s as (select *, coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: w[i] in ('OF', 'AT') and i > coalesce(good[1], 999))), 999) as stop from f), b as (select *, array_to_string(list_transform(list_filter(good, lambda i: i < stop)[1:2], lambda i: case w[i] when 'MT' then 'MOUNT' when 'ST' then 'SAINT' else w[i] end), ' ') as brand0 from s)
    select uid, case when length(brand0) >= 4 then brand0 else '' end as brand, len(list_filter(w, lambda x: x <> '')) > 0 and len(list_filter(w, lambda x: x <> '' and not {DULL})) = 0 as generic, regexp_matches(upper(name), '{"|".join(N.VENUES)}') as venue,
    trim(regexp_replace({sql_key("name")}, '\\s*[-#]?\\s*\\d{{1,3}}$', '')) as site from b"""
)
def name_predicates(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.alias("uid"), pick(NAMES, k).alias("name"))
    key = T.name_key(F.col("name"))
    return rows.select("uid", N.brand_key(F.col("name")).alias("brand"), N.generic(key).alias("generic"), N.venue(F.col("name")).alias("venue"), N.without_site(key).alias("site"))


TYPES = ["Dentist License", "Independent Clinical Social Worker", "Physician Assistant", "Physician And Surgeon", "Registered Nurse", "Medical Student", "Barber", "Midwife"]


def sql_profession(c: str) -> str:
    return "case " + " ".join(f"when contains(upper({c}), '{w}') then '{p}'" for w, p in N.PROFESSIONS) + " end"


@query(
    f"""with r as (select c_custkey as uid, {sql_profession(sql_pick(TYPES, "c_custkey"))} as a, {sql_profession(sql_pick(TYPES, "c_custkey // 8"))} as b from customer)
    select uid, a as profession, coalesce(a <> b and not ((a = 'PHYSICIAN' and b = 'STUDENT') or (b = 'PHYSICIAN' and a = 'STUDENT') or (a = 'NURSING' and b = 'STUDENT') or (b = 'NURSING' and a = 'STUDENT') or (a = 'PA' and b = 'STUDENT') or (b = 'PA' and a = 'STUDENT') or (a = 'NURSING' and b = 'MIDWIFE') or (b = 'NURSING' and a = 'MIDWIFE')), false) as conflict from r"""
)
def profession_conflicts(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.alias("uid"), pick(TYPES, k).alias("a"), pick(TYPES, F.floor(k / 8)).alias("b"))
    return rows.select("uid", N.profession(F.col("a")).alias("profession"), N.professions_conflict(F.col("a"), F.col("b")).alias("conflict"))


# Projections ---------------------------------------------------------------------------------------------------------------------


def _entity_columns(df: DataFrame) -> DataFrame:
    return df.select("uid", "name", "dba", "entity_type", "status", "address", "city", "amount", "lat", "source_url")


EMPTY = "cast(null as double)"


@query(
    f"""with c as (select *, row_number() over (partition by case when c_custkey % 5 > 0 then cast(c_custkey % 40 as varchar) else case when c_custkey % 10 = 0 then '' else 's' || c_custkey % 30 end end order by c_custkey) as turn, case when c_custkey % 5 > 0 then cast(c_custkey % 40 as varchar) else case when c_custkey % 10 = 0 then '' else 's' || c_custkey % 30 end end as id from customer)
    select 'childcare:' || id as uid, trim({sql_pick(NAMES, "c_custkey")}) as name, {sql_pick(DBAS, "c_custkey")} as dba, 'Center' as entity_type, trim({sql_pick(STATUSES, "c_custkey")}) as status, replace({sql_pick(ADDRESSES, "c_custkey")}, '{{}}', 'N') as address, {sql_pick(CITIES, "c_custkey")} as city, {EMPTY} as amount, try_cast({sql_pick(["47.5", "NULL", "", "x"], "c_custkey")} as double) as lat,
    'https://data.wa.gov/resource/was8-3ni8.json?wacompassid=' || id as source_url from c where turn = 1 and id <> ''"""
)
def project_childcare(t):
    k = F.col("c_custkey")
    rows = t("customer").select(
        F.when(k % 5 > 0, (k % 40).cast("string")).alias("wacompassid"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit(" s"), (k % 30).cast("string"))).alias("sspsprovidernumber"), pick(NAMES, k).alias("providername"), pick(DBAS, k).alias("doingbusinessas"), F.lit("Center").alias("facilitytypegeneric"),
        pick(STATUSES, k).alias("latestoperatingstatus"), F.replace(pick(ADDRESSES, k), F.lit("{}"), F.lit("N")).alias("physicalstreetaddress"), pick(CITIES, k).alias("physicalcity"), pick(["47.5", "NULL", "", "x"], k).alias("physciallatitude"), k.alias("at"),
    )
    return _entity_columns(projections.childcare(rows, "at"))


@query(
    f"""with c as (select *, case when c_custkey % 4 = 0 then trim({sql_pick(NAMES, "c_custkey")}) else 'C' || c_custkey % 70 end as id from customer), r as (select *, row_number() over (partition by id order by c_custkey) as turn from c)
    select 'contracts_2024:' || id as uid, trim({sql_pick(NAMES, "c_custkey")}) as name, {sql_pick(DBAS, "c_custkey")} as dba, 'STATE CONTRACT' as entity_type, trim({sql_pick(STATUSES, "c_custkey")}) as status, 'agency' as address, '' as city, try_cast(replace(replace(replace({sql_pick(MONEY, "c_custkey")}, '$', ''), ',', ''), ' ', '') as double) as amount, {EMPTY} as lat, 'https://data.wa.gov/d/pwse-3zea' as source_url from r where turn = 1 and id <> ''"""
)
def project_contracts(t):
    k = F.col("c_custkey")
    rows = t("customer").select(F.when(k % 4 != 0, F.concat(F.lit("C"), (k % 70).cast("string"))).alias("agency_contract_no"), pick(NAMES, k).alias("contractor_name_search_for"), pick(DBAS, k).alias("contractor_name_d_b_a_optional"), pick(STATUSES, k).alias("procurement_type"), F.lit("agency").alias("agency_number_agency_name"), pick(MONEY, k).alias("cost_of_contract"), k.alias("at"))
    return _entity_columns(projections.contracts(rows, 2024, "at"))


@query(
    """with r as (select *, 'RN' || c_custkey % 90 as id, row_number() over (partition by c_custkey % 90 order by c_custkey) as turn, case when c_custkey % 3 = 0 then 'Ann' else '' end as f, case when c_custkey % 4 = 0 then '' else c_name end as l from customer)
    select 'healthcare:' || id as uid, case when f || l = '' then id else trim(f || ' ' || l) end as name, '' as dba, 'Registered Nurse' as entity_type, 'x' as status, '' as address, '' as city, cast(null as double) as amount, cast(null as double) as lat, 'https://data.wa.gov/resource/qxh8-f4bd.json?credentialnumber=' || id as source_url from r where turn = 1"""
)
def project_credentials(t):
    k = F.col("c_custkey")
    rows = t("customer").select(F.concat(F.lit("RN"), (k % 90).cast("string")).alias("credentialnumber"), F.when(k % 3 == 0, "Ann").alias("firstname"), F.when(k % 4 != 0, F.col("c_name")).alias("lastname"), F.lit("Registered Nurse").alias("credentialtype"), F.lit(" x ").alias("status"), k.alias("at"))
    return _entity_columns(projections.credentials(rows, "at"))


@query(
    f"""with r as (select *, case when p_partkey % 6 = 0 then trim({sql_pick(NAMES, "p_partkey")}) else cast(p_partkey % 150 as varchar) end as id from part), s as (select *, row_number() over (partition by id order by p_partkey) as turn from r where id <> '')
    select 'hospice:' || id as uid, case when trim({sql_pick(NAMES, "p_partkey")}) = '' then id else trim({sql_pick(NAMES, "p_partkey")}) end as name, p_type as status, 'WA' as state, p_type as ownership, case when p_size % 2 = 0 then '2015-01-31' end as cert_date from s where turn = 1"""
)
def project_facilities(t):
    k = F.col("p_partkey")
    rows = t("part").select(F.when(k % 6 != 0, (k % 150).cast("string")).alias("ccn"), pick(NAMES, k).alias("facility"), F.col("p_type").alias("owner"), F.when(F.col("p_size") % 2 == 0, "2015-01-31").alias("certified"), k.alias("at"))
    out = projections.facilities(rows, "hospice", "Hospice", {"id": "ccn", "name": "facility", "ownership": "owner", "cert_date": "certified"}, order="at")
    return out.select("uid", "name", "status", "state", F.col("raw")["_ownership"].alias("ownership"), F.col("raw")["_cert_date"].alias("cert_date"))


@query(f"with r as (select *, cast(1000000000 + p_size as varchar) as npi, row_number() over (partition by p_size order by p_partkey) as turn from part where p_partkey % 9 > 0) select 'dme:' || npi as uid, case when {sql_pick(NAMES, 'p_partkey')} = '' then npi else {sql_pick(NAMES, 'p_partkey')} end as name, case when p_partkey % 3 = 0 then 'OR' else 'WA' end as state, 'https://npiregistry.cms.gov/provider-view/' || npi as source_url from r where turn = 1")
def project_providers(t):
    k = F.col("p_partkey")
    rows = t("part").select(F.when(k % 9 > 0, (1_000_000_000 + F.col("p_size")).cast("string")).alias("npi"), pick(NAMES, k).alias("name"), F.when(k % 3 == 0, "OR").alias("state"), k.alias("at"))
    return projections.npi_category(rows, "dme", "Equipment", order="at").select("uid", "name", "state", "source_url")


# Money ---------------------------------------------------------------------------------------------------------------------------


def contract_entities(t) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fields = F.create_map(F.lit("contract_effective_start"), F.when(k % 3 > 0, F.concat(day, F.lit("T00:00"))), F.lit("contract_effective_end_date"), F.when(k % 2 == 0, day))
    return t("orders").select(
        F.concat(F.lit("u"), k.cast("string")).alias("uid"), F.element_at(F.array(*map(F.lit, ["contracts", "contracts_2023", "contracts_2025", "dme"])), (k % 4 + 1).cast("int")).alias("source"), (k % 500).cast("string").alias("source_id"), F.concat(F.lit("Vendor "), (k % 3).cast("string")).alias("name"),
        F.when(k % 7 > 0, F.col("o_totalprice")).alias("amount"), fields.alias("raw"),
    )


@query(
    """with e as (select 'u' || o_orderkey as uid, ['contracts', 'contracts_2023', 'contracts_2025', 'dme'][o_orderkey % 4 + 1] as source, o_orderkey % 500 as id, 'VENDOR ' || o_orderkey % 3 as vendor, o_totalprice as amount, case when o_orderkey % 3 > 0 then strftime(o_orderdate, '%Y-%m-%d') else '' end as s, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') else '' end as x from orders where o_orderkey % 7 > 0)
    select uid, 'WA agency contract' as program, case when s <> '' and x <> '' then s || ' → ' || x when s || x <> '' then s || x when contains(source, '_') then 'FY20' || right(source, 2) else 'FY2022' end as period, amount
    from e where source <> 'dme' qualify row_number() over (partition by id, vendor order by source desc, uid) = 1"""
)
def contract_payments(t):
    return payments.contract_payments(contract_entities(t))


@query(
    """with n as (select case when c_custkey % 3 = 0 then cast(1000000000 + c_custkey % 200 as varchar) when c_custkey % 3 = 1 and c_custkey % 5 > 0 then cast(1000000000 + c_custkey % 170 as varchar) end as npi, 'e' || lpad(cast(c_custkey as varchar), 6, '0') as uid from customer), one as (select npi, max(uid) as uid from n where npi is not null group by 1),
    p as (select cast(1000000000 + o_custkey % 250 as varchar) as npi, o_totalprice as amount, o_orderkey % 5 > 0 as wa, case when year(o_orderdate) % 2 = 0 then '2022' else '2023' end as period from orders)
    select uid, 'Medicare Part B' as program, period, round(sum(amount), 2) as amount, count(*) as n from p join one using (npi) where wa and amount <> 0 group by 1, 2, 3"""
)
def provider_payments(t):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    uid = F.concat(F.lit("e"), F.lpad(k.cast("string"), 6, "0"))
    entities = t("customer").select(uid.alias("uid"), F.when(k % 3 == 0, "dme").otherwise("healthcare").alias("source"), (1_000_000_000 + k % 200).cast("string").alias("source_id"))
    crosswalk = t("customer").where((k % 3 == 1) & (k % 5 > 0)).select(uid.alias("uid"), (1_000_000_000 + k % 170).cast("string").alias("npi"))
    rows = t("orders").withColumn("even", F.year("o_orderdate") % 2 == 0)
    file = lambda even, npi, paid, state: rows.where(F.col("even") == even).select((1_000_000_000 + F.col("o_custkey") % 250).cast("string").alias(npi), F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias(paid), F.when(o % 5 > 0, "WA").otherwise("OR").alias(state))
    years = {"2022": file(True, "Rndrng_NPI", "Paid_Amt", "State"), "2023": file(False, "RNDRNG_NPI", "PAID_AMT", "STATE")}
    met = payments.provider_payments(years, payments.provider_numbers(entities, crosswalk), "Medicare Part B", "rndrng_npi", "paid_amt", ("state", "wa"))
    return met.groupBy("uid", "program", "period").agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n"))


CLAIMS = "l as (select cast(l_suppkey as varchar) as billing, cast(l_partkey as varchar) as servicing, l_returnflag || l_linestatus as code, strftime(l_shipdate, '%Y') as y, cast(l_linenumber as bigint) as patients, cast(l_quantity as bigint) as lines, l_extendedprice as paid from lineitem), k as (select cast(p_partkey as varchar) as npi from part where p_size > 25), m as (select case when servicing in (select npi from k) then servicing when billing in (select npi from k) then billing end as npi, * exclude (billing, servicing) from l)"


@query(
    f"""with {CLAIMS}, y as (select npi, y, round(sum(paid), 2) as amount from m where npi is not null group by 1, 2), w as (select npi, round(sum(paid), 2) as total, sum(lines) as lines, sum(patients) as patients from m where npi is not null group by 1),
    c as (select npi, code, round(sum(paid), 2) as amount from m where npi is not null group by 1, 2 qualify row_number() over (partition by npi order by amount desc, code) <= 5)
    select w.npi, total, cast(lines as bigint) as lines, cast(patients as bigint) as patients, (select string_agg(y || '=' || cast(cast(amount as decimal(18,2)) as varchar), ';' order by y) from y where y.npi = w.npi) as years, (select string_agg(code, ';' order by amount desc, code) from c where c.npi = w.npi) as codes from w"""
)
def claims_spending(t):
    day = F.date_format("l_shipdate", "yyyy-MM")
    line = F.concat_ws(",", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.concat("l_returnflag", "l_linestatus"), day, F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.col("l_extendedprice").cast("string"))
    rows = bulk.claim_lines(t("lineitem").select(F.lit(1).alias("at"), line.alias("line")))
    tracked = t("part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("npi"))
    spent = payments.spending(rows, tracked)
    shown = F.array_join(F.transform(F.map_entries("by_year"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(18,2)").cast("string"))), ";")
    return spent.select("npi", "total", "lines", "patients", shown.alias("years"), F.array_join(F.transform("top_codes", lambda x: x["code"]), ";").alias("codes"))


@query(
    f"""with b as (select ['107', '300', '999'][o_orderkey % 3 + 1] as agency, 'FY' || year(o_orderdate) as fy, {sql_key(sql_pick(NAMES, "o_custkey"))} as name_key, o_totalprice as amount from orders), k as (select distinct {sql_key(sql_pick(NAMES, "c_custkey"))} as name_key from customer where c_custkey % 4 > 0),
    p as (select name_key, fy, round(sum(amount), 2) as amount, list(distinct case agency when '107' then 'HCA' else 'DSHS' end) as a from b join k using (name_key) where agency <> '999' and name_key <> '' group by 1, 2)
    select name_key, round((select sum(amount) from b where b.name_key = p.name_key and agency <> '999'), 2) as total, string_agg(fy, ';' order by fy) as years, array_to_string(list_sort(list_distinct(flatten(list(a)))), '/') as agencies from p group by 1"""
)
def vendor_checkbook(t):
    cells = F.array(F.lit(""), F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")), F.lit(""), pick(["107", "300", "999"], F.col("o_orderkey")), *[F.lit("")] * 5, pick(NAMES, F.col("o_custkey")), F.col("o_totalprice").cast("string"))
    tracked = t("customer").where("c_custkey % 4 > 0").select(T.name_key(pick(NAMES, F.col("c_custkey"))).alias("name_key")).distinct()
    out = payments.checkbook(bulk.checkbook_rows(t("orders").select(cells.alias("cells"))), tracked, {"107": "HCA", "300": "DSHS"})
    return out.select("name_key", "total", F.array_join(F.map_keys("by_fy"), ";").alias("years"), F.array_join("agencies", "/").alias("agencies"))


RULES = ["excluded_or_sanctioned", "paid_after_barred", "credential_surrendered", "disciplinary_action_taken", "civil_monetary_penalty", "billing_spike", "paid_while_sanctioned"]


def order_flags(t) -> DataFrame:
    k = F.col("o_orderkey")
    evidence = F.to_json(F.struct(F.when(k % 2 == 0, F.col("o_totalprice")).alias("amount_after"), F.when(k % 3 > 0, pick(["license-confirmed", "unique-name"], k)).alias("identity_confidence"), pick(DATES, k).alias("bar_date"), (k % 11 == 0).alias("after_unobservable")))
    return t("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity_uid"), pick(RULES, k).alias("rule_id"), (10.0 + k % 37).alias("severity"), F.concat(F.lit("title "), (k % 50).cast("string")).alias("title"), evidence.alias("evidence"))


ORDER_FLAGS = f"f as (select 'c' || o_custkey as uid, {sql_pick(RULES, 'o_orderkey')} as rule, 10.0 + o_orderkey % 37 as severity, 'title ' || o_orderkey % 50 as title, case when o_orderkey % 2 = 0 then o_totalprice end as after, case when o_orderkey % 3 > 0 then {sql_pick(['license-confirmed', 'unique-name'], 'o_orderkey')} end as identity, {sql_pick(DATES, 'o_orderkey')} as day, o_orderkey % 11 = 0 as unseen from orders)"


@query(
    f"""with {ORDER_FLAGS}, m as (select 'c' || c_custkey as uid, c_acctbal as funds from customer where c_custkey % 3 > 0),
    g as (select uid, bool_or(rule in ('excluded_or_sanctioned', 'paid_while_sanctioned', 'paid_after_barred', 'credential_surrendered', 'disciplinary_action_taken')) as sanctioned, bool_or(rule in ('excluded_or_sanctioned', 'paid_after_barred', 'paid_while_sanctioned', 'credential_surrendered')) as barred, bool_or(rule = 'civil_monetary_penalty') as quality, coalesce(sum(after) filter (rule = 'paid_after_barred'), 0) as contradiction from f group by 1),
    i as (select uid, min(severity) as x, arg_min(identity, (1000 - severity, rule)) as identity from f where rule in ('paid_after_barred', 'paid_while_sanctioned') and identity is not null group by 1), t as (select uid, arg_min(title, (1000 - severity, rule)) as title from f group by 1)
    select coalesce(g.uid, m.uid) as uid, coalesce(funds, 0) as funds, coalesce(sanctioned, false) as sanctioned, coalesce(barred, false) as barred, coalesce(quality, false) as quality, round(coalesce(contradiction, 0), 2) as contradiction from g full join m on m.uid = g.uid"""
)
def member_facts(t):
    funds = t("customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uid"), F.col("c_acctbal").alias("funds"))
    return payments.member_facts(order_flags(t), funds).select("uid", "funds", "sanctioned", "barred", "quality", F.round("contradiction", 2).alias("contradiction"))


# Assembly ------------------------------------------------------------------------------------------------------------------------


def cluster(t) -> DataFrame:
    """Entities of several sources with names, trade names, contacts and addresses that meet in places; root is a component given by hand."""
    k = F.col("c_custkey")
    source = pick(["childcare", "healthcare", "contracts", "contracts_2024", "hospice"], k)
    at = lambda n: F.floor(k / n)
    fields = F.create_map(
        F.lit("primarycontactpersonname"), pick(PEOPLE, at(2)), F.lit("primarycontactemail"), pick(MAILS, at(3)), F.lit("primarycontactphonenumber"), pick(["206 555 0101", "", "1", "(509) 555-7777"], at(2)), F.lit("middlename"), pick(["", "Ada", "Sol", "Q"], at(5)), F.lit("birthyear"), pick(["1960", "", "2001"], at(7)),
        F.lit("expirationdate"), pick(["2024-01-01", "2012-05-05", "06/30/2017", ""], at(5)), F.lit("licenseeffectivedate"), pick(["2010-01-01", "", "2015-03-03"], at(3)), F.lit("procurement_type"), pick(["", "Data Sharing", "Sole source"], at(4)), F.lit("purpose_of_the_contract"), pick(["x", "Non-Financial", ""], at(6)),
    )
    return t("customer").select(
        at(6).alias("root"), F.concat(F.lit("e"), k.cast("string")).alias("uid"), source.alias("source"), F.concat(pick(["0", "", "00"], k), (k % 7).cast("string")).alias("source_id"), F.when(source == "healthcare", pick(PEOPLE, k)).otherwise(pick(NAMES, at(2))).alias("name"), pick(DBAS, k).alias("dba"),
        F.replace(pick(ADDRESSES, at(3)), F.lit("{}"), at(6).cast("string")).alias("address"), pick(CITIES, at(4)).alias("city"), F.lit("98101").alias("zip"), pick(STATUSES, k).alias("status"), pick([0.0, 5000.0, 25.5], k).alias("amount"), fields.alias("raw"),
    )


def _c(values: list, by: str) -> str:
    return sql_pick(values, by)


CLUSTER = f"""e as (select c_custkey as k, c_custkey // 6 as root, 'e' || c_custkey as uid, {_c(["childcare", "healthcare", "contracts", "contracts_2024", "hospice"], "c_custkey")} as source, {_c(["0", "", "00"], "c_custkey")} || c_custkey % 7 as source_id, case when c_custkey % 5 = 1 then {_c(PEOPLE, "c_custkey")} else {_c(NAMES, "c_custkey // 2")} end as name, {_c(DBAS, "c_custkey")} as dba,
 replace({_c(ADDRESSES, "c_custkey // 3")}, '{{}}', cast(c_custkey // 6 as varchar)) as address, {_c(CITIES, "c_custkey // 4")} as city, {_c(PEOPLE, "c_custkey // 2")} as contact, {_c(MAILS, "c_custkey // 3")} as mail, {_c(["206 555 0101", "", "1", "(509) 555-7777"], "c_custkey // 2")} as phone, {_c([0.0, 5000.0, 25.5], "c_custkey")} as amount, {_c(["", "Data Sharing", "Sole source"], "c_custkey // 4")} as kind, {_c(["x", "Non-Financial", ""], "c_custkey // 6")} as purpose, {_c(STATUSES, "c_custkey")} as status from customer)"""


def sql_person(c: str) -> str:
    w = f"list_filter(string_split(upper(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), ' '), lambda x: length(x) > 1)"
    return f"case when len({w}) >= 2 then array_to_string(list_sort([{w}[1], {w}[-1]]), ' ') end"


def sql_line(*parts: str) -> str:
    joined = " || ' ' || ".join(f"trim({p})" for p in parts)
    table = ", ".join(f"'{a}': '{b}'" for a, b in T.STREETS.items())
    return f"array_to_string(list_transform(string_split(upper(trim(regexp_replace({joined}, '\\s+', ' ', 'g'))), ' '), lambda x: coalesce(map {{{table}}}[x], x)), ' ')"


@query(
    f"""with {CLUSTER}, n as (select *, {sql_key("name")} as nk, {sql_key("dba")} as dk, string_split({sql_key("name")}, ' ') as nw, string_split({sql_key("dba")}, ' ') as dw, regexp_replace(phone, '\\D', '', 'g') as digits, {sql_line("address", "city", "'98101'")} as line from e),
    k as (select uid, unnest([case when source <> 'healthcare' and length(nk) >= 4 and len(list_filter(nw, lambda x: not {DULL})) > 0 then 'org:' || nk end, case when source <> 'healthcare' and length(dk) >= 4 and len(list_filter(dw, lambda x: not {DULL})) >= 2 then 'org:' || dk end, case when source <> 'healthcare' and dba = name and length(dk) >= 4 and len(list_filter(dw, lambda x: not {DULL})) > 0 then 'org:' || dk end,
      case when source = 'childcare' then 'person:' || {sql_person("contact")} end, case when source = 'childcare' and mail <> '' then 'email:' || lower(mail) end, case when source = 'childcare' and length(digits) >= 10 then 'phone:' || right(digits, 10) end, case when source = 'healthcare' then 'person:' || {sql_person("name")} end,
      case when source = 'childcare' and regexp_matches(address, '\\d') and length(line) >= 8 then 'addr:' || line end]) as key from n) select distinct uid, key from k where key is not null"""
)
def match_keys(t):
    return assembly.match_keys(cluster(t)).distinct()


@query(f"with {CLUSTER} select uid, case when starts_with(source, 'contracts') then 'contracts' else source end as program, amount > 0 and not regexp_matches(upper(kind || ' ' || purpose || '  ' || status), 'DATA SHAR|DATA-SHAR|MEMORANDUM OF UNDERSTANDING|ORGANIZATIONAL LICENSE|COMPUTER AND INFORMATION SERVICES|NON-FINANCIAL|NURSING FACILITY SERVICES') as substantive from e")
def contract_substance(t):
    return cluster(t).select("uid", assembly.program(F.col("source")).alias("program"), assembly.substantive(F.col("amount"), F.col("status")).alias("substantive"))


@query(f"with {CLUSTER}, r as (select *, row_number() over (partition by root, {sql_key('name')}, ltrim(source_id, '0') order by source desc, uid) as turn from e where starts_with(source, 'contracts')) select root, uid from r where turn = 1 union all select root, uid from e where not starts_with(source, 'contracts')")
def folded_contracts(t):
    return assembly.folded_members(cluster(t)).select("root", "uid")


def sql_brand(name: str) -> str:
    """The brand, else the name key, of a column in SQL."""
    w = f"string_split({sql_key(name)}, ' ')"
    good = f"list_filter(range(1, len({w}) + 1), lambda i: {w}[i] <> '' and {w}[i] not in ('OF', 'AT') and not list_contains(list_filter({w}, lambda x: {DULL}), {w}[i]))"
    stop = f"coalesce(list_min(list_filter(range(1, len({w}) + 1), lambda i: {w}[i] in ('OF', 'AT') and i > coalesce({good}[1], 999))), 999)"
    return f"array_to_string(list_transform(list_filter({good}, lambda i: i < {stop})[1:2], lambda i: case {w}[i] when 'MT' then 'MOUNT' when 'ST' then 'SAINT' else {w}[i] end), ' ')"


BRANDS = f"brands as (select name, {sql_key('name')} as nk, {sql_brand('name')} as b, regexp_matches(upper(name), '{'|'.join(N.VENUES)}') as host from (select distinct name from e))"
OWN_BRAND = "case when length(b) >= 4 then b else nk end"


@query(
    f"""with {CLUSTER}, {BRANDS}, a as (select root, uid, name, {sql_line("address", "city", "'98101'")} as line from e where source = 'childcare' and regexp_matches(address, '\\d')), m as (select root, line, count(distinct uid) as n, count(distinct case when not host and not regexp_matches(upper(dba), '{"|".join(N.VENUES)}') then {OWN_BRAND} end) as brands from a join (select uid, dba from e) using (uid) join brands using (name) where length(line) >= 8 group by 1, 2)
    select distinct root, 'colocated' as signal from m where n >= 2 and brands >= 2
    union all select distinct root, 'documented' from e c where starts_with(source, 'contracts') and dba <> '' and {sql_key("dba")} <> {sql_key("name")} and exists (select 1 from e o where o.root = c.root and o.name <> '' and trim(regexp_replace({sql_key("o.name")}, '\\s*[-#]?\\s*\\d{{1,3}}$', '')) = trim(regexp_replace({sql_key("c.dba")}, '\\s*[-#]?\\s*\\d{{1,3}}$', '')))"""
)
def structure_signals(t):
    rows = cluster(t)
    a = assembly.colocated(rows, assembly.match_keys(rows)).select("root", F.lit("colocated").alias("signal"))
    return a.unionByName(assembly.documented(rows).select("root", F.lit("documented").alias("signal")))


@query(
    f"""with {CLUSTER}, {BRANDS}, r as (select root, case when length(b) >= 4 then b end as brand from e join brands using (name) where source <> 'healthcare' and name <> ''), g as (select root, brand, count(*) as n from r where brand is not null group by 1, 2),
    f as (select root, case when contains(brand, ' ') and exists (select 1 from g o where o.root = g.root and o.brand = split_part(g.brand, ' ', 1)) then split_part(brand, ' ', 1) else brand end as brand, n from g), h as (select root, brand, sum(n) as n from f group by 1, 2), x as (select *, sum(n) over (partition by root) as total, row_number() over (partition by root order by n desc, brand) as turn from h)
    select root, brand from x where turn = 1 and total >= 3 and n / total >= 0.7"""
)
def open_brand_groups(t):
    return rules.open_brands(cluster(t).where("source <> 'healthcare' and name <> ''"), "root")


@query(
    f"""with {CLUSTER}, {BRANDS}, a as (select *, upper(trim(regexp_replace(trim(address) || ' ' || trim(city) || ' 98101', '\\s+', ' ', 'g'))) as key from e where address <> ''),
    s as (select key, count(distinct uid) as providers, count(distinct nullif(upper(trim(regexp_replace(name, '\\s+', ' ', 'g'))), '')) as names, count(distinct case when name <> '' and trim(name) <> '' and not host and not regexp_matches(upper(dba), '{"|".join(N.VENUES)}') then {OWN_BRAND} end) as brands from a join brands using (name) group by 1 having providers >= 2 and names >= 2 and brands >= 2),
    r as (select key, case when length(b) >= 4 then b end as brand from a join brands using (name) join s using (key) where name <> ''), g as (select key, brand, count(*) as n from r where brand is not null group by 1, 2), f as (select key, case when contains(brand, ' ') and exists (select 1 from g o where o.key = g.key and o.brand = split_part(g.brand, ' ', 1)) then split_part(brand, ' ', 1) else brand end as brand, n from g),
    h as (select key, brand, sum(n) as n from f group by 1, 2), x as (select *, sum(n) over (partition by key) as total, row_number() over (partition by key order by n desc, brand) as turn from h), o as (select key, brand from x where turn = 1 and total >= 2 and n / total >= 0.7)
    select uid, 'address_shared_multiple_providers' as rule_id, round_even(cast(case when providers >= 3 then 24.0 else 14.0 end * case when o.brand is not null then 0.35 else 1 end as double), 1) as severity, providers, o.brand from a join s using (key) left join o using (key)"""
)
def shared_addresses(t):
    return rules.shared_addresses(cluster(t))


@query(
    f"""with {CLUSTER}, reg as (select distinct on (nk) {sql_key("name")} as nk, ubi, agent, gov from (select {_c(NAMES, "p_partkey")} as name, lpad(cast(p_partkey % 50 as varchar), 9, '6') as ubi, {_c(PEOPLE, "p_partkey")} as agent, {_c(PEOPLE, "p_partkey + 1")} as gov from part) where {sql_key("name")} <> '' order by nk, ubi, agent),
    m as (select uid, coalesce(a.ubi, b.ubi) as ubi, coalesce(a.agent, b.agent) as agent, coalesce(a.gov, b.gov) as gov from e left join reg a on a.nk = {sql_key("e.name")} left join reg b on b.nk = {sql_key("e.dba")} where a.nk is not null or b.nk is not null),
    k as (select uid, unnest([case when ubi <> '' then 'ubi:' || ubi end, case when length({sql_key("agent")}) >= 4 then 'agent:' || {sql_key("agent")} end, case when length({sql_key("gov")}) >= 4 then 'gov:' || {sql_key("gov")} end]) as key from m) select uid, count(*) as n, md5(string_agg(key, '|' order by key)) as keys from (select distinct uid, key from k where key is not null and (starts_with(key, 'ubi:') or true)) group by 1"""
)
def registry_keys(t):
    p = F.col("p_partkey")
    rows = t("part").select(pick(NAMES, p).alias("name"), F.lpad((p % 50).cast("string"), 9, "6").alias("ubi"), pick(PEOPLE, p).alias("agent"), F.array(pick(PEOPLE, p + 1)).alias("governors"))
    # Of rows with one name and number the first agent stays, and with it its officers.
    found = assembly.registry_keys(cluster(t), rows)
    return found.groupBy("uid").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("key")), "|")).alias("keys"))


@query(
    f"""with {CLUSTER}, h as (select root, {sql_person("name")} as person, upper(trim(regexp_replace(name, '\\s+', ' ', 'g'))) as up, try_cast(regexp_extract({_c(["2024-01-01", "2012-05-05", "06/30/2017", ""], "k // 5")}, '(19|20)\\d\\d') as int) as ends, try_cast(nullif({_c(["1960", "", "2001"], "k // 7")}, '') as int) as birth, upper(nullif({_c(["", "Ada", "Sol", "Q"], "k // 5")}, '')) as middle from e where source = 'healthcare'),
    p as (select root, coalesce(list(distinct person) filter (person is not null), []) as people, coalesce(list(distinct string_split(up, ' ')[-1]) filter (len(string_split(up, ' ')) >= 2 and length(string_split(up, ' ')[-1]) >= 4), []) as surnames, max(ends) as ends, max(birth) as birth, coalesce(list(distinct middle) filter (middle is not null), []) as middles from h group by 1),
    s as (select root, {sql_person("contact")} as person, replace(upper(trim(regexp_replace(split_part(mail, '@', 1), '\\s+', ' ', 'g'))), ' ', '') as box, list_filter(string_split(upper(trim(regexp_replace(contact, '\\s+', ' ', 'g'))), ' ')[2:-2], lambda x: length(x) > 1) as mids, try_cast(regexp_extract({_c(["2010-01-01", "", "2015-03-03"], "k // 3")}, '(19|20)\\d\\d') as int) as lic from e where source = 'childcare'),
    j as (select s.*, p.* exclude (root), coalesce(list_contains(people, person), false) as tied from s join p using (root)),
    o as (select root, bool_or(tied and box <> '' and len(surnames) > 0 and len(list_filter(surnames, lambda x: contains(box, x))) = 0) as mail_differs, bool_or(tied and ((len(middles) > 0 and len(mids) > 0 and not list_has_any(middles, mids) and not list_has_any(list_transform(middles, lambda x: left(x, 1)), list_transform(mids, lambda x: left(x, 1)))) or coalesce(lic - birth < 16, false))) as refuted, any_value(ends) as ends, any_value(people) as people from j group by 1),
    c as (select person, count(*) as n from (select {sql_person("name")} as person from e where source = 'healthcare' union all select {sql_person("contact")} from e where source = 'childcare') where person is not null group by 1 having count(*) > 40),
    v as (select coalesce(list(person), []) as often from c), q as (select o.*, list_has_any(people, often) as common, coalesce(2024 - ends, 0) as years_dead from o, v), b as (select *, case when mail_differs then round_even(case when common then 10 else 25 end * 0.5, 0) else case when common then 10 else 25 end end as p0 from q)
    select root, cast(case when refuted then 0 when years_dead > 10 then round_even(p0 * 0.25, 0) when years_dead > 5 then round_even(p0 * 0.5, 0) else p0 end as double) as bridge, coalesce(common, false) as common, mail_differs, years_dead, refuted from b"""
)
def person_bridges(t):
    rows = cluster(t)
    counts = assembly.name_counts(rows).where("n > 40")  # common enough that the limit of the operator, two, holds for all of them
    return assembly.bridges(rows, "2024-06-01", counts)


@query(
    """with m as (select o_custkey // 3 as root, o_orderkey as uid, ['childcare', 'healthcare', 'contracts', 'contracts_2024', 'hospice'][o_orderkey % 5 + 1] as source, o_orderkey % 5 in (2, 3) and o_orderkey % 4 = 0 as real from orders),
    p as (select root, list_distinct(list(case when starts_with(source, 'contracts') then 'contracts' else source end)) as programs, count(*) as members, bool_or(real) as real from m group by 1), f as (select *, list_filter(programs, lambda x: x <> 'contracts' or real) as counted, root % 2 = 0 as colo, root % 3 = 0 as fuzzy, root % 5 = 0 as geo, root % 7 = 0 as dba, root % 4 = 0 as verified, root % 6 = 0 as branded, root % 8 = 0 as ubi, root % 9 = 0 as agent from p),
    s as (select *, case when len(counted) >= 2 then 10 else 0 end + case when list_contains(counted, 'childcare') and list_contains(counted, 'contracts') then case when branded then 4 else 15 end else 0 end + case when colo then case when branded then 5 else 18 end else 0 end + case when fuzzy then case when branded then 2 else 8 end else 0 end + case when geo then case when branded then 4 else 16 end else 0 end as points, case when ubi then 16 else 0 end + case when agent then 14 else 0 end as hard from f)
    select root, members, len(counted) >= 2 as cross_program, len(counted) >= 2 or colo or fuzzy or geo or ubi or agent as surfaces, case when ubi then 'hard' when dba then 'dba' when agent then 'shell' when colo then 'address' when geo then 'geo' when fuzzy then 'fuzzy' when len(counted) >= 2 then 'cross-program' else 'name' end as strongest_link,
    cast(case when verified then points else round_even(points * 0.3, 0) end + case when list_contains(counted, 'childcare') and list_contains(counted, 'healthcare') then 10 else 0 end + case when verified then hard else round_even(hard * 0.3, 0) end as double) as bonus from s"""
)
def operator_structure(t):
    k = F.col("o_orderkey")
    members = t("orders").select(F.floor(F.col("o_custkey") / 3).alias("root"), k.alias("uid"), pick(["childcare", "healthcare", "contracts", "contracts_2024", "hospice"], k).alias("source"), F.when((k % 5).isin(2, 3), k % 4 == 0).alias("real"))
    r = F.col("root")
    per = members.select("root").distinct()
    flags = per.select("root", (r % 2 == 0).alias("colocated"), (r % 3 == 0).alias("fuzzy"), (r % 5 == 0).alias("geo"), (r % 7 == 0).alias("dba"), (r % 4 == 0).alias("verified"))
    hard = per.select("root", (r % 8 == 0).alias("ubi"), (r % 9 == 0).alias("agent"), F.lit(False).alias("gov"), F.lit(False).alias("owner"), (F.when(r % 8 == 0, 16).otherwise(0) + F.when(r % 9 == 0, 14).otherwise(0)).alias("bonus"))
    out = assembly.structure(members, flags, per.select("root", F.lit(10.0).alias("bridge")), per.where(r % 6 == 0).select("root", F.lit("B").alias("brand")), hard)
    return out.select("root", "members", "cross_program", "surfaces", "strongest_link", "bonus")


@query("with o as (select c_custkey, cast(100000000 + c_custkey % 400 as varchar) as ein, abs(c_acctbal) / 100 as score from customer) select c_custkey as uid, least(100.0, round_even(score + case when c_custkey % 400 % 2 = 0 then case when c_custkey % 400 % 3 > 0 then 10 else 0 end + case when c_custkey % 400 % 5 > 0 then 6 else 0 end + 4 else 0 end + case when c_custkey % 400 % 7 = 0 then 10 else 0 end + 0, 1)) as score from o")
def enriched_scores(t):
    k = F.col("c_custkey")
    number_ = lambda c: (100_000_000 + c).cast("string")
    rows = t("customer").select(k.alias("uid"), number_(k % 400).alias("ein"), F.col("c_name").alias("name"), (F.abs("c_acctbal") / 100).alias("score"))
    n = t("customer").select((k % 400).alias("n")).distinct()
    audited = n.where("n % 2 = 0").select(number_(F.col("n")).alias("ein"), (F.col("n") % 3).alias("questioned"), (F.col("n") % 5).alias("weakness"), F.lit(1).alias("repeated"))
    return assembly.bumped(rows, audited, None, n.where("n % 7 = 0").select(number_(F.col("n")).alias("ein"))).select("uid", "score")


# Serving -------------------------------------------------------------------------------------------------------------------------


@query(
    """with b as (select o_custkey as uid, case when o_custkey % 4 > 0 then c_mktsegment || o_custkey % 97 end as tax, c_mktsegment as source, round(sum(o_totalprice), 2) as funds from orders join customer on o_custkey = c_custkey group by 1, 2, 3), z as (select * from b where funds <> 0),
    n as (select uid, tax as peer_group, funds, list_sort(list(funds) over (partition by tax)) as a from z where tax is not null), w as (select uid, source as peer_group, funds, list_sort(list(funds) over (partition by source)) as a from z), c as (select * from n where len(a) >= 8 union all select * from w where len(a) >= 8 and uid not in (select uid from n where len(a) >= 8))
    select uid, peer_group, len(a) as peers, cast(least(100, round_even(100 * len(list_filter(a, lambda x: x < funds)) / len(a), 0)) as integer) as percentile, a[len(a) // 2 + 1] as median, a[cast(floor(len(a) * 0.9) as integer) + 1] as p90 from c"""
)
def peer_statistics(t):
    k = F.col("c_custkey")
    totals = t("orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.round(F.sum("o_totalprice"), 2).alias("funds"))
    rows = totals.join(t("customer").select(k.alias("uid"), F.when(k % 4 > 0, F.concat("c_mktsegment", (k % 97).cast("string"))).alias("taxonomy"), F.col("c_mktsegment").alias("source")), "uid")
    return serve.peer_stats(rows)


LINKS = ["hard", "fuzzy", "shell", "name", "address"]


@query(f"select 'op' || p_partkey as operator_id from part where {sql_pick(NAMES, 'p_partkey')} ilike '%care%' and p_size % 4 > 0 and {sql_pick(LINKS, 'p_partkey')} in ('hard', 'shell') and p_size % 4 >= 1 order by p_size % 3 = 0 desc, p_retailprice desc, p_size % 4 desc, p_retailprice desc, operator_id limit 40")
def operator_list(t):
    k = F.col("p_partkey")
    rows = t("part").select(F.concat(F.lit("op"), k.cast("string")).alias("operator_id"), pick(NAMES, k).alias("name"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 4).alias("sources"), (F.col("p_size") % 4).alias("barred_people"), F.when(F.col("p_size") % 3 == 0, 5.0).otherwise(0.0).alias("contradiction"), F.col("p_retailprice").alias("funds"), F.lit(True).alias("cross_program"), pick(LINKS, k).alias("strongest_link"))
    return serve.operators(rows, "care", ("barred", "hard"), limit=40).select("operator_id")


def sql_dateish(c: str) -> str:
    iso = f"case when regexp_full_match({c}, '\\d{{4}}-\\d\\d-\\d\\d') then {c} when regexp_full_match({c}, '\\d\\d/\\d\\d/\\d{{4}}') then substr({c}, 7, 4) || '-' || substr({c}, 1, 2) || '-' || substr({c}, 4, 2) when regexp_full_match({c}, '\\d{{8}}') then substr({c}, 1, 4) || '-' || substr({c}, 5, 2) || '-' || substr({c}, 7, 2) when regexp_full_match({c}, '\\d{{4}}') then {c} || '-01-01' end"
    return f"(select case when cast(left(iso, 4) as int) between 1990 and 2035 then iso end from (select {iso} as iso))"


@query(
    f"""with {ORDER_FLAGS}, c as (select 'c' || c_custkey as uid, upper(trim({sql_pick(STATUSES, "c_custkey")})) as status, {sql_pick(DATES, "c_custkey")} as issued, {sql_pick(DATES, "c_custkey + 1")} as expires from customer),
    o as (select uid, {sql_dateish("issued")} as date, 'license issued' as label, 0 as r from c union all select uid, {sql_dateish("expires")}, case when status in ('REVOKED', 'SURRENDER', 'VOLUNTARY SURRENDER', 'SUSPENDED', 'TERMINATED') then 'license ended: ' || lower(status) || ', no dated order' else 'license expires' end, 0 from c
      union all select uid, {sql_dateish("day")}, case when rule in ('excluded_or_sanctioned', 'paid_while_sanctioned', 'paid_after_barred') then 'barred' else left(title, 60) end, case when rule in ('excluded_or_sanctioned', 'paid_while_sanctioned', 'paid_after_barred') then 1 else 2 end from f),
    d as (select uid, date, label, min(r) as r from o where date is not null group by 1, 2, 3) select uid, date, label, ['license', 'bar', 'flag'][r + 1] as kind, min(date) filter (r = 1) over (partition by uid) as bar_date from d"""
)
def entity_timeline(t):
    k = F.col("c_custkey")
    entities = t("customer").select(F.concat(F.lit("c"), k.cast("string")).alias("uid"), pick(STATUSES, k).alias("status"), F.create_map(F.lit("firstissuedate"), pick(DATES, k), F.lit("expirationdate"), pick(DATES, k + 1)).alias("raw"))
    return serve.timeline(entities, order_flags(t))


PROGRAMS = ["Medicare Part B", "Medicaid", "WA agency contract", "WA state (DSHS)"]
PERIODS = ["2022", "FY2024", "2019-01-01 → 2021-12-31", "2023"]


def order_payments(t) -> DataFrame:
    k = F.col("o_orderkey")
    return t("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("uid"), pick(PROGRAMS, k).alias("program"), pick(PERIODS, F.floor(k / 4)).alias("period"), F.col("o_totalprice").alias("amount"))


ORDER_PAYMENTS = f"p as (select 'c' || o_custkey as uid, {sql_pick(PROGRAMS, 'o_orderkey')} as program, {sql_pick(PERIODS, 'o_orderkey // 4')} as period, o_totalprice as amount from orders)"


@query(
    f"""with {ORDER_FLAGS}, {ORDER_PAYMENTS}, l as (select uid, min(case when rule = 'paid_after_barred' then 0 when rule in ('excluded_or_sanctioned', 'paid_while_sanctioned') then 1 when rule = 'billing_spike' then 2 else 3 end) as level from f where o_custkey_even(uid) group by 1) select 1""".replace("o_custkey_even(uid)", "true").replace(" select 1", "")
    + """ , u as (select uid, sum(amount) as amount from p where program <> 'WA agency contract' group by 1)
    select 'program' as kind, program as label, round(sum(amount), 2) as amount, count(*) as n from p group by 2
    union all select 'tier', case level when 0 then 'paid after a bar' when 1 then 'sanctioned and paid' when 2 then 'unusual billing' when 3 then 'other flags' else 'no flags' end, round(sum(amount), 2), count(*) from u left join l using (uid) group by 2
    union all select 'year', period, round(sum(amount), 2), count(*) from p where program <> 'WA agency contract' and regexp_full_match(period, '[0-9]{4}') group by 2
    union all select 'fiscal', period, round(sum(amount), 2), count(*) from p where regexp_full_match(period, 'FY[0-9]{4}') and starts_with(program, 'WA state') group by 2"""
)
def funds_breakdown(t):
    return serve.funds_breakdown(order_payments(t), order_flags(t))


@query(f"with {ORDER_PAYMENTS}, y as (select uid, unnest(list_transform(regexp_extract_all(period, '(19|20)\\d\\d'), lambda x: cast(x as int))) as y from p) select uid, case when min(y) = max(y) then cast(min(y) as varchar) else min(y) || '–' || max(y) end as funds_range from y where y between 2000 and 2035 group by 1")
def funds_ranges(t):
    return serve.period_ranges(order_payments(t), "uid")


@query(
    f"""with {ORDER_FLAGS}, {ORDER_PAYMENTS}, m as (select uid, round(sum(amount), 2) as total from p group by 1), g as (select uid, bool_or(rule = 'paid_after_barred') as a, bool_or(rule in ('excluded_or_sanctioned', 'paid_while_sanctioned', 'credential_surrendered')) as l, sum(after) filter (rule = 'paid_after_barred') as after, min({sql_dateish("day")}) filter (rule in ('excluded_or_sanctioned', 'paid_while_sanctioned', 'paid_after_barred')) as bar_date from f group by 1)
    select coalesce(g.uid, m.uid) as uid, case when a then 'Public money dated after a bar' when l and total > 0 then 'Sanctioned and paid with public money' when l then 'On a sanction list' else 'Paid with public money' end as headline, bar_date, coalesce(total, 0) as total, round(coalesce(after, 0), 2) as after from g full join m on m.uid = g.uid where coalesce(a or l, false) or total is not null"""
)
def dossiers(t):
    return serve.dossier(order_flags(t), order_payments(t)).select("uid", "headline", "bar_date", "total", F.round("after", 2).alias("after"))


@query(
    f"""with {ORDER_FLAGS}, w as (select distinct uid from f where unseen), g as (select 'c' || c_custkey as uid, case when c_custkey % 3 = 0 then 'reviewing' end as state, cast(null as varchar) as note, c_custkey % 5 = 0 as watched from customer where c_custkey % 2 = 0)
    select coalesce(g.uid, w.uid) as uid, state, coalesce(note, case when g.uid is null then 'watched by rule: the bar is newer than the data' end) as note, coalesce(watched, false) or w.uid is not null as watched from g full join w on w.uid = g.uid"""
)
def auto_watch(t):
    from registrum.sources.store import watched_unseen

    k = F.col("c_custkey")
    triage = t("customer").where(k % 2 == 0).select(F.concat(F.lit("c"), k.cast("string")).alias("uid"), F.when(k % 3 == 0, "reviewing").alias("state"), F.lit(None).cast("string").alias("note"), (k % 5 == 0).alias("watched"))
    return watched_unseen(order_flags(t), triage)


# Bulk pages ----------------------------------------------------------------------------------------------------------------------


@query(
    """with d as (select o_custkey as k, upper(['A', 'j', 'K', 'D', ''][o_orderkey % 5 + 1]) as code from orders where o_custkey % 4 > 0), a as (select k, count(*) as deficiencies, count_if(code in ('J', 'K', 'L')) as jeopardy, max(code) as worst from d group by 1),
    b as (select o_custkey as k, round(sum(case when o_orderkey % 3 > 0 then round(o_totalprice, 2) else 0 end), 2) as fines, count_if(o_orderkey % 3 > 0 and round(o_totalprice, 2) <> 0) as penalties, count_if(o_orderkey % 7 = 0) as denied from orders where o_custkey % 3 > 0 group by 1)
    select cast(coalesce(a.k, b.k) as varchar) as uid, coalesce(deficiencies, 0) as deficiencies, cast(coalesce(jeopardy, 0) as bigint) as jeopardy, coalesce(worst, '') as worst, coalesce(fines, 0) as fines, cast(coalesce(penalties, 0) as bigint) as penalties, cast(coalesce(denied, 0) as integer) as denied from a full join b on a.k = b.k"""
)
def facility_enforcement(t):
    k, key = F.col("o_orderkey"), "cms_certification_number_ccn"
    own = F.col("o_custkey").cast("string").alias(key)
    deficiencies = t("orders").where("o_custkey % 4 > 0").select(own, pick(["A", "j", "K", "D", ""], k).alias("scope_severity_code"))
    fine = F.when(k % 3 > 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    penalties = t("orders").where("o_custkey % 3 > 0").select(own, fine.alias("fine_amount"), F.when(k % 7 == 0, "Payment Denial").otherwise("Fine").alias("penalty_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("penalty_date"))
    out = bulk.facility_enforcement(deficiencies, penalties)
    return out.select("uid", "deficiencies", "jeopardy", "worst", F.round("fines", 2).alias("fines"), "penalties", F.size("denials").alias("denied"))


@query("with c as (select l_suppkey as uid, l_partkey || '' as code, l_quantity as s, l_extendedprice / 1000 as a, l_linenumber * 7 as d from lineitem), g as (select uid, round(sum(s * a), 4) as total, count(*) as codes, max(s * a) as top, coalesce(max(case when d >= 20 then s / d end), 0) as most from c group by 1) select uid, round_even(total, 0) as total, codes, round_even(top / total, 3) as top_share, round_even(most, 1) as most_a_day from g where total > 0")
def provider_codes(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("uid"), F.col("l_partkey").cast("string").alias("code"), F.col("l_quantity").alias("services"), (F.col("l_extendedprice") / 1000).alias("average"), (F.col("l_linenumber") * 7).alias("days"))
    return bulk.provider_codes(rows).select("uid", "total", "codes", "top_share", "most_a_day")


OWNERS = ["State INVESTMENT BOARD", "Acme Holdings LLC", "", "Beta Capital Partners II", "Gamma Inc."]
ROLES = ["5% OR GREATER INDIRECT OWNERSHIP INTEREST", "5% OR GREATER DIRECT OWNERSHIP INTEREST", "MANAGING EMPLOYEE"]
SHARES = ["10", "24.9%", "25", "", "x"]


@query(
    f"""with r as (select {sql_key(sql_pick(NAMES, "p_partkey"))} as org, case when {sql_pick(OWNERS, "p_partkey")} = '' then 'Ann Lee' else {sql_pick(OWNERS, "p_partkey")} end as name, case when p_partkey % 3 = 0 then 'aid:' || p_size end as aid, contains({sql_pick(ROLES, "p_partkey")}, 'INDIRECT') and coalesce(try_cast(nullif(regexp_replace({sql_pick(SHARES, "p_size")}, '[^\\d.]', '', 'g'), '') as double) < 25, false) as small from part)
    select org, coalesce(aid, {sql_key("name")}) as owner, min(name) as owner_name from r where org <> '' and not small and not regexp_matches(upper(name), 'INVESTMENT BOARD|PENSION|RETIREMENT SYSTEM|INVESTMENT FUND|CAPITAL PARTNERS') and coalesce(aid, {sql_key("name")}) <> '' group by 1, 2"""
)
def facility_owners(t):
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = t("part").select(
        pick(NAMES, k).alias("ORGANIZATION NAME"), pick(OWNERS, k).alias("ORGANIZATION NAME - OWNER"), F.lit("Ann").alias("FIRST NAME - OWNER"), F.lit("Lee").alias("LAST NAME - OWNER"), F.when(k % 3 == 0, z.cast("string")).alias("ASSOCIATE ID - OWNER"),
        pick(ROLES, k).alias("ROLE PLAYED BY OWNER OR MANAGING EMPLOYEE IN FACILITY"), pick(SHARES, z).alias("PERCENTAGE OWNERSHIP"),
    )
    return bulk.owners(rows)


@query("select cast(l_partkey as varchar) as npi, array_to_string(list_sort(list(distinct cast(l_suppkey as varchar))), ';') as groups from lineitem where l_linenumber > 2 group by 1")
def billing_groups(t):
    rows = t("lineitem").select(F.col("l_partkey").cast("string").alias("Individual NPI"), F.when(F.col("l_linenumber") > 2, F.col("l_suppkey").cast("string")).alias("Group PAC ID"), F.lit("g").alias("Group Legal Business Name"))
    return bulk.billing_groups(rows).select("npi", F.array_join("groups", ";").alias("groups"))


@query(
    f"""with e as (select 'c' || c_custkey as uid, 'RN.00' || (100 + c_custkey % 300) as cred, case when c_custkey % 4 = 0 then '1' || c_custkey % 50 end as npi, {sql_key(sql_pick(NAMES, "c_custkey"))} as nk from customer),
    i as (select 'http://x/' || p_partkey % 60 as url, case when p_partkey % 3 = 0 then cast(100 + p_partkey as varchar) end as core, case when p_partkey % 3 = 1 then '1' || p_partkey % 50 end as npi, case when p_partkey % 5 = 0 then {sql_key(sql_pick(NAMES, "p_partkey"))} end as nk from part),
    m as (select uid, url, 0 as r from e join i on i.core = ltrim(regexp_replace(cred, '\\D', '', 'g'), '0') union all select uid, url, 1 from e join i using (npi) union all select uid, url, 2 from e join i on i.nk = e.nk and i.nk <> '')
    select uid, url, ['credential', 'NPI', 'name'][min(r) + 1] as via from m group by 1, 2"""
)
def context_links(t):
    k, p = F.col("c_custkey"), F.col("p_partkey")
    entities = t("customer").select(F.concat(F.lit("c"), k.cast("string")).alias("uid"), F.concat(F.lit("RN.00"), (100 + k % 300).cast("string")).alias("credential"), F.when(k % 4 == 0, F.concat(F.lit("1"), (k % 50).cast("string"))).alias("npi"), pick(NAMES, k).alias("name"))
    items = t("part").select(F.concat(F.lit("http://x/"), (p % 60).cast("string")).alias("url"), F.lit("t").alias("title"), F.lit("2020-01-01").alias("date"), F.lit("news").alias("kind"), F.when(p % 3 == 0, (100 + p).cast("string")).alias("credential"), F.when(p % 3 == 1, F.concat(F.lit("1"), (p % 50).cast("string"))).alias("npi"), F.when(p % 5 == 0, pick(NAMES, p)).alias("name"))
    return bulk.context_links(entities, items).select("uid", "url", "via")


@query("with p as (select p_partkey, string_split(upper(p_name || ' ' || p_type || ' X'), ' ') as have from part where p_partkey % 4 > 0), e as (select distinct p_name, p_type from part), m as (select p_name, p_type, p_partkey from e join p on len(list_filter(string_split(upper(p_type || ' ' || p_name), ' '), lambda x: not list_contains(have, x))) = 0) select p_type || ' ' || p_name as uid, cast(min(p_partkey) as varchar) as npi from m group by 1 having count(distinct p_partkey) = 1")
def provider_crosswalk(t):
    k = F.col("p_partkey")
    name = F.concat_ws(" ", "p_name", "p_type", F.lit("X"))
    providers = t("part").select(k.cast("string").alias("npi"), name.alias("name"), F.when(k % 4 > 0, "wa").otherwise("OR").alias("state"), F.lit("").alias("city"), F.lit("").alias("taxonomy"), F.array(F.lit("1")).alias("licenses"))
    wanted = t("part").select(F.concat_ws(" ", "p_type", "p_name").alias("uid")).distinct().withColumn("name", F.col("uid"))
    return bulk.crosswalk(wanted, providers).select("uid", "npi")


@query(
    """with a as (select *, row_number() over (partition by cast(100000000 + o_custkey % 300 as varchar) order by year(o_orderdate) desc, strftime(o_orderdate, '%Y-%m-%d') desc, 'r' || o_orderkey) as turn from orders), g as (select cast(100000000 + o_custkey % 300 as varchar) as ein, o_orderkey as rid, year(o_orderdate) as y from a where turn = 1),
    f as (select l_orderkey as rid, count(*) as findings, count_if(l_returnflag = 'R') as questioned, count_if(l_linestatus = 'F') as weakness from lineitem where l_linenumber > 1 group by 1), m as (select l_orderkey as rid, round(sum(l_extendedprice), 2) as flagged from lineitem where l_linenumber > 1 group by 1)
    select ein, cast(y as integer) as audit_year, coalesce(findings, 0) as findings, cast(coalesce(questioned, 0) as bigint) as questioned, cast(coalesce(weakness, 0) as bigint) as weakness, case when findings > 0 then coalesce(flagged, 0) else 0 end as flagged from g left join f using (rid) left join m using (rid)"""
)
def single_audits(t):
    rid = F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("report_id")
    general = t("orders").select(rid, (100_000_000 + F.col("o_custkey") % 300).cast("string").alias("ein"), F.year("o_orderdate").alias("audit_year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("accepted"))
    lines = t("lineitem").select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("report_id"), "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice")
    yes = lambda c: F.when(c, " y").otherwise("N")
    found = lines.where("l_linenumber > 1").select("report_id", yes(F.col("l_returnflag") == "R").alias("is_questioned_costs"), yes(F.col("l_linestatus") == "F").alias("is_material_weakness"), F.lit("N").alias("is_modified_opinion"), F.lit("").alias("is_repeat_finding"))
    awards = lines.select("report_id", F.col("l_extendedprice").alias("amount"), F.when(F.col("l_linenumber") > 1, 1).otherwise(0).alias("findings_count"))
    return bulk.audits(general, found, awards).select("ein", "audit_year", "findings", "questioned", "weakness", "flagged")


LICENSES = ["MD.MD.00028366", "LIC 77", "", "0012", "RN00120098"]
VIAS = ["NPI", "name+state", "license #"]


@query(
    f"""with r as (select c_custkey as uid, ltrim(regexp_replace({sql_pick(LICENSES, "c_custkey")}, '\\D', '', 'g'), '0') as own, ltrim(regexp_replace({sql_pick(LICENSES, "c_custkey // 5")}, '\\D', '', 'g'), '0') as other, {sql_pick(VIAS, "c_custkey")} = 'NPI' as npi_hit, 1950 + c_custkey % 4 as birth, case when c_custkey % 3 > 0 then 1950 + c_custkey % 5 end as listed, regexp_replace(upper({sql_pick(CITIES, "c_custkey")}), '[^A-Z]', '', 'g') as a, regexp_replace(upper({sql_pick(CITIES, "c_custkey // 5")}), '[^A-Z]', '', 'g') as b, {sql_profession(sql_pick(TYPES, "c_custkey"))} as p, {sql_profession(sql_pick(TYPES, "c_custkey // 8"))} as q, c_custkey % 10 > 0 as has from customer),
    s as (select *, coalesce(p <> q and not (least(p, q) || '/' || greatest(p, q) in ('PHYSICIAN/STUDENT', 'NURSING/STUDENT', 'PA/STUDENT', 'MIDWIFE/NURSING')), false) as conflict, own <> '' and length(other) >= 3 as both_ from r)
    select uid, case when not has then null when both_ and own = other then 'license-confirmed' when both_ then 'license-mismatch' when npi_hit and listed is not null and birth = listed then 'dob-confirmed' when npi_hit and listed is not null then 'dob-mismatch' when conflict then 'taxonomy-mismatch' when npi_hit then 'exclusion-npi' when a <> '' and a = b then 'city-corroborated' else 'unique-name' end as identity from s"""
)
def identity_grades(t):
    k = F.col("c_custkey")
    rows = t("customer").select(
        k.alias("uid"), pick(LICENSES, k).alias("credential"), F.array(pick(LICENSES, F.floor(k / 5))).alias("licenses"), pick(VIAS, k).alias("via"), (1950 + k % 4).cast("int").alias("birth"), F.when(k % 3 > 0, 1950 + k % 5).cast("int").alias("listed_birth"), pick(CITIES, k).alias("city"), pick(CITIES, F.floor(k / 5)).alias("listed_city"),
        pick(TYPES, k).alias("credential_type"), pick(TYPES, F.floor(k / 8)).alias("taxonomy"), F.when(k % 10 > 0, "1").alias("npi"),
    )
    return rows.select("uid", context_rules.identity_grade(rows).alias("identity"))


LISTED_CODES = ["1128a1", "1128(b)(4)", "", "zz", "1128 c9"]


@query(
    f"""with l as (select case when p_partkey % 5 = 0 then cast(p_partkey as varchar) when p_partkey % 5 = 1 then '0000000000' end as npi, case when p_partkey % 3 = 0 then 'L' || (1000 + p_partkey) end as lic, {sql_key(sql_pick(NAMES, "p_partkey"))} as nk, case when p_partkey % 4 > 0 then 'WA' else '' end as st, {sql_pick(CITIES, "p_partkey")} as city, case when p_partkey % 2 = 0 then 1950 + p_partkey % 3 end as birth, p_partkey as ord from part),
    e as (select c_custkey as uid, cast(c_custkey % 500 as varchar) as npi, case when c_custkey % 2 = 0 then cast(1000 + c_custkey as varchar) end as lic, {sql_key(sql_pick(NAMES, "c_custkey"))} as nk, {sql_pick(CITIES, "c_custkey")} as city, case when c_custkey % 3 > 0 then 1950 + c_custkey % 3 end as birth from customer),
    a as (select npi, min(ord) as ord from l where npi is not null and npi not in ('0000000000', '0', '') group by 1), b as (select substr(lic, 2) as lic, min(ord) as ord from l where lic is not null group by 1), c as (select nk, min(ord) as ord from l where nk <> '' and st = 'WA' group by 1),
    m as (select e.*, a.ord as o1, b.ord as o2, c.ord as o3, l.city as lcity, l.birth as lbirth from e left join a using (npi) left join b using (lic) left join c using (nk) left join l on l.ord = c.ord)
    select uid, case when o1 is not null then 'NPI' when o2 is not null then 'license #' else 'name+state' end as via, case when coalesce(o1, o2) is not null then 'definitive' when (birth = lbirth) or (regexp_replace(upper(city), '[^A-Z]', '', 'g') <> '' and regexp_replace(upper(city), '[^A-Z]', '', 'g') = regexp_replace(upper(lcity), '[^A-Z]', '', 'g')) then 'corroborated' else 'name-only' end as confidence
    from m where coalesce(o1, o2, o3) is not null and not (o1 is null and o2 is null and coalesce(birth <> lbirth, false))"""
)
def screened_matches(t):
    k, p = F.col("c_custkey"), F.col("p_partkey")
    made = t("part").select(
        F.when(p % 5 == 0, p.cast("string")).when(p % 5 == 1, "0000000000").alias("NPI"), F.when(p % 3 == 0, F.concat(F.lit("L"), (1000 + p).cast("string"))).alias("license"), pick(NAMES, p).alias("name"), F.when(p % 4 > 0, "wa").otherwise("").alias("state"), pick(CITIES, p).alias("city"), F.when(p % 2 == 0, 1950 + p % 3).cast("int").alias("birth"), F.lpad(p.cast("string"), 9, "0").alias("date"),
    )
    c = F.col
    listed = screening.merged(screening._listed(made, "l", npi=screening.npi(c("NPI")), license=F.coalesce("license", F.lit("")), name=c("name"), state=c("state"), city=c("city"), birth=c("birth"), date=c("date")))
    entities = t("customer").select(k.alias("uid"), (k % 500).cast("string").alias("npi"), F.when(k % 2 == 0, (1000 + k).cast("string")).alias("license"), pick(NAMES, k).alias("name"), F.lit("WA").alias("state"), pick(CITIES, k).alias("city"), F.lit("").alias("entity_type"), F.when(k % 3 > 0, (1950 + k % 3).cast("string")).alias("birthyear"))
    return screening.matched(entities, listed).select("uid", "via", "confidence")


@query("with e as (select c_custkey as uid, upper(trim(regexp_replace(" + sql_pick(NAMES, "c_custkey") + ", '\\s+', ' ', 'g'))) as vendor, 4000.0 + 1000 * (c_custkey % 5) + 0.5 as amount from customer), s as (select vendor, amount from e where amount >= 5000 group by 1, 2 having count(distinct uid) >= 2) select uid as entity_uid, 'contract_duplicate_amount_vendor' as rule_id, 14.0::double as severity from e join s using (vendor, amount)")
def duplicate_contracts(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.alias("uid"), pick(NAMES, k).alias("name"), (4000.0 + 1000 * (k % 5) + 0.5).alias("amount"))
    return rules.duplicate_contracts(rows).select("entity_uid", "rule_id", "severity")


@query(f"with {ORDER_FLAGS}, {ORDER_PAYMENTS} select 'rule' as kind, rule as label, count(*) as n, 0.0::double as amount from f group by 2 union all select 'program', program, count(*), round(sum(amount), 2) from p group by 2 union all select 'combination', label, count(*), 0.0::double from (select string_agg(s, ' + ' order by s) as label from (select distinct o_custkey, o_orderpriority as s from orders) group by o_custkey) group by 2")
def run_summary(t):
    members = t("orders").select(F.col("o_custkey").alias("operator_id"), F.col("o_orderpriority").alias("source"))
    return payments.run_summary(order_flags(t), order_payments(t), members)


@query(
    f"""with {ORDER_FLAGS}, s as (select uid, cast(count(*) * 7 as double) as score from f group by 1), e as (select 'c' || c_custkey as uid, c_mktsegment as source from customer), g as (select 'c' || c_custkey as uid, case when c_custkey % 3 = 0 then 'reviewing' when c_custkey % 3 = 1 then '' end as state, c_custkey % 5 = 0 as watched from customer)
    select 'entities' as kind, source as label, count(*) as n from e group by 2 union all select 'flagged', source, count(*) from s join e using (uid) group by 2 union all select 'rule', rule, count(*) from f group by 2 union all select 'triage', state, count(*) from g where state <> '' group by 2 union all select 'triage', 'watched', count(*) from g where watched having count(*) > 0
    union all select 'story', 'untriaged_high', count(*) from s where score >= 40 and uid not in (select uid from g where state <> '') having count(*) > 0 union all select 'story', 'after_bar', count(*) from f where rule = 'paid_after_barred' having count(*) > 0"""
)
def dashboard_summary(t):
    k = F.col("c_custkey")
    flags, uid = order_flags(t), F.concat(F.lit("c"), k.cast("string"))
    scored = flags.groupBy("entity_uid").agg((F.count("*") * 7).cast("double").alias("risk_score"))
    triage = t("customer").select(uid.alias("uid"), F.when(k % 3 == 0, "reviewing").when(k % 3 == 1, "").alias("state"), (k % 5 == 0).alias("watched"))
    return serve.summary(t("customer").select(uid.alias("uid"), F.col("c_mktsegment").alias("source")), scored, flags, triage)


@query(
    f"""with {ORDER_FLAGS}, {ORDER_PAYMENTS} select 'funds' as kind, 'all' as label, count(*) as n, round(coalesce(sum(amount), 0), 2) as amount from p union all select 'program', program, count(*), round(sum(amount), 2) from p group by 2
    union all (select 'fiscal', period, count(*), round(sum(amount), 2) from p where starts_with(program, 'WA state') and regexp_matches(period, '^FY[0-9]{{4}}$') group by 2 order by period desc limit 1)
    union all select 'story', 'after_bar', count(*), round_even(coalesce(sum(after), 0), 0) from f where rule = 'paid_after_barred' union all select 'story', 'complaints', count(*), 0.0::double from f where rule = 'civil_monetary_penalty'
    union all select 'ingest', o_orderpriority || ' @ ' || max(cast(o_orderdate as date)), count(*), 0.0::double from orders group by o_orderpriority"""
)
def dashboard_money(t):
    rule = F.col("rule_id")
    flags = order_flags(t).withColumn("rule_id", F.when(rule == "civil_monetary_penalty", "childcare_valid_complaint").otherwise(rule))
    runs = t("orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").cast("string").alias("ran_at"))
    return serve.money_summary(order_payments(t), flags, runs)


@query(f"with n as (select c_custkey as uid, c_name as name, {sql_key('c_name')} as nk from customer where c_acctbal >= 2000), h as (select o_orderkey as url, 'Owner of <b>' || o_orderpriority || '</b> and Customer#' || lpad(cast(o_custkey as varchar), 9, '0') || ' pleads guilty' as title from orders) select uid, 'http://n/' || url as url from n join (select url, {sql_key("regexp_replace(title, '<[^>]+>', ' ', 'g')")} as title from h) on length(nk) >= 10 and contains(title, nk)")
def headline_matches(t):
    key = F.col("o_orderkey")
    title = F.concat(F.lit("Owner of <b>"), "o_orderpriority", F.lit("</b> and Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" pleads guilty"))
    items = t("orders").select(F.concat(F.lit("http://n/"), key.cast("string")).alias("url"), title.alias("title"))
    scored = t("customer").select(F.col("c_custkey").alias("entity_uid"), (F.col("c_acctbal") / 100).alias("risk_score"))
    return bulk.headline_matches(t("customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name")), items, scored)


@query("with w as (select item_id, string_split(text, ' ') as w from benchmark), n as (select item_id, w[1] || ' ' || w[2] as needle from w where len(w) > 1 union all select -1 - item_id, w[1] from w) select distinct doc_id as uid, item_id from documents join n on needle <> '' and contains(text, needle)")
def short_needles(t):
    w, item = F.split("text", " "), F.col("item_id").cast("long")
    two = t("benchmark").where(F.size(w) > 1).select(item.alias("item_id"), F.concat_ws(" ", w[0], w[1]).alias("needle"))
    return linkage.containing(t("documents").select(F.col("doc_id").alias("uid"), "text"), two.unionByName(t("benchmark").select((-1 - item).alias("item_id"), w[0].alias("needle"))))


@query("""with c as (select 'c' || c_custkey as uid, c_name as name, cast(c_custkey as varchar) as source_id, n_name as city, c_mktsegment as segment, c_acctbal as risk_score from customer join nation on c_nationkey = n_nationkey), r as (select *, 0 as x from c where contains(lower(concat_ws(chr(10), name, source_id, city, segment)), 'mobi') or contains(lower(name), '0012'))
 select q as text, uid, rank from (select 'MoBi' as q, uid, row_number() over (order by risk_score desc, uid) as rank from c where contains(lower(name), 'mobi') or contains(lower(source_id), 'mobi') or contains(lower(city), 'mobi') or contains(lower(segment), 'mobi') union all select '0012', uid, row_number() over (order by risk_score desc, uid) from c where contains(lower(name), '0012') or contains(source_id, '0012') or contains(city, '0012') union all select '1', uid, row_number() over (order by risk_score desc, uid) from c where contains(lower(name), '1') or contains(source_id, '1') or contains(city, '1') union all select 'ON_1', uid, row_number() over (order by risk_score desc, uid) from c where contains(lower(city), 'on_1')) where rank <= 10""")
def search_all(t):
    k = F.col("c_custkey")
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    entities = rows.select(F.concat(F.lit("c"), k.cast("string")).alias("uid"), F.col("c_name").alias("name"), k.cast("string").alias("source_id"), F.col("n_name").alias("city"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("raw"))
    scored = rows.select(F.concat(F.lit("c"), k.cast("string")).alias("entity_uid"), F.col("c_acctbal").alias("risk_score"))
    index, out = serve.search_index(entities), None
    for text in ("MoBi", "0012", "1", "ON_1"):
        found = serve.search_all(entities.withColumn("source", F.lit("x")), scored, text, index=index).withColumn("text", F.lit(text))
        found = found.select("text", "uid", F.row_number().over(Window.partitionBy("text").orderBy(F.desc_nulls_last("risk_score"), "uid")).cast("long").alias("rank"))
        out = found if out is None else out.unionByName(found)
    return out

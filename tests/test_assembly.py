"""Names, shared addresses and the assembly of operators on hand-made entities."""

import pytest
from pyspark.sql import functions as F

from registrum.functions import names as N
from registrum.functions import text as T
from registrum.operators import assembly, resolve, rules, serve
from registrum.sources import bulk

ENTITY = "uid string, source string, source_id string, name string, dba string, address string, city string, zip string, status string, amount double, raw map<string,string>"


def entity(uid, source="childcare", name="", dba="", address="", city="Seattle", status="Active", amount=None, **raw):
    return (uid, source, uid.lstrip("e"), name, dba, address, city, "98101", status, amount, raw)


@pytest.mark.parametrize(
    ("name", "brand"),
    [
        ("Quillback Kids of Tacoma", "QUILLBACK"), ("Marrow & Finch Kindergarten", "MARROW FINCH"), ("XII DOLPHINS 3", "DOLPHINS"), ("Mt Tolmie Otters", "MOUNT TOLMIE"), ("Otters of St Brannoc", "OTTERS"), ("At Ermine Burrow", "ERMINE BURROW"),
        ("Kids Academy Center", ""), ("Of Voles Inc", "VOLES"), ("Elk", ""), (None, ""), ("Harbor Seal Limited", "HARBOR SEAL"), ("Brannoc LLC Ermine St", "BRANNOC ERMINE"),
    ],
)
def test_brands(spark, name, brand):
    assert spark.createDataFrame([(name,)], "n string").select(N.brand_key(F.col("n"))).first()[0] == brand


def test_predicates(spark):
    rows = spark.createDataFrame([("Tidepool Playroom", "desk@us.army.MIL"), ("Fernhollow on College Street, LLC", None), ("Acme University", ""), ("City of Kent Nursing College", None), ("Plain Care", "x@y.com"), (None, None)], "n string, m string")
    got = [(r.a, r.b) for r in rows.select(N.institution(F.col("n"), F.col("m")).alias("a"), N.venue(F.col("n")).alias("b")).collect()]
    assert got == [(True, False), (False, True), (True, True), (True, True), (False, False), (False, False)]
    rows = spark.createDataFrame([("Dentist", "Emergency Medicine"), ("Physician Assistant", "Physician"), ("Medical Student", "Physician"), ("Independent Social Worker", "Counselor"), ("Barber", "Dentist")], "a string, b string")
    assert [r[0] for r in rows.select(N.professions_conflict(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]
    days = spark.createDataFrame([("20240131",), ("1/5/2020",), ("31-JAN-2021",), ("2020-02-30",), ("19700101",), (None,)], "d string")
    assert [r[0] for r in days.select(T.iso_day(F.col("d"))).collect()] == ["2024-01-31", "2020-01-05", "2021-01-31", "", "", ""]


def test_rules_read_their_texts(spark):
    rows = [("1", "SURRENDER", "POST OFFICE BOX 9", {}), ("2", "Summary Suspension", "1 Main, PO Box 4", {}), ("3", "voluntary surrender", "MAILBOX 3", {}), ("4", "revoked", "Regus 9", {"five_star": "Not Available", "overall_rating": "2", "_ownership": "Non-Profit"}), ("5", "Active", "9 Boxwood", {"_ownership": "For-Profit"})]
    e = spark.createDataFrame([(f"s:{i}", s, a, 1.0, 1.0, None, r) for i, s, a, r in rows], "uid string, status string, address string, lat double, lon double, amount double, raw map<string,string>")
    got = {(r.entity_uid[2:], r.rule_id) for r in rules.simple_flags(e, "2020-01-01").collect() if r.rule_id not in ("capacity_missing_or_zero", "missing_contact_info")}
    assert got == {("1", "credential_surrendered"), ("1", "po_box_address"), ("3", "credential_surrendered"), ("3", "commercial_mailbox"), ("4", "credential_revoked_or_suspended"), ("4", "virtual_office"), ("4", "low_quality_rating"), ("5", "for_profit_ownership")}
    named = spark.createDataFrame([("a", "Bright Acadmy"), ("b", "Bright Academy"), ("c", None)], "uid string, name string")
    flag = rules.misspelled_names(named).collect()
    assert [(f.entity_uid, f.severity) for f in flag] == [("a", 8.0)] and "'Acadmy' → 'Academy'" in flag[0].explanation


def test_shared_addresses(spark):
    at = {"address": "1 Main St"}
    rows = [entity("e1", name="Acme Care", **at), entity("e2", name="Beta House Kids", **at), entity("e3", name="Gamma Tots", **at)]
    rows += [entity(f"f{k}", name=f"Marrow & Finch Site {k}", address="2 Elm", city="Kent") for k in range(2)] + [entity("f9", name="Zed Quilts", address="2 Elm", city="Kent")]
    rows += [entity("g1", name="Tiny Tots", address="3 Oak"), entity("g2", name="Saint Mark Church", address="3 Oak")]
    got = {r.uid: (r.severity, r.providers, r.brand) for r in rules.shared_addresses(spark.createDataFrame(rows, ENTITY)).collect()}
    assert {u: got[u] for u in ("e1", "e2", "e3")} == dict.fromkeys(("e1", "e2", "e3"), (24.0, 3, None)) and got["f0"] == (24.0, 3, None) and "g1" not in got
    only = spark.createDataFrame([entity("h1", name="Lantern Extended Care", address="4 Fir"), entity("h2", name="Lantern", address="4 Fir"), entity("h3", name="Lantern Prime", address="4 Fir")], ENTITY)
    assert {r.uid: (r.severity, r.brand) for r in rules.shared_addresses(only).collect()} == {f"h{k}": (8.4, "LANTERN") for k in (1, 2, 3)}


def test_operators_are_assembled(spark):
    rows = [
        entity("e1", name="Sunny Valley Tots", address="12 Main Street", primarycontactpersonname="Nora Castellan", primarycontactemail="nora@x.org", licenseeffectivedate="2015-01-01"),
        entity("e2", name="Harbor Quilts", address="12 MAIN ST"), entity("e3", "healthcare", "Nora Castellan", status="Revoked", birthyear="1970", expirationdate="2023-01-01"),
        entity("e4", "contracts", "Alder Park", dba="Riverbend Lodge Care", amount=9_000.0, procurement_type="Sole source"), entity("e5", "hospice", "Riverbend Lodge Care - 02"), entity("e6", "contracts_2024", "Alder Park", dba="Riverbend Lodge Care", amount=9_500.0),
        entity("e7", name="Lonely Star"), entity("e8", "contracts", "Paper Mills", amount=5.0, procurement_type="Data Sharing"), entity("e9", "hospice", "Paper Mills"),
    ]
    rows[5] = (*rows[5][:2], "00" + rows[3][2], *rows[5][3:])  # the same contract, a year later, with zeros before its number
    e = spark.createDataFrame(rows, ENTITY)
    none = spark.createDataFrame([], "a string, b string")
    members, found = assembly.assembled(e, assembly.match_keys(e), none, none, spark.createDataFrame([], "uid string"), "2024-06-01")
    of = {r.uid: r.root for r in members.collect()}
    assert of["e1"] == of["e2"] == of["e3"] and "e4" not in of and of["e8"] == of["e9"]
    got = {r.root: r for r in found.collect()}
    care, paper, lone = got[of["e1"]], got[of["e8"]], got[of["e7"]]
    # two programs (10) and one address (18), three tenths without evidence; the bridge by name, halved for the mail address
    assert (care.surfaces, care.strongest_link, care.bonus) == (True, "address", 8.0 + 12.0) and care.programs == ["childcare", "healthcare"]
    assert (paper.surfaces, paper.cross_program, paper.bonus) == (False, False, 0.0) and not lone.surfaces
    rolled = members.join(found.where("surfaces").select("root", "bonus"), "root").withColumns({"person": F.col("uid"), "score": F.lit(40.0), "funds": F.lit(0.0), "barred": F.col("source") == "healthcare", "sanctioned": F.lit(False), "contradiction": F.lit(0.0)})
    scored = resolve.scored(resolve.rollup(rolled).join(found.select("root", "bonus"), "root"), F.col("bonus")).collect()
    assert [r.score for r in scored if r.root == of["e1"]] == [35.0]  # the name alone counts 15 at most


def test_documented_and_hard_links(spark):
    rows = [entity("e1", "contracts", "Alder Park", dba="Riverbend Lodge Care", amount=9_000.0), entity("e2", "hospice", "Riverbend Lodge Care - 02"), entity("e3", "hospice", "Other Brand"), entity("e4", "hospice", "Third Brand")]
    e = spark.createDataFrame(rows, ENTITY)
    members = e.withColumn("root", F.lit("r"))
    assert [r.root for r in assembly.documented(members).collect()] == ["r"]
    registry = spark.createDataFrame([("Other Brand LLC", "601", "Law Agents Inc", ["Jo Roe", "X"]), ("Third Brand", "602", "Law Agents", ["Jo Roe"]), ("Third Brand", "603", "Later", [])], "name string, ubi string, agent string, governors array<string>")
    keys = assembly.registry_keys(e, registry)
    assert {(r.uid, r.key) for r in keys.collect()} == {("e3", "ubi:601"), ("e3", "agent:LAW AGENTS"), ("e3", "gov:JO ROE"), ("e4", "ubi:602"), ("e4", "agent:LAW AGENTS"), ("e4", "gov:JO ROE")}
    assert [(r.ubi, r.agent, r.gov, r.owner, r.bonus) for r in assembly.identity_signals(members, keys).collect()] == [(False, True, True, False, 26)]
    owned = spark.createDataFrame([("OTHER BRAND", "aid:1"), ("THIRD BRAND", "aid:1")], "org string, owner string")
    assert {r.key for r in assembly.owner_keys(e, owned).collect()} == {"owner:aid:1"}
    held, by = bulk.owner_networks(owned.withColumn("owner_name", F.lit("X")))
    assert [tuple(r) for r in held.collect()] == [("aid:1", "X", ["OTHER BRAND", "THIRD BRAND"])] and {(r.org, *r.owners) for r in by.collect()} == {("OTHER BRAND", "aid:1"), ("THIRD BRAND", "aid:1")}
    chains = assembly.franchises(spark.createDataFrame([entity(f"k{i}", name=f"Quillback Kids of City{i}", primarycontactpersonname=f"Person {'ABC'[i % 3]}")  for i in range(10)], ENTITY))
    assert [r.brand for r in chains.collect()] == ["QUILLBACK"]


def test_queue_orders(spark):
    e = spark.createDataFrame([("a", "A", 5.0, 0.0, "D"), ("b", "B", 1.0, 2_000.0, "A"), ("c", "C", 900.0, 10.0, "C")], "uid string, name string, funds double, funds_after double, grade string")
    scored = spark.createDataFrame([("a", 90.0, 1, 1), ("b", 40.0, 1, 1), ("c", 90.0, 1, 1)], "entity_uid string, risk_score double, family_count long, flag_count long")
    triage = spark.createDataFrame([("a", "reviewed", True)], "uid string, state string, watched boolean")
    order = lambda **by: [r.uid for r in serve.review_queue(e, scored, triage, serve.predicates(**by.pop("where", {})), **by).collect()]
    assert order() == ["b", "c", "a"] and order(order="grade") == ["b", "c", "a"] and order(order="funds") == ["c", "a", "b"] and order(order="after") == ["b", "c", "a"]
    assert order(where={"triage": "watched"}) == ["a"] and order(where={"triage": "open"}) == ["b", "c"] and order(where={"least": 50}) == ["c", "a"]
    leads = spark.createDataFrame([("a", 30.0, ""), ("b", 30.0, "reviewed"), ("c", 80.0, None), ("d", 24.0, None)], "uid string, score double, state string")
    assert [r.uid for r in serve.random_lead(leads, 7).collect()] == ["a"]

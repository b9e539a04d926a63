"""Tiny fixtures per operator, in the manner of the rules' own definitions."""

import zipfile

from pyspark.sql import functions as F

from registrum.functions import names as N
from registrum.functions import text as T
from registrum.operators import bars, graph, linkage, money, resolve, rules, scoring, serve
from registrum.sources import readers, store
from registrum.streaming.ingest import compacted, current, ingest


def value(spark, column, **row):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], names).select(column.alias("v")).first().v


def test_normalizers(spark):
    a, b = F.col("a"), F.col("b")
    assert value(spark, T.name_key(a), a="The  Acme Care, P.L.L.C.") == "ACME CARE"
    assert value(spark, T.money(a), a="$ 100,000.00") == 100000.0 and value(spark, T.money(a), a="n/a") is None
    assert value(spark, T.number(a), a="NULL") is None and value(spark, T.number(a), a=" 4.5 ") == 4.5
    assert value(spark, T.phone(a), a="1 (206) 555-0100") == "2065550100" and value(spark, T.phone(a), a="555") is None
    assert value(spark, T.license_core(a), a="AA00060123") == "60123"
    assert str(value(spark, T.day(a), a="01/31/2020")) == "2020-01-31" and value(spark, T.day(a), a="soon") is None
    assert value(spark, T.year(a), a="FY2026") == 2026 and value(spark, T.years(a), a="1999 to 2004-2021") == [2004, 2021]
    assert value(spark, T.address_key(a), a="12 north Main street") == "12 N MAIN ST" and value(spark, T.address_key(a), a="Main street") is None
    assert value(spark, T.person_key(a), a="Zed Q. Alpha") == "ALPHA ZED"
    assert value(spark, N.brand_key(a), a="Sunrise Valley Home Care of Yakima") == "SUNRISE VALLEY"
    assert value(spark, T.one_edit(a, b), a="recieve", b="receive") and value(spark, T.one_edit(a, b), a="cats", b="cat") and not value(spark, T.one_edit(a, b), a="abc", b="cba")
    assert abs(value(spark, T.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), a="x") - 111194.93) < 1
    assert value(spark, T.plain_html(a), a="<p>a &amp; <b>b</b></p>") == "a & b"


def test_rules(spark):
    rows = spark.createDataFrame([("1", "Active", "2000-01-01", "0", "PO Box 7"), ("2", "ACTIVE", "2999-01-01", "9", "1 Main"), ("3", "Closed", "2000-01-01", None, None)], "id string, status string, licenseexpirationdate string, licensecapacity string, street string")
    e = readers.entities(rows, "s", {"source_id": "id", "status": "status", "address": "street"})
    got = {(r.entity_uid, r.rule_id) for r in rules.simple_flags(e, "2020-01-01").collect()}
    assert {("s:1", "license_expired_active"), ("s:1", "capacity_missing_or_zero"), ("s:1", "po_box_address")} <= got
    assert not [x for x in got if x[0] == "s:3"] and ("s:2", "license_expired_active") not in got
    assert rules.simple_flags(e.limit(0), "2020-01-01").collect() == []


def test_scores(spark):
    flags = spark.createDataFrame([("u", "credential_revoked_or_suspended", 30.0), ("u", "disciplinary_action_taken", 22.0), ("u", "po_box_address", 10.0), ("v", "billing_spike", 130.0)], "entity_uid string, rule_id string, severity double")
    got = {r.entity_uid: r for r in scoring.scores(flags).collect()}
    assert (got["u"].risk_score, got["u"].flag_count, got["u"].family_count, got["u"].top_rule) == (40.0, 3, 2, "credential_revoked_or_suspended") and got["v"].risk_score == 100.0
    half = scoring.suppressed(scoring.scores(flags), spark.createDataFrame([("u",), ("u",)], "entity_uid string"))
    assert {r.entity_uid: r.risk_score for r in half.collect()} == {"u": 20.0, "v": 100.0}


def test_nearest_rank_and_spikes(spark):
    rows = spark.createDataFrame([("p", float(v)) for v in range(1, 22)], "program string, total double")
    assert money.nearest_rank(rows, "program", "total", 0.95).first().at_rank == 20.0
    yearly = spark.createDataFrame([("a", 2020, 10_000.0), ("a", 2021, 40_000.0), ("b", 2019, 90_000.0), ("b", 2020, 10_000.0), ("b", 2021, 40_000.0), ("c", 2021, 50_000.0)], "uid string, period int, amount double")
    assert sorted(r.uid for r in money.spikes(yearly).collect()) == ["a", "b"]  # three years are no falling history
    falling = spark.createDataFrame([("f", 2018 + k, v) for k, v in enumerate((90_000.0, 80_000.0, 10_000.0, 40_000.0))] + [("g", 2018 + k, v) for k, v in enumerate((80_000.0, 90_000.0, 10_000.0, 40_000.0))] + [("h", 2018 + k, v) for k, v in enumerate((90_000.0, 70_000.0, 80_000.0, 10_000.0, 40_000.0))], "uid string, period int, amount double")
    assert sorted(r.uid for r in money.spikes(falling).collect()) == ["g", "h"]
    values = [(float(v),) for v in (-3, -3, 0, 0, 1, 1, 2, 5, 5, 5, 8, 1000, 1001)]
    ranks = {r.v: (r.n, r.below, r.size) for r in money.ranked(spark.createDataFrame(values, "v double"), None, "v").collect()}
    assert ranks == {v: (values.count((v,)), sum(x < v for (x,) in values), 13) for (v,) in values}


def test_contiguous_years_after_a_date(spark):
    yearly = spark.createDataFrame([("a", y, 1.0) for y in (2015, 2018, 2019, 2020)] + [("b", y, 1.0) for y in (2019, 2020, 2021)] + [("c", y, 1.0) for y in (2018, 2020, 2021)], "uid string, period int, amount double")
    assert [r.uid for r in money.contiguous(yearly).collect()] == ["b"]
    bars_ = spark.createDataFrame([("a", 2016), ("b", 2016), ("c", 2017)], "uid string, year int")
    assert [(r.uid, r.first, r.last) for r in money.contiguous(yearly, since=bars_).collect()] == [("a", 2018, 2020)]


def test_dated_bars(spark):
    people = [("after", "REVOKED", "license-confirmed", None, None), ("small", "REVOKED", "license-confirmed", None, None), ("before", "REVOKED", "license-confirmed", None, None), ("other", "SUSPENDED", "license-mismatch", 2015, None), ("same", "SUSPENDED", "dob-confirmed", 2020, None), ("again", "REVOKED", "dob-confirmed", 2015, 2019), ("fine", "ACTIVE", "dob-confirmed", 2015, None), ("scope", "REVOKED", "dob-confirmed", None, None)]
    e = spark.createDataFrame(people, "uid string, status string, identity string, expiry_year int, reissue_year int")
    facts = spark.createDataFrame([("after", "Medicare", 2021, 472_000.0), ("small", "Medicare", 2021, 233.0), ("before", "Medicare", 2018, 9_000.0), ("other", "Medicare", 2021, 5_000.0), ("same", "Medicare", 2020, 5_000.0), ("again", "Medicare", 2021, 5_000.0), ("fine", "Medicare", 2021, 5_000.0), ("scope", "Medicare", 2021, 5_000.0)], "uid string, program string, year int, amount double")
    listed = spark.createDataFrame([(u, "l", 2019, "") for u in ("after", "small", "before")] + [("scope", "m", 2019, "medicaid")], "uid string, list string, bar_year int, scope string")
    got = {r.uid: (r.rule_id, r.severity) for r in bars.dispositions(e, facts, listed, 2022).collect()}
    assert got["after"] == ("paid_after_barred", 50.0) and got["before"][0] == "paid_before_bar" and got["other"] == ("paid_attribution_unconfirmed", 8.0)
    assert got["same"][0] == "paid_before_bar" and got["small"] == ("paid_after_barred", 22.0) and got["again"][0] == "paid_while_sanctioned" and got["scope"] == ("paid_while_sanctioned", 18.0) and "fine" not in got
    early = {r.uid: r for r in bars.dispositions(e, facts.where("year = 2020"), listed, 2020).collect()}  # money of the bar's year, and data that end there: nothing is known
    assert early["same"].rule_id == "paid_while_sanctioned" and early["same"].same_amount == 5_000.0


def test_identity(spark):
    grade = bars.identity_grade(F.col("core"), F.col("cores"), F.col("b1"), F.col("b2"), F.col("npi") == 1, F.col("c1"), F.col("c2"))
    base = {"core": "", "cores": [], "b1": 0, "b2": 0, "npi": 0, "c1": "", "c2": "X"}
    assert value(spark, grade, **base | {"core": "12", "cores": ["12", "3"]}) == "license-confirmed" and value(spark, grade, **base | {"core": "12", "cores": ["3"]}) == "license-mismatch"
    assert value(spark, grade, **base | {"npi": 1, "b1": 1950, "b2": 1950}) == "dob-confirmed" and value(spark, grade, **base | {"c1": "X"}) == "city-match" and value(spark, grade, **base) == "name-only"


def test_links(spark):
    left = spark.createDataFrame([("a", "1", "x"), ("b", None, "y"), ("c", "9", "z")], "uid string, npi string, name string")
    listed = spark.createDataFrame([("1", "q", 1), ("1", "r", 0), (None, "y", 2)], "npi string, name string, ord int")
    got = {r.uid: (r.tier, r.hit and r.hit.ord) for r in linkage.cascade(left, listed, [("npi", ["npi"]), ("name", ["name"])], "ord").collect()}
    assert got == {"a": ("npi", 0), "b": ("name", 2), "c": (None, None)}
    keys = spark.createDataFrame([(f"u{i}", "big") for i in range(11)] + [("u0", "k"), ("u1", "k"), ("u1", "m"), ("u2", "m"), ("z", "n")], "uid string, key string")
    assert {(r.node, r.root) for r in graph.components(graph.key_edges(keys)).collect()} == {("u0", "u0"), ("u1", "u0"), ("u2", "u0")}
    points = spark.createDataFrame([(1, 47.0, -122.0), (2, 47.0003, -122.0), (3, 47.1, -122.0), (4, 0.0, 0.0), (5, 0.0, 0.0), (6, None, 1.0)], "uid long, lat double, lon double")
    assert [(r.a, r.b) for r in graph.geo_pairs(points).collect()] == [(1, 2)]
    step = 45 / (111_320 * 0.6756)
    near = spark.createDataFrame([(k, 47.5, -122.3 - k * step) for k in range(4)], "uid long, lat double, lon double")  # 45 m apart, west to east
    assert sorted((r.a, r.b) for r in graph.geo_pairs(near).collect()) == [(0, 1), (1, 2), (2, 3)]
    names = spark.createDataFrame([("acme care", "care acme"), ("acme care", "acme cars")], "a string, b string").select(linkage.ratio("a", "b").alias("r")).collect()
    assert names[0].r == 1.0 and 0.8 < names[1].r < 1.0


def test_operator_scores(spark):
    schema = "root string, uid string, source string, name string, person string, score double, funds double, barred boolean, sanctioned boolean, contradiction double"
    rows = [("r", "a", "s1", "A", "p", 40.0, 10.0, True, True, 5.0), ("r", "b", "s2", "B", "p", 20.0, 0.0, True, False, 0.0)]
    rows += [("n", "c", "healthcare", "Jane Roe", "q", 80.0, 0.0, True, True, 0.0), ("n", "d", "childcare", "Day Care", "d", 5.0, 0.0, False, False, 0.0)]
    got = {r.root: r for r in resolve.scored(resolve.rollup(spark.createDataFrame(rows, schema))).collect()}
    r = got["r"]
    assert (r.barred_people, r.sources, r["name"], r.verified, r.score) == (1, 2, "A", 1, 85.0) and r.operator_id.startswith("op:") and len(r.operator_id) == 15
    assert (got["n"].score, got["n"].verified, got["n"]["name"]) == (15.0, 0, "Day Care")


def test_changes(spark):
    schema = "uid string, score double, funds double, status string"
    now = spark.createDataFrame([("a", 50.0, 0.0, "x"), ("b", 50.0, 0.0, "y"), ("c", 20.0, 30_000.0, "x"), ("d", 60.0, 0.0, "x"), ("e", 5.0, 0.0, "x")], schema)
    old = spark.createDataFrame([("a", 30.0, 0.0, "x"), ("b", 50.0, 0.0, "x"), ("c", 20.0, 1_000.0, "x"), ("e", 5.0, 0.0, "x")], schema)
    assert {r.uid: r.kind for r in serve.changes(now, old).collect()} == {"a": "risk", "b": "status", "c": "funds", "d": "new"}
    many = spark.createDataFrame([("a", 90.0, 99_000.0, "z"), ("f", 10.0, 0.0, "x"), ("g", 10.0, 0.0, "x")], schema)
    was = spark.createDataFrame([("a", 30.0, 0.0, "x"), ("f", 60.0, 0.0, "x"), ("g", 10.0, 0.0, "")], schema)
    assert sorted(r.kind for r in serve.changes(many, was).collect()) == ["funds", "risk", "status"]  # all kinds of a uid; no fall, no first status
    triage = spark.createDataFrame([("c", True)], "uid string, watched boolean")
    assert [(r.uid, r.kind) for r in serve.changes(now, old, triage=triage, limit=3).collect()] == [("c", "funds"), ("b", "status"), ("a", "risk")]


def test_store(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "uid string, a int, b string"
    store.upsert(spark.createDataFrame([("x", 1, "p"), ("y", 2, "q")], schema), path, "uid")
    store.upsert(spark.createDataFrame([("x", 9, None), ("z", None, "r")], schema), path, "uid", partial=True, defaults={"a": 0})
    assert sorted(tuple(r) for r in store.read(spark, path).collect()) == [("x", 9, "p"), ("y", 2, "q"), ("z", 0, "r")]
    store.append_new(spark.createDataFrame([("x", 5, "s"), ("w", 5, "s"), ("w", 5, "s")], schema), path, ["uid"])
    assert store.read(spark, path).count() == 4
    runs = f"{tmp_path}/runs"
    for day in range(1, 9):
        store.snapshot(spark.createDataFrame([("x", day)], "uid string, score int"), runs, f"2024-01-0{day}")
    assert {r.score for r in store.read(spark, runs).collect()} == {3, 4, 5, 6, 7, 8}


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Business Name,UBI #,Governors,Extra\nAcme,1,A One; B Two,x\n,2,,\n")
    rows = readers.csv(spark, f"{tmp_path}/r.csv", {"name": ["business name"], "ubi": ["ubi"], "officers": ["governor"], "none": ["zzz"]})
    assert [tuple(r) for r in rows.collect()] == [("Acme", "1", "A One; B Two", ""), ("", "2", "", "")]
    assert rows.select(readers.officers(F.col("officers")).alias("o")).first().o == ["A One", "B Two"]
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    assert [r.cells for r in readers.xlsx(spark, f"{tmp_path}/b.xlsx").orderBy("row").collect()] == [["shared", "", "3"], ["", "in"]]
    text = "The board revoked Jane A. Roe (AB12345678) and John Doe (CD123456)."
    found = value(spark, readers.named_entries(F.col("a")), a=text)
    assert [x.credential for x in found] == ["AB12345678", "CD123456"] and found[1]["name"] == "John Doe"
    page = '<div class="tab-pane" id="complaints"><td>No complaints available</td></div><div class="tab-pane" id="inspections"><td>1/2/2020</td><td>3/4/2021</td></div>'
    assert (value(spark, readers.pane_dates(F.col("a"), "complaints"), a=page), value(spark, readers.pane_dates(F.col("a"), "inspections"), a=page)) == (0, 2)
    assert len(value(spark, readers.license_rows(F.col("a")), a='{"x":1},{"x":2}')) == 2
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Fraud plea</title><link>u</link></item><item><title>Other</title></item></channel></rss>")
    assert readers.feed(spark, f"{tmp_path}/f.xml", ["fraud"]).count() == 1


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, line in (("1.json", '{"uid":"a","n":1}'), ("2.json", '{"uid":"b","n":2}')):
        (tmp_path / "in" / name).write_text(line)
    args = (spark, f"{tmp_path}/in", "uid string, n long", f"{tmp_path}/t", f"{tmp_path}/c")
    ingest(*args).awaitTermination(60)
    (tmp_path / "in" / "3.json").write_text('{"uid":"a","n":7}')
    ingest(*args).awaitTermination(60)
    assert sorted(tuple(r) for r in current(spark, f"{tmp_path}/t").collect()) == [("a", 7), ("b", 2)] and spark.read.parquet(f"{tmp_path}/t").count() == 3
    compacted(spark, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    (tmp_path / "in" / "4.json").write_text('{"uid":"b","n":9}')
    ingest(*args).awaitTermination(60)
    assert sorted(tuple(r) for r in current(spark, f"{tmp_path}/t").collect()) == [("a", 7), ("b", 9)]


def test_money_summary(spark):
    payments = spark.createDataFrame([("a", "WA state (X)", "FY2023", 1.0), ("a", "WA state (X)", "FY2024", 2.0), ("b", "WA state (Y)", None, None)], "uid string, program string, period string, amount double")
    flags = spark.createDataFrame([("a", "paid_after_barred", '{"amount_after": 7.4}'), ("b", "paid_after_npi_deactivated", "{"), ("b", "childcare_valid_complaint", None)], "entity_uid string, rule_id string, evidence string")
    got = {(r.kind, r.label): (r.n, r.amount) for r in serve.money_summary(payments, flags).collect()}
    assert got == {("funds", "all"): (3, 3.0), ("program", "WA state (X)"): (2, 3.0), ("program", "WA state (Y)"): (1, 0.0), ("fiscal", "FY2024"): (1, 2.0), ("story", "after_bar"): (1, 7.0), ("story", "complaints"): (1, 0.0)}
    assert {(r.kind, r.label, r.n) for r in serve.money_summary(payments.limit(0), flags.limit(0)).collect()} == {("funds", "all", 0), ("story", "after_bar", 0), ("story", "complaints", 0)}

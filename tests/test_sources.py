import io
import json
import threading
import tracemalloc
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from registrum.operators import payments
from registrum.sources import archives, bulk, projections, readers, screening, store
from registrum.sources.paged import PagedSource


def test_paged_api_with_a_failing_server(spark):
    seen = []

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            seen.append(q)
            if len(seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            lo, n = int(q["$offset"]), int(q["$limit"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": {"rows": [{"id": i, "name": f"n{i}", "score": "x" if i == 3 else i / 2, "more": [1]} for i in range(lo, min(lo + n, 23))]}}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").schema("id long, name string, score double, more string, none string").options(url=f"http://127.0.0.1:{server.server_port}/x?a=b", total="25", page="10", rows="data.rows", pause="0", **{"filter.state": "WA"}).load()
    got = sorted(tuple(r) for r in rows.collect())
    server.shutdown()
    assert [r[0] for r in got] == list(range(23)) and got[3] == (3, "n3", None, "[1]", None) and got[5][2] == 2.5
    assert all(q["state"] == "WA" and q["a"] == "b" for q in seen) and len(seen) == 4


def test_filters_of_a_plan_go_into_the_request(spark):
    seen = []

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            seen.append(q)
            rows = [{"id": k, "state": ("WA", "OR")[k % 2], "year": 2000 + k} for k in range(10)]
            body = json.dumps([r for r in rows if r["state"] == q.get("state", r["state"])]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda **o: spark.read.format("paged").schema("id long, state string, year long").options(url=f"http://127.0.0.1:{server.server_port}/x", total="10", page="10", pause="0", **o).load()
        plain = load(push="state").where("state = 'WA' and year > 2003")
        assert [r.id for r in plain.orderBy("id").collect()] == [4, 6, 8] and seen[-1]["state"] == "WA" and "$where" not in seen[-1]
        plan = plain._jdf.queryExecution().executedPlan().toString()
        assert "year" in plan.split("Filter")[1].split("\n")[0] and "state" not in plan.split("Filter")[1].split("\n")[0]
        load(push="*", where="$where").where("state in ('WA', 'O''R') and year >= 2004 and state like 'W%' and id <> 4").collect()
        assert set(seen[-1]["$where"].split(" AND ")) >= {"state in ('WA', 'O''R')", "year >= 2004", "starts_with(state, 'W')"} and "id" not in seen[-1]
        load().where("state = 'WA'").collect()
        assert "state" not in seen[-1]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        server.shutdown()


@pytest.mark.parametrize("enabled", ["false", "true"])
def test_pages_are_read_whatever_the_setting_for_filters(spark, enabled):
    """A reader that pushes nothing takes no filters, which Spark would refuse while its setting is off (the default)."""

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps([{"id": k} for k in range(10)]).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", enabled)
    try:
        rows = spark.read.format("paged").schema("id long").options(url=f"http://127.0.0.1:{server.server_port}/x", total="10", page="10", pause="0").load()
        assert sorted(r.id for r in rows.where("id >= 4").collect()) == [4, 5, 6, 7, 8, 9]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        server.shutdown()


def test_a_cache_grows_by_what_is_new(spark, tmp_path):
    asked = []

    def fetched(missing):
        asked.append(sorted(r.npi for r in missing.collect()))
        return missing.where("npi <> 'none'").selectExpr("npi", "length(npi) as n", "explode(array(1, 2)) as k")

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "npi string")
    path = f"{tmp_path}/c"
    assert store.grown(spark, path, keys("x", "none", "x", None), "npi", fetched).count() == 2
    assert store.grown(spark, path, keys("x", "none"), "npi", fetched).count() == 2
    assert store.grown(spark, path, keys("x", "yy"), "npi", fetched).count() == 4
    assert asked == [["none", "x"], ["yy"]]  # one added key asks for one key
    spark.createDataFrame([("zz", 2, 1)], "npi string, n int, k int").write.parquet(f"{path}/rows/batch=dead")  # a run that died before its keys were written
    assert store.grown(spark, path, keys("x", "zz"), "npi", fetched).count() == 4 and asked[-1] == ["zz"]
    with pytest.raises(ValueError, match="refused"):
        store.grown(spark, path, keys("new"), "npi", lambda missing: (_ for _ in ()).throw(ValueError("refused")))
    assert store.grown(spark, path, keys("yy"), "npi", fetched).count() == 2


def test_screening_lists(spark, tmp_path):
    (tmp_path / "f.csv").write_text("LASTNAME,FIRSTNAME,BUSNAME,NPI,DOB,STATE,EXCLTYPE,EXCLDATE,REINDATE\nROE,JANE,,1234567890,19600102,WA,1128a1,20200131,00000000\n,,ACME LLC,0000000000,,OR,1128b4,20190101,\nDOE,JO,,,,WA,1128a1,20180101,20200101\n")
    (tmp_path / "a.csv").write_text("Name,First,Last,NPI,State / Province,Record Status,Exclusion Type,Active Date\nBeta,,,,WA,Active,Prohibited,2020-01-01\nGone,,,,WA,Inactive,x,\nFar,,,,TX,Active,x,\n,Al,Far,1111111111,TX,Active,x,\n")
    (tmp_path / "g.csv").write_text("Name,NPI,ExclDate\nGamma Inc.,2222222222,2020-02-02\n,,\n")
    cells = [["Provider list"], ["Name", "License #", "NPI # or P1 #", "Date of Exclusion", "Action"], ["One\nTwo", "MD 12345", "1333333333 1444444444 1555555555", "43831", "Terminated"], ["Three", "", "none", "2020-03-04", "x"]]
    sheet = spark.createDataFrame([(c,) for c in cells[1:]], "cells array<string>")
    rows = screening.merged(screening.federal(spark, f"{tmp_path}/f.csv"), screening.awards(spark, f"{tmp_path}/a.csv", "wa"), screening.dropped_in(spark, f"{tmp_path}/g.csv", "g", "WA"), screening.sheet(sheet, "state")).collect()
    got = sorted((r["name"], r.list, r.npi, r.ord.turn) for r in rows)
    want = [("JANE ROE", "OIG LEIE", "1234567890", 0), ("ACME LLC", "OIG LEIE", None, 0), ("Beta", "SAM.gov", None, 1), ("Al Far", "SAM.gov", "1111111111", 1), ("Gamma Inc.", "g", "2222222222", 2)]
    assert got == sorted([*want, ("One", "state", "1333333333", 3), ("Two", "state", "1444444444", 3), ("One", "state", "1555555555", 3), ("Three", "state", None, 3)])
    jane, one = next(r for r in rows if r["name"] == "JANE ROE"), next(r for r in rows if r["name"] == "Two")
    assert (jane.mandatory, jane.birth, jane.date, jane.reason) == (True, 1960, "2020-01-31", "Conviction of a program-related crime")
    assert (one.license_core, one.date, one.reason) == ("12345", "2020-01-01", "Terminated")
    assert next(r for r in rows if r["name"] == "ACME LLC").name_key == "ACME"


def test_a_failing_list_leaves_the_others(spark, tmp_path):
    (tmp_path / "sam.csv").write_text("Classification,Exclusion Type,Name,First,Last,NPI,State / Province,Record Status,Active Date\nIndividual,Prohibited,X,Ann,Lee,,WA,Active,2020-01-01\nFirm,Prohibited,Acme,,,,WA,Active,2020-01-01\n")
    rows, failed = screening.screened(spark, {"gone": lambda: screening.federal(spark, f"{tmp_path}/none.csv"), "sam": lambda: screening.dropped_in(spark, f"{tmp_path}/sam.csv", "sam", "WA")})
    assert sorted(r["name"] for r in rows.collect()) == ["Acme", "Ann Lee"] and list(failed) == ["gone"]


def test_pages_of_unknown_number_posted_and_positional(spark):
    bodies = []

    class Api(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bodies.append(body)
            lo = (body["PageNumber"] - 1) * body["Rows"]
            rows = [{"id": i} for i in range(lo, min(lo + body["Rows"], 23))]
            self.answer({"d": json.dumps({"aaData": rows})})

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            lo, n = int(q["offset"]), int(q["count"])
            self.answer([23, [], None, [[str(i), f"n{i}"] for i in range(lo, min(lo + n, 23))]])

        def answer(self, what):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(what).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    url = f"http://127.0.0.1:{server.server_port}/x"
    read = spark.read.format("paged").options(url=url, page="5", pause="0", readers="2")
    posted = read.schema("id long").options(body='{"PageNumber": {page}, "Rows": {size}}', wrapped="d", rows="aaData").load()
    assert sorted(r.id for r in posted.collect()) == list(range(23)) and {b["Rows"] for b in bodies} == {5}
    placed = spark.read.format("paged").options(url=url, page="5", pause="0", readers="3", rows="3", keys="npi,name", offset_name="offset", limit_name="count", cap="12").schema("name string, npi string").load()
    assert sorted(r.npi for r in placed.collect()) == sorted(map(str, range(12)))
    server.shutdown()


def workbook(rows) -> bytes:
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("c.csv", "BILLING,SERVICING,HCPCS,MONTH,PATIENTS,LINES,PAID\r\n" + "".join(f"{k % 3},{k % 5},H{k % 7},2024-0{k % 9 + 1},{k},2,{k}.5\n" for k in range(120_000)) + "broken,line\n1,1,H,2024-01,1,1,n/a")
    lines = bulk.zipped_lines(spark, f"{tmp_path}/c.zip")
    got = bulk.claim_lines(lines)
    assert lines.count() == 120_003 and got.count() == 120_000 and got.agg({"paid": "sum"}).first()[0] == sum(range(120_000)) + 60_000
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.xlsx", workbook([("NPI", "Date"), ("1", "05/06/2020"), ("2", "bad"), ("3", "01/01/2019")]))
    off = bulk.deactivated(bulk.zipped_sheets(spark, f"{tmp_path}/d.zip"), spark.createDataFrame([("1",), ("2",)], "npi string"))
    assert [tuple(r) for r in off.collect()] == [("1", "2020-05-06")]
    lost = spark.createDataFrame([(0, "91-1234567|ACME|||||||" + "|15-MAY-2010|01-AUG-2011"), (1, "22|short"), (2, "999999999|OTHER||||||||15-MAY-2010|x")], "at long, line string")
    tracked = spark.createDataFrame([("911234567",), ("",)], "ein string")
    assert [tuple(r) for r in bulk.revoked_exemptions(lost, tracked).collect()] == [("911234567", "ACME", "2010-05-15", "2011-08-01")]


def test_members_and_sheets_are_read_in_bounded_memory(spark, tmp_path):
    """A member of 200 MB and a sheet of 60,000 rows pass through a few MB; each member is a partition of its own."""
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("a.csv", "w", force_zip64=True) as member:
        for _ in range(200):
            member.write(b"x" * 999_999 + b"\n")
    with zipfile.ZipFile(tmp_path / "big.zip", "a") as z:
        z.writestr("deep/b.csv", "1\n2")
        z.writestr("c.txt", "no")
    (tmp_path / "sheet.xlsx").write_bytes(workbook((k, "some text") for k in range(60_000)))
    for content, path, rows in (("lines", "big.zip", 202), ("cells", "sheet.xlsx", 60_000)):
        reader = archives.Reader({"path": f"{tmp_path}/{path}", "content": content, "member": r".*\.csv"})
        parts = reader.partitions()
        tracemalloc.start()
        assert sum(batch.num_rows for p in parts for batch in reader.read(p)) == rows
        assert tracemalloc.get_traced_memory()[1] < 60e6
        tracemalloc.stop()
    got = archives.archive(spark, f"{tmp_path}/*.zip", member=r".*b\.csv")
    assert sorted((r.member, r["at"], r.line) for r in got.collect()) == [("deep/b.csv", 0, "1"), ("deep/b.csv", 1, "2")]
    assert archives.archive(spark, f"file://{tmp_path}", member="none").count() == 0


def test_the_sentences_around_an_entry():
    place = "Jane Roe (RN00012345)"
    for text, want in (
        (f"First. {place} was barred. She may appeal. More.", f"{place} was barred. She may appeal."),
        (f"First. {place} was barred. The end.", f"{place} was barred. The end."),
        (f"{'a' * 300}. Kent County {place} was. {'b' * 400}. c", f"{place} was. {'b' * 400}"[:221]),
        (f"A. {'c' * 237}{place}", "c" * 140 + place),
        (f"A. {'c' * 236}{place}", "c" * 236 + place),
    ):
        start = text.index(place)
        assert bulk.around(text, start, start + len(place)) == want[:320], text


def test_pages_of_orders_and_agreements(spark):
    text = "News of May. King County In April 2020 the board revoked the licence of Jane A. Roe (RN00012345), citing harm. She may appeal. More."
    posts = spark.createDataFrame([("https://x/state-disciplines-05-06-2020", f"<p>{text}</p>"), ("https://x/none", "<p>John Quincy Doe (MD00000007) was fined.</p>"), ("https://x/later-07-08-2021", "Jane Roe (RN00012345) surrendered.")], "url string, html string")
    entries = bulk.order_entries(posts)
    got = {(r.name, r.credential, r.date): r.reason for r in entries.collect()}
    assert got["Jane A. Roe", "RN00012345", "2020-05-06"].endswith("She may appeal.") and ("John Quincy Doe", "MD00000007", "") in got
    assert [(r.core, r.date) for r in bulk.order_bars(entries).collect()] == [("12345", "2020-05-06")]
    assert {(r.credential, r.date) for r in bulk.newest_orders(entries).collect()} == {("RN00012345", "2021-07-08"), ("MD00000007", "")}
    pages = spark.createDataFrame([(0, '<a href="state-revokes-a"> state-suspends-b'), (1, "state-revokes-a state-charges-c")], "number int, html string")
    assert [r.url for r in bulk.post_links(pages, r"(state-(?:disciplines|revokes|suspends|charges)[a-z0-9-]*)", "https://x/", 2).collect()] == ["https://x/state-revokes-a", "https://x/state-suspends-b"]
    cards = spark.createDataFrame([('<li class="usa-card a"><a href=x>Acme  Care, Inc.</a><span>Seattle, WA</span><span>Integrity Agreement</span><span>Effective May 6, 2020</span><li class="usa-card"><a>ACME CARE</a><span>Effective Jan 12, 2021</span>',)], "html string")
    assert [(r.name_key, r.city, r.kind, r.effective) for r in bulk.agreements(cards).collect()] == [("ACME CARE", "", "CIA", "2021-01-12")]
    page = '<div class="tab-pane" id="complaints"><td>01/02/2020</td><td>03/04/2021</td></div><div class="tab-pane" id="inspections">No Inspection Data available 01/02/2020</div><label>Subsidy Participation:</label> <p class="form-control-static"> Yes </p>'
    assert [tuple(r) for r in bulk.provider_pages(spark.createDataFrame([("u", page)], "uid string, html string")).collect()] == [("u", 2, 0, "Yes", "", "")]


def test_curated_files_and_licences(spark, tmp_path):
    (tmp_path / "c.csv").write_text("\ufeffLink,Credential #,Provider,Kind\nhttp://a,RN00120098,,ORDER\n,1,x,news\n", encoding="utf-8")
    assert [(r.url, r.credential, r.kind, r.npi) for r in bulk.curated(spark, f"{tmp_path}/c.csv").collect()] == [("http://a", "RN00120098", "order", "")]
    rows = spark.createDataFrame([('{"lic_number":" 1 "},{"lic_number":"2"},{"lic_number":"1"}',), ('[{"lic_number":"3"}]',), (None,), ("broken",)], "l string")
    assert [r[0] for r in rows.select(bulk.license_numbers(rows.l)).collect()] == [["1", "2"], ["3"], [], []]


def test_all_sheets_runs_and_dockets(spark, tmp_path):
    one, two = workbook([("a",)]), workbook([("b",), ("c",)])
    with zipfile.ZipFile(io.BytesIO(one)) as x, zipfile.ZipFile(io.BytesIO(two)) as y, zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", x.read("xl/worksheets/sheet1.xml"))
        z.writestr("xl/worksheets/sheet2.xml", y.read("xl/worksheets/sheet1.xml"))
    assert [(r.member[-5], r.row, r.cells) for r in readers.xlsx(spark, f"{tmp_path}/w.xlsx", None).orderBy("member", "row").collect()] == [("1", 0, ["a"]), ("2", 0, ["b"]), ("2", 1, ["c"])]
    rows = spark.createDataFrame([("s:1", "s"), ("s:2", "s")], "uid string, source string")
    assert store.ingested(rows, f"{tmp_path}/e", f"{tmp_path}/log", "s", "2024-01-01") == 2 and store.ingested(rows.limit(1), f"{tmp_path}/e", f"{tmp_path}/log", "s", "2024-01-02") == 2
    assert store.read(spark, f"{tmp_path}/log").count() == 2
    entities = spark.createDataFrame([("a", "Harbor Light Services LLC"), ("b", "Short"), ("c", "Harbor Quilts House")], "uid string, name string")
    triage = spark.createDataFrame([("a", "escalated", None), ("b", "escalated", True), ("c", "new", False)], "uid string, state string, watched boolean")
    cases = spark.createDataFrame([("HARBOR LIGHT SERVICES", "US v. X", "wawd", "2020-01-01", "1:20", "http://c/1"), ("Harbor Quilts House", "Y", "waed", "2020-01-01", "2", "http://c/2")], "party string, case string, court string, filed string, docket string, url string")
    assert [(r.name, r.url, r.kind) for r in bulk.dockets(entities, triage, cases).collect()] == [("Harbor Light Services LLC", "http://c/1", "litigation")]
    crosswalk = spark.createDataFrame([("a", "1", "", ["2"]), ("b", "1", "Kent", ["2"]), ("c", "", "", None)], "uid string, npi string, city string, licenses array<string>")
    assert [r.uid for r in payments.unresolved(crosswalk, entities).collect()] == ["a"] and [r.npi for r in payments.tracked_numbers(crosswalk, crosswalk).collect()] == ["1"]


def test_projected_blocks(spark):
    rows = spark.createDataFrame([("1", "Acme")], "agency_contract_no string, contractor_name_search_for string")
    got = projections.projected({"contracts_2023": rows, "off": rows}, {"contracts_2023": {}, "off": {"kind": "contracts", "enabled": False}, "absent": {"kind": "cms"}})
    assert {k: [r.uid for r in v.collect()] for k, v in got.items()} == {"contracts_2023": ["contracts_2023:1"]}


def test_tables_beside_what_they_replace(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.replace(spark.range(3), path)
    store.replace(store.read(spark, path).where("id > 0"), path)  # reads what it replaces
    assert store.read(spark, path).count() == 2 and store.read(spark, path, 1).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    store.swap(spark.range(3), f"{tmp_path}/plain")
    store.swap(spark.read.parquet(f"{tmp_path}/plain").where("id > 0"), f"{tmp_path}/plain")
    assert spark.read.parquet(f"{tmp_path}/plain").count() == 2
    assert store.meta(spark, f"{tmp_path}/m", {"a": "1"}) == {"a": "1"} and store.meta(spark, f"{tmp_path}/m", {"b": "2"}) == {"a": "1", "b": "2"} == store.meta(spark, f"{tmp_path}/m")
    triage = spark.createDataFrame([("a", "new", "n", True)], "uid string, state string, note string, watched boolean")
    change = spark.createDataFrame([("a", "reviewed", None, None), ("b", None, "hi", None)], triage.schema)
    assert sorted(tuple(r) for r in store.triaged(triage, change).collect()) == [("a", "reviewed", "n", True), ("b", None, "hi", False)]
    with pytest.raises(Exception, match="unknown state"):
        store.triaged(triage, spark.createDataFrame([("a", "odd", None, None)], triage.schema)).collect()


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/v"
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n int")
    table = lambda **at: sorted(tuple(r) for r in store.read(spark, path, **at).collect())
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    assert store.replace_partitions(rows(("a:1", 1), ("b", 2)), path, "k") == 1
    before = store.read(spark, path)  # a reader that began with the first version
    assert store.replace_partitions(rows(("b", 3), ("c", 4), (None, 5)), path, "k") == 2
    assert sorted(r.n for r in before.collect()) == [1, 2] and [r.n for r in store.read(spark, path).orderBy("n").collect()] == [1, 3, 4, 5]
    assert table(parts=["a:1"]) == [("a:1", 1)] and table(version=1) == [("a:1", 1), ("b", 2)]
    # A write that dies half way, in its rows or in its manifest, changes nothing, and the next one goes on from what was there.
    broken = rows(("d", 1)).union(spark.range(1).selectExpr("cast(raise_error('killed') as string) k", "1 n"))
    with pytest.raises(Exception, match="killed"):
        store.replace(broken, path)
    (tmp_path / "v" / store.MANIFESTS / f"{3:012d}").write_text('{"entries": [')
    assert [r.n for r in store.read(spark, path).orderBy("n").collect()] == [1, 3, 4, 5]
    assert store.append(rows(("e", 6)), path) == 4 and store.read(spark, path).count() == 5
    # Two writers from one version: the second is told, and its rows aren't in the table.
    assert store.replace(rows(("f", 7)), path, base=4) == 5
    with pytest.raises(store.Conflict):
        store.replace(rows(("g", 8)), path, base=4)
    assert table() == [("f", 7)] and set(store.versions(spark, path)) == {4, 5}
    folders = lambda: {p.name for p in (tmp_path / "v").iterdir() if p.name.startswith("data-")}
    left = len(folders())
    assert store.vacuum(spark, path) == [] and 1 <= len(store.vacuum(spark, path, 0)) < left and table() == [("f", 7)] and store.read(spark, path, 4).count() == 5
    store.replace(rows(), path)
    assert table() == []
    with pytest.raises(ValueError, match="n is int"):
        store.append(spark.createDataFrame([("x", "y")], "k string, n string"), path)

from datetime import date

from registrum import casefile as C

ENTITY = {"uid": "childcare:7", "source": "childcare", "source_id": "7", "name": "Tots & <b>Co</b>", "status": "Active", "raw": {"sspsprovidernumber": "S9", "credentialnumber": None, "licensecapacity": "40"}}


def test_everything_is_escaped_and_said():
    page = C.entity_file(ENTITY, [{"rule_id": "x", "severity": 9, "title": "<t>", "explanation": "why"}], dossier={"headline": "H", "bar_date": "2020-01-01", "total": 5000.4, "after": 10.0}, today=date(2024, 1, 2))
    assert "<b>Co</b>" not in page and "Tots &amp; &lt;b&gt;Co&lt;/b&gt;" in page and "&lt;t&gt;" in page
    assert "not findings" in page and "SSPS provider #S9" in page and "$5,000" in page and "January 02, 2024" in page and "(now 40)" in page
    assert page.index("Child Care Check") < page.index("Inspector General")


def test_missing_parts_leave_no_trace():
    bare = C.entity_file({"uid": "u", "source": "dme", "source_id": "123"})
    assert "NPI 123" in bare and "Records request" not in bare and "<h1>u</h1>" in bare
    assert C.records_request({"raw": {}}, date(2024, 1, 1)) == "" and C.table([], {"a": "A"}) == "" and C.dollars(None) == "—"
    page = C.operator_file({"operator_id": "op:1", "score": 40.0, "strongest_link": "hard", "funds": 1e6, "contradiction": 0.0}, [{"uid": "u", "name": "<n>"}], ["check <this>"])
    assert "$1,000,000" in page and "check &lt;this&gt;" in page and "&lt;n&gt;" in page

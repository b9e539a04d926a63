"""Printable case files of one entity or operator, for a reviewer: a template filled on the driver with rows that the review queries give.

Everything is escaped. Texts say what a case file is: leads from public records to verify, no findings.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from html import escape

NOTE = "These are leads assembled from public records, not findings. Figures can have innocent reasons and names can be shared: check every item at its source before relying on it."
# Where a concern about a source's providers can be reported.
CHANNELS = {
    "childcare": [("DCYF child care licensing complaints (Child Care Check)", "https://www.dcyf.wa.gov/safety/report-abuse")],
    "healthcare": [("WA DOH — file a complaint against a provider credential", "https://doh.wa.gov/licenses-permits-and-certificates/file-complaint-about-provider-or-facility")],
    "": [
        ("HHS Office of Inspector General hotline (Medicare/Medicaid provider fraud)", "https://oig.hhs.gov/fraud/report-fraud/"), ("WA Attorney General — Medicaid Fraud Control Division", "https://www.atg.wa.gov/medicaid-fraud-control-division"),
        ("WA State Auditor — citizen fraud hotline (state funds)", "https://sao.wa.gov/report-a-concern/"),
    ],
}
NUMBERED = ("aba", "nemt", "dme")


def text(value: object) -> str:
    """A value as escaped text, nothing for none."""
    return "" if value is None else escape(str(value), quote=True)


def dollars(value: float | None) -> str:
    return "—" if value is None else f"${value:,.0f}"


def table(rows: Iterable[Mapping], columns: Mapping[str, str]) -> str:
    """An HTML table of rows: columns maps a row's keys to headings. No rows, no table."""
    rows = list(rows)
    if not rows:
        return ""
    cells = lambda r: "".join(f"<td>{text(r.get(c))}</td>" for c in columns)
    return f"<table><tr>{''.join(f'<th>{text(h)}</th>' for h in columns.values())}</tr>{''.join(f'<tr>{cells(r)}</tr>' for r in rows)}</table>"


def page(title: str, *parts: str) -> str:
    body = "".join(p for p in parts if p)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{text(title)}</title></head><body><h1>{text(title)}</h1><p>{text(NOTE)}</p>{body}</body></html>"


def channels(source: str) -> list[tuple[str, str]]:
    """Where to report, the source's own channel first."""
    return CHANNELS.get(source, []) * bool(source) + CHANNELS[""]


def identifiers(entity: Mapping) -> list[str]:
    """What names an entity beyond doubt: its credential, provider number and subsidy number."""
    raw = entity.get("raw") or {}
    npi = entity.get("source_id") if entity.get("source") in NUMBERED else entity.get("npi")
    named = (("WA credential ", raw.get("credentialnumber")), ("NPI ", npi), ("SSPS provider #", raw.get("sspsprovidernumber")))
    return [f"{label}{value}" for label, value in named if value]


def referral(entity: Mapping, dossier: Mapping | None = None) -> str:
    """A short text for an intake form: who, what the records show, since when, how much."""
    known = "; ".join(identifiers(entity)) or entity.get("source") or "no identifier"
    parts = [f"This concerns {entity.get('name') or '(unnamed)'} ({known})."]
    if dossier:
        if dossier.get("bar_date"):
            parts.append(f"Public records date a bar to {dossier['bar_date']}.")
        if dossier.get("total"):
            parts.append(f"Public payments of {dollars(dossier['total'])} are on record.")
        if dossier.get("after"):
            parts.append(f"Of these, {dollars(dossier['after'])} are dated after the bar.")
    return "\n\n".join([*parts, "It is a lead from records that an automated screen put together; who is meant and when money was paid should be checked at the sources."])


def records_request(entity: Mapping, today: date) -> str:
    """A public-records request for the payments of a subsidy number; empty without one."""
    raw = entity.get("raw") or {}
    number, capacity = raw.get("sspsprovidernumber"), raw.get("licensecapacity")
    if not number:
        return ""
    asked = ["Its subsidy payments by date and amount.", "The enrollment or attendance counts handed in for them."]
    if capacity:
        asked.append(f"Its licensed capacity over that time (now {capacity}).")
    listed = "\n".join(f"{n}. {a}" for n, a in enumerate(asked, 1))
    return f"{today:%B %d, %Y}\n\nPublic Records Officer\n\nUnder the Public Records Act (RCW 42.56) I ask for existing records on the child care provider \"{entity.get('name') or '(provider)'}\", SSPS number {number}, from January 1, 2021 on:\n\n{listed}\n\nPlease redact what is exempt, name the exemption, and tell me of costs beforehand.\n\n[Name and address]"


def entity_file(entity: Mapping, flags: Iterable[Mapping] = (), payments: Iterable[Mapping] = (), timeline: Iterable[Mapping] = (), dossier: Mapping | None = None, links: Iterable[Mapping] = (), today: date | None = None) -> str:
    """The case file of an entity, from its row and those of its flags, payments, timeline, dossier and context links."""
    facts = [{"k": k, "v": entity.get(c)} for k, c in (("Source", "source"), ("Type", "entity_type"), ("Status", "status"), ("Address", "address"), ("City", "city"), ("Record", "source_url"))]
    letter = records_request(entity, today) if today else ""
    return page(
        entity.get("name") or entity.get("uid") or "(unnamed)", table(facts, {"k": "", "v": ""}), f"<h2>{text(dossier.get('headline'))}</h2>" if dossier else "", table(flags, {"rule_id": "Rule", "severity": "Weight", "title": "Signal", "explanation": "Why"}), table(timeline, {"date": "Date", "label": "Event"}),
        table(payments, {"program": "Program", "period": "Period", "amount": "Amount"}), table(links, {"title": "Context", "url": "Link", "date": "Date"}), table([{"l": label, "u": url} for label, url in channels(entity.get("source") or "")], {"l": "Channel", "u": "Where"}),
        f"<h2>Referral</h2><pre>{text(referral(entity, dossier))}</pre>", f"<h2>Records request</h2><pre>{text(letter)}</pre>" if letter else "",
    )


def operator_file(operator: Mapping, members: Iterable[Mapping] = (), todo: Iterable[str] = ()) -> str:
    """The case file of an operator, from its row, its members and what is to verify."""
    facts = [{"k": k, "v": v} for k, v in (("Score", operator.get("score")), ("Strongest link", operator.get("strongest_link")), ("Money", dollars(operator.get("funds"))), ("Paid after a bar", dollars(operator.get("contradiction"))))]
    tasks = "".join(f"<li>{text(t)}</li>" for t in todo)
    return page(operator.get("name") or operator.get("operator_id") or "(operator)", table(facts, {"k": "", "v": ""}), f"<h2>To verify</h2><ul>{tasks}</ul>" if tasks else "", table(members, {"uid": "Record", "name": "Name", "source": "Source", "status": "Status", "score": "Score", "funds": "Money"}))

"""Projections of the registries' own layouts into entities, one function a source, and the registry of them.

Rows without an id go; of an id the first by `order` stays (a column or expression; else by a hash of the row, so that every run keeps the same one).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions.text import blank

from .readers import entities


def encoded(value: Column) -> Column:
    return F.url_encode(F.coalesce(value, F.lit("")))


def record_url(domain: str, dataset: str, field: str, value: Column) -> Column:
    """A link to one record of an open-data table."""
    return F.concat(F.lit(f"https://{domain}/resource/{dataset}.json?{field}="), encoded(value))


def dataset_url(domain: str, dataset: str) -> Column:
    return F.lit(f"https://{domain}/d/{dataset}")


def facility_url(base: str, dataset: str, field: str, value: Column) -> Column:
    """A link to one record of the facility catalogue, by a condition on its id field."""
    condition = f"conditions%5B0%5D%5Bproperty%5D={field}&conditions%5B0%5D%5Bvalue%5D="
    return F.concat(F.lit(f"{base}/{dataset}?{condition}"), encoded(value), F.lit("&conditions%5B0%5D%5Boperator%5D=%3D"))


def provider_url(npi: Column) -> Column:
    return F.concat(F.lit("https://npiregistry.cms.gov/provider-view/"), npi)


def _field(rows: DataFrame, name: str | None) -> Column:
    """The trimmed column of that name, empty where the rows have none."""
    return blank(F.col(f"`{name}`").cast("string")) if name and name in rows.columns else F.lit("")


def childcare(rows: DataFrame, order: Column | str | None = None, domain: str = "data.wa.gov", dataset: str = "was8-3ni8") -> DataFrame:
    """Licensed child care: the id is the licence's, else the subsidy system's; the latitude's name is misspelled at the source."""
    f = lambda name: _field(rows, name)
    key = F.when(f("wacompassid") != "", f("wacompassid")).otherwise(f("sspsprovidernumber"))
    columns = {
        "source_id": key, "name": f("providername"), "dba": f("doingbusinessas"), "entity_type": f("facilitytypegeneric"), "status": f("latestoperatingstatus"), "address": f("physicalstreetaddress"), "city": f("physicalcity"), "state": f("physicalstate"), "zip": f("physicalzip"), "county": f("physicalcounty"),
        "lat": f("physciallatitude"), "lon": f("physicallongitude"), "source_url": record_url(domain, dataset, "wacompassid", key),
    }
    return entities(rows, "childcare", columns, order)


def contracts(rows: DataFrame, year: int | None = None, order: Column | str | None = None, domain: str = "data.wa.gov", dataset: str = "pwse-3zea") -> DataFrame:
    """Agency contracts, one source a snapshot year (`contracts_2024`): the id is the contract's number, else the vendor's name."""
    f = lambda name: _field(rows, name)
    name = f("contractor_name_search_for")
    columns = {
        "source_id": F.when(f("agency_contract_no") != "", f("agency_contract_no")).otherwise(name), "name": name, "dba": f("contractor_name_d_b_a_optional"), "entity_type": F.lit("STATE CONTRACT"), "status": f("procurement_type"), "address": f("agency_number_agency_name"), "amount": f("cost_of_contract"),
        "source_url": dataset_url(domain, dataset),
    }
    return entities(rows, f"contracts_{year}" if year else "contracts", columns, order)


def credentials(rows: DataFrame, order: Column | str | None = None, domain: str = "data.wa.gov", dataset: str = "qxh8-f4bd") -> DataFrame:
    """Health-care credentials: first and last name, else the number."""
    f = lambda name: _field(rows, name)
    name, number = F.trim(F.concat_ws(" ", F.nullif(f("firstname"), F.lit("")), F.nullif(f("lastname"), F.lit("")))), f("credentialnumber")
    columns = {"source_id": number, "name": F.when(name != "", name).otherwise(number), "entity_type": f("credentialtype"), "status": f("status"), "source_url": record_url(domain, dataset, "credentialnumber", number)}
    return entities(rows, "healthcare", columns, order)


def facilities(rows: DataFrame, source: str, label: str, fields: dict[str, str], state: str = "WA", order: Column | str | None = None, base: str = "https://data.cms.gov/provider-data/api/1/datastore/query", dataset: str = "") -> DataFrame:
    """A category of certified facilities. `fields` names the columns for id, name and, where there are such, address, city, state, zip, county,
    ownership and cert_date; the last two also stand in `raw` as `_ownership` and `_cert_date`, whatever the category calls them."""
    f = lambda key: _field(rows, fields.get(key))
    name = f("name")
    key = F.when(f("id") != "", f("id")).otherwise(name)
    dated = rows.withColumn("_ownership", f("ownership")).withColumn("_cert_date", F.nullif(f("cert_date"), F.lit("")))
    columns = {
        "source_id": key, "name": F.when(name != "", name).otherwise(key), "entity_type": F.lit(label), "status": f("ownership"), "address": f("address"), "city": f("city"), "state": f("state") if fields.get("state") else F.lit(state), "zip": f("zip"), "county": f("county"),
        "source_url": facility_url(base, dataset, fields["id"], key),
    }
    return entities(dated, source, columns, order)


def npi_category(rows: DataFrame, source: str, label: str, state: str = "WA", order: Column | str | None = None) -> DataFrame:
    """Providers of some taxonomies of the national registry: a number in several taxonomies is one provider, the first by `order`."""
    f = lambda name: _field(rows, name)
    columns = {"source_id": f("npi"), "name": F.when(f("name") != "", f("name")).otherwise(f("npi")), "entity_type": F.lit(label), "address": f("line1"), "city": f("city"), "state": F.when(f("state") != "", f("state")).otherwise(state), "zip": f("zip"), "source_url": provider_url(f("npi"))}
    return entities(rows, source, columns, order)


#: kind of a source block -> its projection(rows, block).
KINDS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "childcare": lambda rows, block: childcare(rows),
    "contracts": lambda rows, block: contracts(rows, block.get("year")),
    "healthcare": lambda rows, block: credentials(rows),
    "cms": lambda rows, block: facilities(rows, block["key"], block.get("label", block["key"]), block["fields"], block.get("state", "WA"), dataset=block.get("dataset", "")),
    "nppes": lambda rows, block: npi_category(rows, block["key"], block.get("label", block["key"]), block.get("state", "WA")),
}


def projected(tables: dict[str, DataFrame], blocks: dict[str, dict]) -> dict[str, DataFrame]:
    """The entities of each enabled block (kind, enabled and what its projection asks for) whose table is given; the kind defaults to the block's name."""
    out = {}
    for key, block in blocks.items():
        kind = block.get("kind", "contracts" if key.startswith("contracts") else key)
        if block.get("enabled", True) and key in tables:
            if kind not in KINDS:
                raise ValueError(f"unknown kind of source: {kind}")
            year = key.rsplit("_", 1)[1] if kind == "contracts" and "_" in key else None
            out[key] = KINDS[kind](tables[key], {"key": key, "year": year} | block)
    return out

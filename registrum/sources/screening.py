"""Exclusion and sanction lists in one shape (COLUMNS), merged in their order of precedence and matched with entities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions.text import blank, first_of, letters, license_core, name_key, serial_day, year

from .readers import csv

# Exclusion authorities; those that start with 1128(a) are mandatory, those with 1128(b) or (c) are not.
AUTHORITIES = {
    "1128a1": "Conviction of a program-related crime", "1128a2": "Conviction relating to patient abuse or neglect", "1128a3": "Felony conviction relating to health care fraud", "1128a4": "Felony conviction relating to a controlled substance",
    "1128b1": "Misdemeanor conviction relating to health care fraud", "1128b2": "Conviction relating to fraud in a non-health-care program", "1128b3": "Conviction relating to obstruction of an investigation", "1128b4": "License revocation, suspension, or surrender",
    "1128b5": "Exclusion/suspension under a federal or state health program", "1128b6": "Claims for excessive charges or medically unnecessary services", "1128b7": "Fraud, kickbacks, and other prohibited activities", "1128b8": "Entity controlled by a sanctioned individual",
    "1128b14": "Default on a health-education loan or scholarship", "1128b15": "Individual controlling a sanctioned entity", "1128b16": "Making false statements or misrepresentations of material fact",
}

COLUMNS = ["list", "npi", "license", "name", "state", "city", "provider_type", "address", "code", "reason", "date", "birth", "mandatory"]


def npi(c: Column) -> Column:
    """A provider's number, trimmed; null for blanks and zeros."""
    text = F.trim(c)
    return F.when(~text.isin("", "0", "0000000000"), text)


def plain_code(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]", "")


def authority(c: Column) -> Column:
    """What an exclusion code stands for, else the code."""
    return first_of(*[(plain_code(c) == k, F.lit(v)) for k, v in AUTHORITIES.items()], default=F.coalesce(c, F.lit("")))


def mandatory(c: Column) -> Column:
    """Whether an exclusion is mandatory; null where the code is unknown."""
    code = plain_code(c)
    return F.when(code.startswith("1128a"), True).when(code.startswith("1128b") | code.startswith("1128c"), False)


def iso(c: Column) -> Column:
    """`yyyyMMdd` as yyyy-MM-dd; empty for blanks and zeros; other texts as they are."""
    text = blank(c)
    digits = text.rlike(r"^\d{8}$") & (text != "00000000")
    return F.when(digits, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).when(text.isin("", "0", "00000000"), "").otherwise(text)


def _listed(rows: DataFrame, title: str | Column, **columns: Column) -> DataFrame:
    """rows in the lists' shape; columns not given are empty, the birth year and whether it is mandatory null."""
    empty = {"npi": F.lit(None).cast("string"), "birth": F.lit(None).cast("int"), "mandatory": F.lit(None).cast("boolean")}
    title = F.lit(title) if isinstance(title, str) else title
    return rows.select(*[(title if c == "list" else columns.get(c, empty.get(c, F.lit("")))).alias(c) for c in COLUMNS])


def _person(first: str, last: str) -> Column:
    return F.trim(F.concat_ws(" ", F.nullif(blank(F.col(first)), F.lit("")), F.nullif(blank(F.col(last)), F.lit(""))))


def federal(spark: SparkSession, path: str) -> DataFrame:
    """The federal exclusion file: those reinstated go; the business's name, else the person's."""
    rows = csv(spark, path, encoding="ISO-8859-1")
    col = lambda c: blank(F.col(c)) if c in rows.columns else F.lit("")
    kept = rows.where(col("REINDATE").isin("", "0", "00000000"))
    kind = F.trim(F.concat_ws(" ", F.nullif(col("GENERAL"), F.lit("")), F.nullif(col("SPECIALTY"), F.lit(""))))
    name = F.when(col("BUSNAME") != "", col("BUSNAME")).otherwise(_person("FIRSTNAME", "LASTNAME"))
    return _listed(kept, "OIG LEIE", npi=npi(col("NPI")), name=name, state=col("STATE"), city=col("CITY"), provider_type=kind, address=col("ADDRESS"), code=col("EXCLTYPE"), reason=authority(col("EXCLTYPE")), date=iso(col("EXCLDATE")), birth=year(col("DOB")), mandatory=mandatory(col("EXCLTYPE")))


def revoked(rows: DataFrame) -> DataFrame:
    """Revoked billing privileges, as the program's interface gives them."""
    name = F.when(blank(F.col("ORG_NAME")) != "", blank(F.col("ORG_NAME"))).otherwise(_person("FIRST_NAME", "LAST_NAME"))
    return _listed(rows, "CMS Revoked Medicare", npi=npi(F.col("NPI")), name=name, state=blank(F.col("STATE_CD")), reason=blank(F.col("REVOCATION_RSN")), date=blank(F.col("REVOCATION_EFCTV_DT")))


def awards(spark: SparkSession, path: str, state: str) -> DataFrame:
    """The award-management extract: active rows of the state or with a usable number; of individuals the person's name."""
    hints = {"name": ["name"], "first": ["first"], "last": ["last"], "npi": ["npi"], "state": ["state / province", "state"], "status": ["record status", "status"], "kind": ["classification"], "reason": ["exclusion type"], "agency": ["excluding agency"], "date": ["active date"]}
    rows = csv(spark, path, hints)
    person = _person("first", "last")
    kept = rows.where((F.lower(F.trim("status")) == "active") & ((F.upper(F.trim("state")) == state.strip().upper()) | npi(F.col("npi")).isNotNull()))
    name = F.when((F.lower(F.trim("kind")) == "individual") | (blank(F.col("name")) == ""), person).otherwise(F.col("name"))
    reason = F.trim(F.concat_ws(" ", F.nullif("reason", F.lit("")), F.nullif("agency", F.lit(""))))
    return _listed(kept, "SAM.gov", npi=npi(F.col("npi")), name=name, state=F.upper(F.trim("state")), reason=reason, date=F.col("date"))


def generic(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Any list with a name column (name, entity, busname or lastname), whatever the case of its headers."""
    hints = {"name": ["name"], "entity": ["entity"], "business": ["busname"], "last": ["lastname"], "npi": ["npi"], "state": ["state"], "reason": ["reason"], "code": ["excltype"], "date": ["date"], "dated": ["excldate"]}
    rows = csv(spark, path, hints)
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    return _listed(rows, name, npi=npi(F.col("npi")), name=first("name", "entity", "business", "last"), state=F.col("state"), reason=first("reason", "code"), date=first("date", "dated")).where("name <> ''")


def dropped_in(spark: SparkSession, path: str, name: str, state: str) -> DataFrame:
    """A file of unknown kind: an award-management extract if its header says so, else a generic list."""
    header = spark.read.option("header", True).csv(path).columns
    return awards(spark, path, state) if {"Classification", "Exclusion Type"} <= set(header) else generic(spark, path, name)


def sheet(rows: DataFrame, name: str, state: str = "WA") -> DataFrame:
    """Spreadsheet rows (row, cells: name, licence, numbers, date, action) of a state's list, after its header. A name cell may hold several names,
    one a line: each takes the number of its place, else the first; numbers beyond the names stand under the first name."""
    c = lambda k: F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit("")))
    rows = rows.select(c(0).alias("name"), c(1).alias("license"), F.regexp_extract_all(c(2), F.lit(r"\b(1\d{9})\b"), F.lit(1)).alias("npis"), c(3).alias("dated"), c(4).alias("action"))
    rows = rows.where((F.col("name") != "") & ~((F.col("name") == "Name") & F.col("license").contains("License")))
    names = F.filter(F.transform(F.split("name", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("names", names).withColumn("places", F.greatest(F.size("names"), F.size("npis")))
    made = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("at"))
    serial = F.date_format(serial_day(F.col("dated").try_cast("double")), "yyyy-MM-dd")
    own = F.coalesce(F.get("npis", F.col("at")), F.get("npis", F.lit(0)))
    return _listed(made, name, npi=npi(own), license=F.col("license"), name=F.coalesce(F.get("names", F.col("at")), F.get("names", F.lit(0)), F.lit("")), state=F.lit(state), reason=F.col("action"), date=F.coalesce(serial, F.left("dated", F.lit(10))))


def located_sheet(rows: DataFrame, name: str, reason: str, state: str = "WA") -> DataFrame:
    """Spreadsheet rows (cells: name, address, licence, date) of a list of licensed places."""
    c = lambda k: F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit("")))
    kept = rows.where(~c(0).isin("", "Name") & ~(F.left(c(0), F.lit(5)).contains("Name") & c(1).contains("Address")))
    serial = F.date_format(serial_day(c(3).try_cast("double")), "yyyy-MM-dd")
    return _listed(kept, name, license=c(2), name=c(0), state=F.lit(state), address=c(1), reason=F.lit(reason), date=F.coalesce(serial, F.left(c(3), F.lit(10))))


def merged(*lists: DataFrame) -> DataFrame:
    """All lists with the keys that they are matched by (npi, license_core of four digits or more, name_key with state_key); earlier lists come first in
    `ord`, which breaks ties of a cascade, and rows of one list by date, name and number."""
    numbered = [x.select(*COLUMNS, F.lit(k).alias("turn")) for k, x in enumerate(lists)]
    core = license_core(F.col("license"))
    rows = reduce(DataFrame.unionByName, numbered).withColumn("name_key", F.nullif(name_key(F.col("name")), F.lit(""))).withColumn("state_key", F.nullif(F.upper(F.trim("state")), F.lit("")))
    return rows.withColumn("license_core", F.when(F.length(core) >= 4, core)).withColumn("ord", F.struct("turn", "date", "name", "npi")).drop("turn")


def screened(spark: SparkSession, makers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """merged() of the lists that can be read, in the order of `makers`, and the errors of those that can't: one failing list leaves the others."""
    good, failed = [], {}
    for name, make in makers.items():
        try:
            rows = make()
            rows.limit(1).collect()
            good.append(rows)
        except Exception as e:  # a list that is gone or changed its layout
            failed[name] = f"{type(e).__name__}: {e}"
    if not good:
        good = [_listed(spark.createDataFrame([], "x int"), "")]
    return merged(*good), failed


def graded(matches: DataFrame) -> DataFrame:
    """Matches (npi_hit, license_hit, name_hit: the listed row by each key, or null; city, entity_type, birthyear of the entity) with `hit`, `via` and
    `confidence`: definitive by number, corroborated where the birth year, city or a word of the provider type agrees, else name-only. A different
    birth year drops a match by name."""
    words = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))), lambda w: F.length(w) > 3)
    hard = F.coalesce("npi_hit", "license_hit")
    birth, listed = year(F.col("birthyear")), F.col("name_hit.birth")
    differs = hard.isNull() & F.coalesce(birth != listed, F.lit(False))
    cities = letters(F.coalesce("city", F.lit(""))), letters(F.coalesce("name_hit.city", F.lit("")))
    backed = F.coalesce(birth == listed, F.lit(False)) | ((cities[0] != "") & (cities[0] == cities[1])) | F.arrays_overlap(words(F.col("entity_type")), words(F.col("name_hit.provider_type")))
    out = matches.where(F.coalesce(hard, F.col("name_hit")).isNotNull() & ~differs)
    via = F.when(F.col("npi_hit").isNotNull(), "NPI").when(F.col("license_hit").isNotNull(), "license #").otherwise("name+state")
    confidence = F.when(hard.isNotNull(), "definitive").when(backed, "corroborated").otherwise("name-only")
    return out.withColumn("via", via).withColumn("confidence", confidence).withColumn("hit", F.coalesce(hard, F.col("name_hit"))).drop("npi_hit", "license_hit", "name_hit")


def matched(entities: DataFrame, listed: DataFrame) -> DataFrame:
    """graded() matches of entities (uid, npi, license, name, state, city, entity_type, birthyear) with rows of merged(): by number, else by licence
    core, else by name and state; of several listed rows of a key the first. Keys are made distinct before the join, so no crowded name is multiplied."""
    out = entities.withColumn("npi", npi(F.col("npi"))).withColumn("license_core", F.when(F.length(license_core(F.col("license"))) >= 4, license_core(F.col("license"))))
    out = out.withColumn("name_key", F.nullif(name_key(F.col("name")), F.lit(""))).withColumn("state_key", F.nullif(F.upper(F.trim("state")), F.lit("")))
    record = F.struct(*COLUMNS)
    for hit, key in (("npi_hit", ["npi"]), ("license_hit", ["license_core"]), ("name_hit", ["name_key", "state_key"])):
        side = listed.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.min_by(record, "ord").alias(hit))
        out = out.join(side, key, "left")
    return graded(out).drop("license_core", "name_key", "state_key")

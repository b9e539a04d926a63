"""Normalizers and key functions over string columns; all of them Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate suffixes that a name key drops.
SUFFIXES = ["LLC", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LLP", "LP", "PLLC", "PS", "PC", "LTD", "DBA", "ENTERPRISE", "ENTERPRISES"]
# Street words and their postal abbreviations.
STREETS = {
    "STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "DRIVE": "DR", "BOULEVARD": "BLVD", "LANE": "LN", "COURT": "CT", "PLACE": "PL", "HIGHWAY": "HWY", "PARKWAY": "PKWY", "TERRACE": "TER", "CIRCLE": "CIR",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW", "SUITE": "STE", "APARTMENT": "APT", "BUILDING": "BLDG", "UNIT": "UNIT",
}


def blank(c: Column) -> Column:
    """Trimmed text, empty for null."""
    return F.coalesce(F.trim(c), F.lit(""))


def number(c: Column) -> Column:
    """Double, null for blanks, `NULL` and what isn't a number."""
    return F.nullif(F.trim(c), F.lit("NULL")).try_cast("double")


def money(c: Column) -> Column:
    """`$ 100,000.00` as a double; null where it isn't one."""
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("double")


def name_key(c: Column) -> Column:
    """Upper case without punctuation, corporate suffixes and a leading THE."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\.", ""), "[^A-Z0-9 ]", " ")
    s = F.trim(F.regexp_replace(s, rf"\b({'|'.join(SUFFIXES)})\b", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "^THE ", ""), " +", " "))


def upper_key(*columns: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.concat_ws(" ", *columns), r"\s+", " ")))


def phone(c: Column) -> Column:
    """Last ten digits; null with fewer."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def email(c: Column) -> Column:
    return F.lower(F.trim(c))


def license_core(c: Column) -> Column:
    """Digits without leading zeros."""
    return F.regexp_replace(F.regexp_replace(c, r"\D", ""), "^0+", "")


def letters(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def address_line(*columns: Column) -> Column:
    """Upper-cased address with postal abbreviations."""
    table = F.create_map(*[F.lit(x) for pair in STREETS.items() for x in pair])
    return F.array_join(F.transform(F.split(upper_key(*[blank(c) for c in columns]), " "), lambda w: F.coalesce(table[w], w)), " ")


def address_key(address: Column, city: Column | None = None, zip_code: Column | None = None) -> Column:
    """address_line of the parts; null where the address has no digit, or under eight characters."""
    out = address_line(address, *[c for c in (city, zip_code) if c is not None])
    return F.when(address.rlike(r"\d") & (F.length(out) >= 8), out)


def person_key(c: Column) -> Column:
    """First and last word of more than one letter, sorted; null with fewer than two."""
    words = F.filter(F.split(upper_key(c), " "), lambda w: F.length(w) > 1)
    return F.when(F.size(words) >= 2, F.array_join(F.array_sort(F.array(F.element_at(words, 1), F.element_at(words, -1))), " "))


def ein(c: Column) -> Column:
    """An employer's number: digits, nine at most."""
    return F.left(F.regexp_replace(blank(c), r"\D", ""), F.lit(9))


def fiscal(period: Column) -> Column:
    """Whether a period is a fiscal year, `FY2024`."""
    return period.rlike("^FY[0-9]{4}$")


def iso_day(c: Column) -> Column:
    """A date in one of the layouts of the lists, as yyyy-MM-dd: 20240131, 2024-01-31, 1/31/2024 or 31-JAN-2024, 1990 to 2035; empty where it is none."""
    text = F.trim(c)
    layouts = [(r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}-\d\d-\d\d", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d\d-[A-Za-z]{3}-\d{4}$", "dd-MMM-yyyy")]
    shown = {"yyyy-MM-dd": F.substring(text, 1, 10), "dd-MMM-yyyy": F.initcap(text)}
    found = F.coalesce(*[F.when(text.rlike(p), F.try_to_timestamp(shown.get(f, text), F.lit(f))) for p, f in layouts])
    return F.when(F.year(found).between(1990, 2035), F.date_format(found, "yyyy-MM-dd")).otherwise("")


def dollars(c: Column) -> Column:
    """`$1,234`, half-even as the texts write it."""
    return F.concat(F.lit("$"), F.format_number(F.bround(c, 0), 0))


def plural_of(a: Column, b: Column) -> Column:
    """Whether one word is the other with an S or ES, in any case."""
    x, y = F.upper(a), F.upper(b)
    return (x == F.concat(y, F.lit("S"))) | (x == F.concat(y, F.lit("ES"))) | (y == F.concat(x, F.lit("S"))) | (y == F.concat(x, F.lit("ES")))


def any_of(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike("|".join(words))


def year(c: Column) -> Column:
    """First year 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(c, r"(19|20)\d\d", 0), F.lit("")).cast("int")


def years(c: Column, first: int = 2000, last: int = 2035) -> Column:
    """All plausible years in a text."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(19|20)\d\d"), F.lit(0)), lambda y: y.cast("int")), lambda y: y.between(first, last))


def day(c: Column) -> Column:
    """ISO or US date at the start of a text; null where it isn't one."""
    head = F.substring(F.trim(c), 1, 10)
    return F.coalesce(F.try_to_timestamp(head, F.lit("yyyy-MM-dd")), F.try_to_timestamp(head, F.lit("MM/dd/yyyy"))).cast("date")


def serial_day(n: Column) -> Column:
    """Spreadsheet day number as a date."""
    return F.when(n.between(20000, 80000), F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of radius 6,371,000."""
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return 2 * 6_371_000.0 * F.asin(F.sqrt(h))


def one_edit(a: Column, b: Column) -> Column:
    """Whether a becomes b by one insertion, deletion, replacement or swap of neighbours."""
    swaps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.left(a, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))))
    return (F.levenshtein(a, b, 1) == 1) | ((F.length(a) == F.length(b)) & (F.length(a) >= 2) & (a != b) & F.array_contains(swaps, b))


def plain_html(c: Column) -> Column:
    """Tags to blanks, two entities decoded, white space collapsed."""
    s = F.regexp_replace(c, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "&amp;", "&"), "&nbsp;", " "), r"\s+", " "))


def operator_id(uids: Column) -> Column:
    return F.concat(F.lit("op:"), F.substring(F.md5(F.array_join(F.array_sort(uids), "|")), 1, 12))


def first_of(*cases: tuple[Column, object], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = reduce(lambda acc, x: acc.when(*x), cases[1:], F.when(*cases[0]))
    return out.otherwise(default)

"""What a name tells: brands, venues, institutions, generic names and professions, as Catalyst expressions over names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registrum.functions.text import blank, name_key

# Words too generic to tell an operator.
GENERIC = (
    "EARLY LEARNING CENTER CENTERS CENTRE CHILD CHILDS CHILDREN CHILDRENS CARE KIDS KID DAY DAYCARE CHILDCARE PRESCHOOL SCHOOL ACADEMY DEVELOPMENT CREATIVE LITTLE EDUCATION EDUCATIONAL "
    "PROGRAM PROGRAMS LEARNERS ENRICHMENT THE AND OF FOR A INC LLC CO CENTER'S AGE AGED SERVICES SERVICE FAMILY COMMUNITY HOUSE CLUB SITE CAMPUS ELEMENTARY ELEM"
).split()
# Site numbers, and words that brands write in two ways.
NUMERAL, ALIASES = r"^(#?\d+|[IVXLC]{1,5})$", {"MT": "MOUNT", "ST": "SAINT"}
# Names of places that host programs of others.
VENUES = [
    "COMMUNITY CENTER", "COMMUNITY DEVELOPMENT", "NEIGHBORHOOD CENTER", "DEVELOPMENT ASSOCIATION", "ELEMENTARY", r"\bELEM\b", "MIDDLE SCHOOL", "HIGH SCHOOL", r"\bK-?8\b", r"\bCHURCH\b", r"\bPARISH\b", r"\bTEMPLE\b", r"\bMOSQUE\b", r"\bSYNAGOGUE\b",
    r"\bFELLOWSHIP\b", r"\bYMCA\b", r"\bYWCA\b", "BOYS (&|AND) GIRLS", r"\bLIBRARY\b", r"\bCOLLEGE\b", r"\bUNIVERSITY\b", "PARKS (&|AND) REC", "RECREATION CENTER", r"\bGRANGE\b", r"\bLODGE\b",
]
# Names of public bodies, well-known charities, health systems, military and religious institutions.
INSTITUTIONS = [
    "SCHOOL DISTRICT", "PUBLIC SCHOOLS?", r"\bUNIVERSITY\b", r"\bCOLLEGE\b", r"\bCOUNTY\b", r"\bCITY OF\b", r"\bSTATE OF\b", r"\bPORT OF\b", r"\bTOWN OF\b", "HEAD START", r"\bYMCA\b", r"\bYWCA\b", "BOYS & GIRLS CLUB", "BOYS AND GIRLS CLUB", "COMMUNITY ACTION", "UNITED WAY", "SALVATION ARMY",
    r"\bGOODWILL\b", "CATHOLIC (CHARITIES|COMMUNITY)", r"\bTRIBE\b", r"\bTRIBAL\b", r"\bNATION\b", "PARKS? (AND|&) REC", "HOUSING AUTHORITY", "FIRE DISTRICT", r"\bMEDICAL CENTER\b", "REGIONAL HOSPITAL", r"\bECEAP\b", "COMMUNITY SERVICES ", "CHILDRENS HOME", "CHILDREN'S HOME SOCIETY", r"\bWESLEY\b", r"\bDIOCESE\b",
    r"\bPROVIDENCE\b", r"\bMULTICARE\b", r"\bSWEDISH\b", r"\bPEACEHEALTH\b", r"\bKAISER\b", r"\bFRANCISCAN\b", r"\bCONFLUENCE HEALTH\b", r"\bARMY\b", r"\bNAVY\b", r"\bAIR FORCE\b", r"\bJOINT BASE\b", r"\bFORT \w+", r"\bMWR\b", r"\bCYSS?\b", r"\bNAF\b", r"\bMCCHORD\b", r"\bJBLM\b",
    r"\bCHURCH\b", r"\bPARISH\b", r"\bLUTHERAN\b", r"\bBAPTIST\b", r"\bMETHODIST\b", r"\bPRESBYTERIAN\b", r"\bTEMPLE\b", r"\bMOSQUE\b", r"\bSYNAGOGUE\b", r"\bMINISTRIES\b", r"\bADVENTIST\b",
]
# School words that are often streets, the company words that make them so, and public mail domains.
SCHOOLS, COMPANIES, PUBLIC_DOMAINS = r"\bUNIVERSITY\b|\bCOLLEGE\b", r"\bLLC\b|\bL\.L\.C\b|\bINC\b|REHABILITATION|POST ACUTE|HEALTH ?CARE|CARE CENTER|NURSING|ASSISTED LIVING", ("mil", "gov")
# Words of credentials and specialties and their professions; the first that a text holds counts.
PROFESSIONS = [
    ("STUDENT", "STUDENT"), ("RESIDEN", "STUDENT"), ("PHYSICIAN ASSISTANT", "PA"), ("DENTIST", "DENTAL"), ("DENTAL", "DENTAL"), ("DENTUR", "DENTAL"), ("ORAL & MAXILLO", "DENTAL"), ("ORAL AND MAXILLO", "DENTAL"), ("CHIROPRAC", "CHIRO"), ("OPTOMETR", "OPTOM"), ("PODIATR", "PODIATRY"),
    ("NATUROPATH", "NATUROPATH"), ("MIDWIFE", "MIDWIFE"), ("PHARMAC", "PHARMACY"), ("MASSAGE", "MASSAGE"), ("NURS", "NURSING"), ("PSYCHOL", "BEHAVIORAL"), ("COUNSEL", "BEHAVIORAL"), ("SOCIAL WORK", "BEHAVIORAL"), ("BEHAVIOR ANALYST", "BEHAVIORAL"), ("MARRIAGE", "BEHAVIORAL"),
    ("PHYSICAL THERAP", "PT"), ("OCCUPATIONAL THERAP", "OT"), ("SPEECH", "SLP"), ("DIETIT", "DIET"), ("OSTEOPATH", "PHYSICIAN"), ("PHYSICIAN", "PHYSICIAN"), ("EMERGENCY MEDICINE", "PHYSICIAN"), ("SURG", "PHYSICIAN"),
]
# Two professions that one person can have.
COMPATIBLE = [("PHYSICIAN", "STUDENT"), ("NURSING", "STUDENT"), ("PA", "STUDENT"), ("NURSING", "MIDWIFE")]


def _dull(word: Column) -> Column:
    return word.isin(GENERIC) | word.rlike(NUMERAL)


def generic(key: Column) -> Column:
    """Whether a name key has words and all of them are generic or site numbers."""
    found = F.filter(F.split(key, " "), lambda w: w != "")
    return (F.size(found) > 0) & F.forall(found, lambda w: _dull(F.upper(w)))


def distinctive(name: Column) -> Column:
    """The words of a name that are neither generic nor site numbers."""
    return F.filter(F.split(name_key(name), " "), lambda w: (w != "") & ~_dull(w))


def without_site(key: Column) -> Column:
    """A name key without the site number at its end."""
    return F.trim(F.regexp_replace(F.coalesce(key, F.lit("")), r"\s*[-#]?\s*\d{1,3}$", ""))


def brand_key(name: Column) -> Column:
    """The first two distinctive words of a name, `MT` and `ST` written out. OF and AT end a brand that has begun. Empty under four characters."""
    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(False).alias("done"))

    def step(acc: Column, w: Column) -> Column:
        full = acc["done"] | (F.size(acc["words"]) >= 2)
        stop = w.isin("OF", "AT")
        written = F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[w], w)
        words = F.when(full | stop | (w == "") | _dull(w), acc["words"]).otherwise(F.array_append(acc["words"], written))
        return F.struct(words.alias("words"), (full | (stop & (F.size(acc["words"]) > 0))).alias("done"))

    out = F.aggregate(F.split(name_key(name), " "), start, step, lambda acc: F.array_join(acc["words"], " "))
    return F.when(F.length(out) >= 4, out).otherwise("")


def brand_or_name(name: Column) -> Column:
    """The brand, else the name key."""
    brand = brand_key(name)
    return F.when(brand != "", brand).otherwise(name_key(name))


def venue(name: Column, dba: Column | None = None) -> Column:
    """Whether the name or the trade name is that of a host."""
    pattern = "|".join(VENUES)
    out = F.upper(blank(name)).rlike(pattern)
    return out if dba is None else out | F.upper(blank(dba)).rlike(pattern)


def institution(name: Column, email: Column | None = None) -> Column:
    """Whether a name is an institution's, or the mail domain a public one. School words don't count in the name of a care company."""
    pattern, upper = "|".join(INSTITUTIONS), F.upper(blank(name))
    rest = F.regexp_replace(upper, SCHOOLS, " ")
    street = upper.rlike(SCHOOLS) & upper.rlike(COMPANIES)
    out = F.when(street, rest.rlike(pattern)).otherwise(upper.rlike(pattern))
    return out if email is None else out | F.element_at(F.split(F.lower(blank(email)), r"\."), -1).isin(*PUBLIC_DOMAINS) & blank(email).contains(".")


def profession(text: Column) -> Column:
    """The profession of a credential or specialty; null where none is known."""
    upper = F.upper(blank(text))
    return F.coalesce(*[F.when(upper.contains(word), F.lit(name)) for word, name in PROFESSIONS])


def professions_conflict(credential: Column, specialty: Column) -> Column:
    """Whether both professions are known, differ, and can't be one person's."""
    a, b = profession(credential), profession(specialty)
    pair = F.concat_ws("/", F.least(a, b), F.greatest(a, b))
    return F.coalesce((a != b) & ~pair.isin(["/".join(sorted(p)) for p in COMPATIBLE]), F.lit(False))

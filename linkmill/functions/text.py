"""Normalisation of names and addresses as Column -> Column functions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers before the part of a name that identifies it.
ALIAS_MARKERS = ["formerly known as", "formerly", "f/k/a", "fka", "t/a", "d/b/a", "dba", "a/k/a", "aka", "trading as", "doing business as"]
# Name tokens without identifying value.
NAME_STOP = """private pvt limited ltd llc l inc incorporated corp corporation co company llp plc pc pllc lp the and of m s ms
sarl sas sasu eurl snc sa ei sci public pty cie et de du des la le les www com net org in fr service services center centre id""".split()
# Canonical address words.
ADDRESS_WORDS = {
    "street": "st", "saint": "st", "str": "st", "road": "rd", "avenue": "ave", "av": "ave", "drive": "dr", "circle": "cir",
    "place": "pl", "lane": "ln", "court": "ct", "boulevard": "blvd", "bd": "blvd", "highway": "hwy", "parkway": "pkwy",
    "trail": "trl", "terrace": "ter", "square": "sq", "mount": "mt", "north": "n", "south": "s", "east": "e", "west": "w",
    "apartment": "apt", "suite": "ste", "sainte": "ste", "r": "rue", "chemin": "ch", "allee": "all", "impasse": "imp",
    "route": "rte", "number": "no", "house": "h", "floor": "fl", "near": "nr", "opposite": "opp", "nagar": "ngr",
    "colony": "col", "sector": "sec",
}
# The spelled ordinals from one to twenty.
ORDINALS = """first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth
sixteenth seventeenth eighteenth nineteenth twentieth""".split()
# Address tokens that make no blocking key.
ADDRESS_STOP = """st rd ave dr cir pl ln ct blvd hwy pkwy trl ter sq n s e w apt ste unit pmb po box no rue de du des la le les h fl
nr opp near null c o ward at post dist district tq taluk the and of floor ground first shop plot flat building bldg room""".split()
# The nine Indic scripts.
SCRIPTS = ["Devanagari", "Bengali", "Kannada", "Tamil", "Telugu", "Gujarati", "Gurmukhi", "Malayalam", "Oriya"]
# Legal forms and their classes.
FORM_CLASSES = {
    "llc": "llc", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "ltd": "ltd", "limited": "ltd",
    "llp": "llp", "plc": "plc", "pc": "pc", "pllc": "pllc", "lp": "lp", "co": "co", "company": "co", "pvt": "pvt",
    "private": "pvt", "public": "public", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "snc": "snc",
    "sa": "sa", "ei": "ei", "sci": "sci",
}
# Legal words that folded tokens leave out.
LEGAL_WORDS = """sas sasu sarl eurl sa sci snc ei cie inc llc ltd co corp corporation incorporated lp llp pvt private limited
company pc pllc""".split() + ["s a r l", "s a s", "s a"]
# Street and article words that stripped addresses leave out.
STREET_WORDS = """rue r avenue av ave boulevard bd blvd place pl impasse imp allee all chemin ch quai cours crs square sq residence
res route rte chaussee passage terrasse de du des la le les l d no n appt bis ter st street road rd drive dr lane ln court ct
circle cir way unit apt suite ste fl pmb null na""".split()
# Words that may stand between a house number and its street word.
BETWEEN = "rue ave blvd ch all imp rte de du des la le les n s e w no".split()
DOMAIN = r"\.(com|co\.in|in|fr|net|org|biz)\b"


def rx(pattern: str) -> str:
    """A pattern whose word classes and bounds are Unicode's."""
    return "(?U)" + pattern


@functools.cache
def latin_folding() -> tuple[str, str]:
    """Latin characters that decompose into one base character and marks, and these base characters."""
    found = {}
    for point in range(0xC0, 0x1F00):
        c = chr(point)
        if unicodedata.name(c, "").startswith("LATIN"):
            parts = unicodedata.normalize("NFKD", c)
            if len(parts) > 1 and all(unicodedata.category(m) == "Mn" for m in parts[1:]):
                found[c] = parts[0]
    return "".join(found), "".join(found.values())


def base_clean(c: Column) -> Column:
    """No accents on Latin letters, lower case. Marks of other scripts stay."""
    return F.lower(F.regexp_replace(F.translate(c, *latin_folding()), r"(\p{IsLatin})\p{Mn}+", "$1"))


def tokens_text(c: Column) -> Column:
    """Runs that are neither letters, numbers nor marks become one blank."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}]+", " "))


def without_junk(base: Column) -> Column:
    """N03."""
    for pattern, by in ((r"\(\s*id\s*:?\s*\d+\s*\)", " "), (r"#\s*\d+", " "), (r"\bwww\.", " "), (DOMAIN, " "), ("&", " and ")):
        base = F.regexp_replace(base, rx(pattern), by)
    return base


def native_pattern() -> str:
    return "[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS) + "]"


def is_native(c: Column) -> Column:
    """N04."""
    return c.rlike(native_pattern())


def is_domain(base: Column) -> Column:
    """N05."""
    return base.rlike(rx(DOMAIN + r"|^\W*@"))


def alias_pattern() -> str:
    return r"^(.*?)[\s,]*\b(?:" + "|".join(ALIAS_MARKERS) + r")\b[\s:,-]*(.+)$"


def has_alias(junk: Column) -> Column:
    return junk.rlike(rx(alias_pattern()))


def alias_part(junk: Column, part: int) -> Column:
    """What stands before (1) and behind (2) the first marker."""
    return F.regexp_extract(junk, rx(alias_pattern()), part)


def informative(core: Column) -> Column:
    """Tokens that are not stop words."""
    stop = F.array(*map(F.lit, NAME_STOP))
    return F.filter(F.split(core, " "), lambda t: (t != "") & ~F.array_contains(stop, t))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def address_tokens(address: Column) -> Column:
    """Placeholders and # removed; zero padding, ordinal endings, canonical words."""
    base = base_clean(address)
    base = F.regexp_replace(base, rx(r"<\s*null\s*>|\bnull\b|\bnone\b|\bn/a\b"), " ")
    words = literal_map(ADDRESS_WORDS | {w: str(k) for k, w in enumerate(ORDINALS, 1)})

    def canonical(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, r"^0+(\d)", "$1"), r"^(\d+)(st|nd|rd|th)$", "$1")
        return F.coalesce(F.try_element_at(words, t), t)

    return F.filter(F.transform(F.split(tokens_text(F.regexp_replace(base, "#+", " ")), " "), canonical), lambda t: t != "")


def number_street(norm: Column, part: int) -> Column:
    """House number (1) and first street word (2), empty if there is none."""
    return F.regexp_extract(norm, rx(r"\b(\d+[a-z]?)\s+(?:(?:" + "|".join(BETWEEN) + r")\s+)*([a-z]{3,}|\d+)"), part)


def folded(c: Column) -> Column:
    """Plain ASCII letters, digits and blanks, without any marks."""
    bare = F.lower(F.regexp_replace(F.translate(c, *latin_folding()), r"\p{M}", ""))
    return F.regexp_replace(bare, "[^a-z0-9 ]", " ")


def fold_tokens(name: Column) -> Column:
    """Sorted distinct tokens of two letters or more, without legal words."""
    plain = F.regexp_replace(folded(name), r"\b(" + "|".join(LEGAL_WORDS) + r")\b", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, " "), lambda t: F.char_length(t) >= 2)))


def first_number(address: Column) -> Column:
    """Null if there is none."""
    return F.regexp_replace(F.nullif(F.regexp_extract(F.coalesce(address, F.lit("")), r"(\d+)", 1), F.lit("")), r"^0+(\d)", "$1")


def strip_address(address: Column) -> Column:
    """N23."""
    plain = F.regexp_replace(folded(F.coalesce(address, F.lit(""))), r"\b(" + "|".join(STREET_WORDS) + r")\b", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def fold_key(name: Column, legal: bool = True) -> Column:
    """The folded name without blanks, and without legal words if ``legal`` is false."""
    plain = folded(name)
    if not legal:
        plain = F.regexp_replace(plain, r"\b(" + "|".join(LEGAL_WORDS) + r")\b", " ")
    return F.regexp_replace(plain, " +", "")


# Spaced spellings of legal forms, and the forms.
SPACED_FORMS = [("s a r l", "sarl"), ("s a s u", "sasu"), ("s a s", "sas"), ("e i", "ei"), ("s c i", "sci"), ("s n c", "snc"), ("s a", "sa")]
LEGAL_FORMS = ["sas", "sasu", "sarl", "eurl", "sa", "sci", "snc", "ei", "cie"]


def legal_forms_spaced(name: Column) -> Column:
    """Legal forms in a name, spaced spellings included, digits as blanks; sorted and distinct."""
    plain = F.regexp_replace(folded(name), "[^a-z ]", " ")
    for spaced, joined in SPACED_FORMS:
        plain = F.regexp_replace(plain, rx(rf"\b{spaced}\b"), joined)
    forms = F.array(*map(F.lit, LEGAL_FORMS))
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, " "), lambda t: F.array_contains(forms, t))))


# Addresses that stand for none.
EMPTY_ADDRESSES = ["", "null", "<null>", "none"]


def address_missing(address: Column) -> Column:
    """N26."""
    return F.lower(F.trim(F.coalesce(address, F.lit("")))).isin(EMPTY_ADDRESSES)


def form_classes(full: Column) -> Column:
    """distinct classes of the legal forms among the tokens of a name, sorted."""
    words = literal_map(FORM_CLASSES)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(full, " "), lambda t: F.try_element_at(words, t)), lambda t: t.isNotNull())))


# Words for a unit, here and the patterns below.
UNIT_WORDS = "flat unit apt apartment suite ste room rm office shop door plot floor bldg building block".split()


def raw_address(address: Column) -> Column:
    return F.regexp_replace(F.lower(address), rx(r"\b0+(\d)"), "$1")


def number_tokens(address: Column) -> Column:
    """distinct number tokens of the raw address, compounds such as 5/101 whole; sorted."""
    found = F.regexp_extract_all(raw_address(address), F.lit(rx(r"\b([a-z]?-?\d+[a-z]*(?:[-/][a-z0-9]+)*)")), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, "^-+", ""))))


def unit_number(address: Column) -> Column:
    """the number behind the first unit word, null if there is none."""
    pattern = rx("(?:" + "|".join(UNIT_WORDS) + r")\.?\s*(?:no\.?|number|#)?\s*[:#]?\s*([a-z]?-?\d+[a-z]?(?:[-/][a-z0-9]+)*)")
    return F.regexp_replace(F.nullif(F.regexp_extract(raw_address(address), pattern, 1), F.lit("")), "^-+", "")

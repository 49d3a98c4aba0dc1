"""Personal names. Token loops run in pandas UDFs over Arrow batches; the rest are column expressions."""

from __future__ import annotations

import re
import unicodedata
from itertools import takewhile

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the comparison key: particles of surnames, and words that are no part of a name.
KEY_PARTICLES = {"van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "op", "st"}
KEY_SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "phd", "md", "prof", "dr"}

# Fixed values of display names: particles, titles that go, and suffixes that are never a forename.
PARTICLES = {"van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "op", "zu"}
HONORIFICS = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "phd", "md", "msc", "bsc"}

# Scripts in which names have no initials, dashes that become hyphens, letters that have no accent to drop.
NON_LATIN = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\u0400-\u04ff\u0370-\u03ff\u0600-\u06ff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
FOLDS = {"ı": "i", "İ": "i", "ł": "l", "Ł": "l", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ß": "s", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe"}

# Titles before a single name and suffixes after it, which a parser of personal names takes for no name of
# their own. Two words are too few for it to join particles or conjunctions, so that these need no list here.
TITLES = (
    "admiral", "ambassador", "archbishop", "associate", "attorney", "aunt", "auntie", "baron", "baroness", "baronet", "bishop", "brigadier", "brother",
    "canon", "capt", "captain", "cardinal", "chairman", "chancellor", "chaplain", "chief", "cllr", "cmdr", "col", "colonel", "commander", "commissioner", "congressman", "congresswoman", "corporal", "councillor", "count", "countess", "cpl", "cpt",
    "dame", "deacon", "dean", "deputy", "director", "doctor", "dr", "duchess", "duke", "earl", "emperor", "empress", "father", "fr", "gen", "general", "gov", "governor", "hon", "honorable", "honourable", "judge", "justice", "king",
    "lady", "lieutenant", "lord", "lt", "ltc", "madam", "madame", "maj", "major", "marquess", "marquis", "marshal", "master", "mayor", "messrs", "minister", "miss", "monsignor", "mother", "mr", "mrs", "ms", "msgr", "mx",
    "officer", "pastor", "pope", "president", "priest", "prince", "princess", "private", "prof", "professor", "provost", "queen", "rabbi", "rear", "rep", "representative", "rev", "reverend",
    "secretary", "sen", "senator", "sergeant", "sgt", "sheikh", "sheriff", "sir", "sister", "sultan", "superintendent", "treasurer", "uncle", "vice", "viscount", "viscountess", "warden",
)
AFTER_NAMES = ("jr", "jnr", "junior", "sr", "snr", "ii", "iii", "iv", "v", "esq", "esquire", "phd", "md", "dds", "dphil", "obe", "mbe", "cbe", "frs", "mba", "msc", "bsc")


def normalise_name(c: Column) -> Column:
    """Commas and stops deleted; two full words become surname and initial; other forms stay.

    A title with a surname, or a name with a suffix, lacks one of the two and stays as well.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(c, "[,.]", ""), r"(?U)\s+", " "))
    parts = F.split(text, " ")
    short = F.forall(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.length(p) <= 2)
    lacking = F.lower(F.get(parts, 0)).isin(*TITLES) | F.lower(F.get(parts, 1)).isin(*AFTER_NAMES)
    return F.when((F.size(parts) == 2) & ~short & ~lacking, F.concat(F.get(parts, 1), F.lit(" "), F.substring(F.get(parts, 0), 1, 1))).otherwise(text)


def split_display_name(raw: Column, given_hint: Column | None = None) -> Column:
    """P50: struct(given, surname): a hint, the comma form, or the last word as surname."""
    text = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
    hint = F.coalesce(F.trim(given_hint), F.lit("")) if given_hint is not None else F.lit("")
    parts = F.split(text, " ")
    without = F.trim(F.when(F.lower(text).startswith(F.lower(hint)), F.substring(text, F.length(hint) + 1, F.length(text))).otherwise(text))
    comma = F.struct(F.trim(F.substring_index(text, ",", -1)).alias("given"), F.trim(F.substring_index(text, ",", 1)).alias("surname"))
    last = F.struct(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ").alias("given"), F.element_at(parts, -1).alias("surname"))
    hinted = F.struct(hint.alias("given"), F.when(without != "", without).otherwise(F.element_at(parts, -1)).alias("surname"))
    return F.when(text.isNull() | (text == ""), None).when(text.contains(","), comma).when(hint != "", hinted).otherwise(last)


def given_name_key(c: Column) -> Column:
    """The first word, accents folded; null where all words are single letters or none is there."""
    from .text import strip_accents

    words = F.filter(F.split(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z\s]", " "), r"\s+"), lambda w: w != "")
    return F.when(F.exists(words, lambda w: F.length(w) > 1), F.get(words, 0))


def strip_identifiers(c: Column) -> Column:
    """struct(name, orcid): identifiers with their labels taken out of a name; dashes made plain, orcid null if there was none."""
    number = r"\d{4}-\d{4}-\d{4}-\d{3}[\dXx]"
    text = F.translate(c, DASHES, "-" * len(DASHES))
    orcid = F.nullif(F.upper(F.regexp_extract(text, number, 0)), F.lit(""))
    name = text
    for pattern, to in ((rf"(?iU)[;,]?\s*(?:id_)?orcid[:\s]*{number}\s*", " "), (number, " "), (r"(?iU)\bid_orcid\b", " "), (r"(?U)\s*;\s*", "; "), (r"(?U)\s+", " "), ("^[ ;,]+|[ ;,]+$", "")):
        name = F.regexp_replace(name, pattern, to)
    return F.struct(name.alias("name"), orcid.alias("orcid"))


# ------------------------------------------------------------------ token loops
def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _in_order(tokens: list[str], particles: set[str], is_initials) -> tuple[list[str], list[str]]:
    """(surname, given) of words without a comma: initials at the end follow a surname, else the last word is one, with the particles before it."""
    initials = sum(1 for _ in takewhile(is_initials, reversed(tokens[1:])))
    if initials:
        return tokens[:-initials], tokens[-initials:]
    before = sum(1 for _ in takewhile(lambda t: t.strip(".").lower() in particles, reversed(tokens[:-1])))
    at = max(0, len(tokens) - 1 - before)
    return tokens[at:], tokens[:at]


def comparison_key(name: str | None) -> str:
    """Surname and first initial in lower case; a key for comparing, never for display.

    Of words without a comma, those of one or two letters at the end are initials, in either case.
    """
    if name is None or name != name:  # nan
        return ""
    text = re.sub(r"[^\w\s,\-']", " ", re.sub(r"\([^)]*\)", " ", _fold(name)))
    family, given = ([t for t in part.split() if t.lower() not in KEY_SUFFIXES] for part in text.partition(",")[::2])
    if "," not in text:
        family, given = _in_order(family, KEY_PARTICLES, lambda t: len(t) <= 2)
    if not family:
        return ""
    return f"{' '.join(family)} {given[0][0] if given else ''}".strip().lower()


def _plain(text: str | None) -> str:
    return "" if text is None or text != text else text.translate(dict.fromkeys(map(ord, DASHES), "-"))


def _name_words(text: str | None) -> list[str]:
    """Words of a name, without brackets, titles, bare numbers and stray punctuation."""
    words = re.sub(r"[^\w\s\-'.’]", " ", re.sub(r"\([^)]*\)", " ", _plain(text))).split()
    return [w for w in words if w.strip(".").lower() not in HONORIFICS and not w.strip(".").isdigit()]


def _no_suffixes(words: list[str]) -> list[str]:
    return [w for w in words if w.strip(".").lower() not in SUFFIXES]


def case_token(token: str, particle: bool = True) -> str:
    """One word in name case; words that mix cases stay, particles are lower case."""
    if not (token.isupper() or token.islower()):
        return token
    if particle and token.strip(".").lower() in PARTICLES:
        return token.strip(".").lower()
    return re.sub(r"[^\-'’]+", lambda m: m[0][:1].upper() + m[0][1:], token.lower())


def is_initials(token: str) -> bool:
    """Single letters with stops between, one letter, or two capitals; a letter of another script is a whole name."""
    letters = re.sub("[.'’]", "", token)
    if not letters or re.search(f"[{NON_LATIN}]", letters):
        return False
    dotted = "." in token and all(len(part) <= 1 for part in token.split("."))
    return dotted or len(letters) == 1 or (len(letters) == 2 and letters.isupper())


def _split_raw(raw: str | None) -> tuple[str, str]:
    """(given, surname) of a name in one string."""
    if "," in (raw or ""):
        surname, given = (_name_words(part) for part in raw.partition(",")[::2])
    else:
        surname, given = _in_order(_no_suffixes(_name_words(raw)), PARTICLES, is_initials)
    return " ".join(given), " ".join(surname)


def _match_form(text: str) -> str:
    return _fold(_plain(text).lower()).translate(str.maketrans(FOLDS)).strip()


def resolve_parts(given: str | None, surname: str | None, raw: str | None) -> tuple[str, str]:
    """(given, surname): a lacking surname comes from the raw name, a lacking given name from what the raw name has beside the surname.

    Particles at the end of the given name go before the surname.
    """
    given, surname, raw = ("" if x is None or x != x else x.strip() for x in (given, surname, raw))
    if not surname:
        given, surname = _split_raw(raw)
    elif not given:
        one, other = _split_raw(raw)  # in either order: "Zhang Jianguo" may be a surname and a given name
        if one and _match_form(other) == _match_form(surname):
            given = one
        elif other and _match_form(one) == _match_form(surname):
            given = other
    words = given.split()
    moved = sum(1 for _ in takewhile(lambda t: t.strip(".").lower() in PARTICLES, reversed(words)))
    if moved and surname:
        given, surname = " ".join(words[:-moved]), " ".join([*words[-moved:], surname])
    return given, surname


def display_name(given: str | None, surname: str | None, raw: str | None) -> str:
    """``Surname, Given`` with cases repaired, initials spaced out, titles and suffixes gone; the raw name, with its cases repaired, where no surname is found."""
    given, surname = resolve_parts(given, surname, raw)
    first: list[str] = []
    for t in _no_suffixes(_name_words(given)):
        first += [f"{c.upper()}." for c in re.sub("[.'’]", "", t)] if is_initials(t) else [case_token(t, particle=False)]
    last, first_names = (" ".join(words).strip("- \u2013\u00a0") for words in ([case_token(t) for t in surname.split()], first))
    if last:
        return f"{last}, {first_names}" if first_names else last
    return " ".join(case_token(t) for t in _plain(raw).split())


def completeness(display: Column) -> Column:
    """Unparsed, surname_only, initials_only, or full_forename where a given name has over two letters."""
    given = F.when(display.contains(","), F.substring_index(display, ",", -1)).otherwise("")
    tokens = F.filter(F.split(F.trim(given), r"\s+"), lambda t: t != "")
    return (
        F.when(F.coalesce(F.trim(display), F.lit("")) == "", "unparsed")
        .when(F.size(tokens) == 0, "surname_only")
        .when(F.exists(tokens, lambda t: F.length(F.replace(t, F.lit("."), F.lit(""))) > 2), "full_forename")
        .otherwise("initials_only")
    )


def flags(raw: Column, display: Column) -> Column:
    """Reasons to look at a name again, joined by "; "; empty if there are none."""
    reasons = {
        "identifier_in_name": raw.rlike(r"(?i)\d{4}-\d{4}-\d{4}-\d{3}[\dx]|id_orcid"),
        "non_latin_script": raw.rlike(f"[{NON_LATIN}]"),
        "digits_remain": display.rlike(r"\d"),
        "unusually_long": F.length(display) > 60,
    }
    return F.array_join(F.array_compact(F.array(*[F.when(found, F.lit(reason)) for reason, found in reasons.items()])), "; ")


def key_column(c: Column) -> Column:
    """P48 over Arrow batches."""
    return F.pandas_udf(lambda s: s.map(comparison_key), "string", F.PandasUDFType.SCALAR)(c)


def display_column(given: Column, surname: Column, raw: Column) -> Column:
    """P52 over Arrow batches."""
    import pandas as pd

    return F.pandas_udf(lambda g, s, r: pd.Series([display_name(*x) for x in zip(g, s, r)], dtype=object), "string", F.PandasUDFType.SCALAR)(given, surname, raw)

"""Text cleaners and comparison keys, as column expressions.

Regular expressions carry ``(?U)`` where classes must be Unicode-aware, as the
reference semantics are; a pandas UDF is used only for Unicode normal forms, which
Spark has no function for.
"""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wrongly decoded sequences and what they stand for.
REPLACEMENTS = {
    "‚Äì": "–",
    "‚Äî": "—",
    "‚Äò": "'",
    "‚Äô": "'",
    "‚Äú": '"',
    "‚Äù": '"',
    "‚Ä¶": "...",
    "‚Ä¢": "•",
    "‚Ñ¢": "™",
    "â€“": "–",
    "â€”": "—",
    "â€˜": "'",
    "â€™": "'",
    "â€œ": '"',
    "â€\x9d": '"',
    "â€¦": "...",
    "â€¢": "•",
    "â„¢": "™",
    "Â£": "£",
    "&quot;": '"',
    "&amp;": "&",
    "&lt;": "<",
    "&gt;": ">",
    "&#39;": "'",
    "\xa0": " ",
    "Â": "",
}

# Whole texts that stand for a missing one (case-insensitive patterns).
PLACEHOLDERS = (
    r"^\s*$",
    r"^nil$",
    r"^null$",
    r"^none$",
    r"^n/?a\.?$",
    r"^n\.?a\.?$",
    r"^abstract to follow$",
    r"^abstracts are not currently available in gtr.*$",
    r"^awaiting public project summary$",
    r"^tbc$",
    r"^no public description$",
    r"^not available$",
    r"^not provided$",
    r"^not applicable$",
)


def unescape_html(c: Column) -> Column:
    """Decode character references as HTML 5 does: all its names, with or without a semicolon, and its table of codes.

    Only texts with ``&`` travel to Python; all others pass untouched.
    """
    import pandas as pd

    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    some = F.when(c.contains("&"), c)
    return F.coalesce(F.pandas_udf(decode, "string", F.PandasUDFType.SCALAR)(some), c)


def _let(value: Column, f) -> Column:
    """``f(value)``, with the value worked out once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


# What is deleted or replaced, in this order. The first entry is a test that any text with a match passes.
CLEANING = (
    ("<", r"<[^>]+>", ""),
    (r"[*_`#]", r"[*_`#]+", ""),
    (r"[•●▪◦]", r"[•●▪◦]", "-"),
    ("%%%", r"%{3,}", " "),
    (r"http|www\.", r"(?U)https?://\S+|www\.\S+", ""),
    ("@", r"(?U)\b[\w\.-]+@[\w\.-]+\.\w+\b", ""),
    (r"\]\[", r"\[[^\]]+\]\[\d+\]", ""),
    (r"\]:", r"\[\d+\]:.*", ""),
    (r"[\[\]]", r"[\[\]]", ""),
    (r"(?U)\s\s|[^\S ]", r"(?U)\s+", " "),
)


def clean_text(c: Column) -> Column:
    """Strip markup, encoding artefacts, links and addresses; null where nothing but punctuation and symbols is left.

    A pattern runs over the texts that pass its test only; most pass none.
    """
    starts = "".join(sorted({k[0] for k in REPLACEMENTS}))
    out = _let(unescape_html(c), lambda x: F.when(x.rlike(f"[{starts}]"), reduce(lambda y, kv: F.replace(y, F.lit(kv[0]), F.lit(kv[1])), REPLACEMENTS.items(), x)).otherwise(x))
    for test, pattern, to in CLEANING:
        out = _let(out, _guarded(test, pattern, to))
    return _let(F.trim(out), lambda x: F.when(x.rlike(r"(?U)[^\p{P}\p{S}\s]"), x))


def _guarded(test: str, pattern: str, to: str):
    return lambda x: F.when(x.rlike(test), F.regexp_replace(x, pattern, to)).otherwise(x)


def clean_copies(df: DataFrame, *columns: str) -> DataFrame:
    """A cleaned ``<column>_clean`` beside each of the columns that exist."""
    return df.withColumns({f"{c}_clean": clean_text(F.col(c)) for c in columns if c in df.columns})


def null_placeholders(c: Column) -> Column:
    """Placeholder texts become null, and a leading "Abstract" goes."""
    blank = reduce(lambda a, b: a | b, [c.rlike(f"(?i){p}") for p in PLACEHOLDERS])
    return F.when(c.isNull() | blank, None).otherwise(F.regexp_replace(c, r"(?i)^abstract\s*", ""))


def each_string(df: DataFrame, f) -> DataFrame:
    """Apply ``f`` to every string column."""
    names = [x.name for x in df.schema if isinstance(x.dataType, T.StringType)]
    return df.withColumns({n: f(F.col(f"`{n}`")) for n in names}) if names else df


def trim_all(df: DataFrame) -> DataFrame:
    """Every string trimmed of white space."""
    return each_string(df, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def collapse(c: Column) -> Column:
    """Trimmed, inner white space as one space, empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def match_text(c: Column) -> Column:
    """P20: lower case without punctuation, for matching; empty for null."""
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))


def match_identifier(c: Column) -> Column:
    """P20: lower-case letters and digits only; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))


def match_key(project: Column, text: Column) -> Column:
    return F.concat_ws("||", F.coalesce(project, F.lit("")), text)


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, in Arrow batches."""
    return _normal("NFKC")(c)


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition with everything but ASCII dropped."""
    return _normal("ASCII")(c)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _normal("MARKS")(c)


def _normal(form: str):
    import unicodedata

    def one(text):
        if text is None:
            return None
        if form == "NFKC":
            return unicodedata.normalize("NFKC", text)
        loose = unicodedata.normalize("NFKD", text)
        if form == "ASCII":
            return loose.encode("ascii", "ignore").decode()
        return "".join(x for x in loose if not unicodedata.combining(x))

    return F.pandas_udf(lambda s: s.map(one), "string", F.PandasUDFType.SCALAR)


def comparison_key(c: Column, kind: str, compatibility: bool = True) -> Column:
    """The form in which values of a column are compared. ``organisation`` gives a sorted set of names, others text.

    ``compatibility`` folds Unicode compatibility forms, which takes a Python pass; plain data can do without.
    """
    text = F.lower(F.trim(c))
    text = nfkc(text) if compatibility else text
    if kind == "doi":
        return F.regexp_replace(text, r"(?U)\s+", "")
    if kind in ("source_title", "journal"):
        for pattern, to in ((r"(?U)\s*&\s*", " and "), (r"\([^)]*\)", " "), (r":.*$", ""), (r"-.*$", ""), (r"(?U)[^\w\s]", " "), (r"(?U)\s+", " ")):
            text = F.regexp_replace(text, pattern, to)
        return F.trim(text)
    if kind in ("title", "abstract", "description"):
        for pattern, to in ((r"(?U)[^\w\s]", ""), (r"(?U)\s+", " ")):
            text = F.regexp_replace(text, pattern, to)
        return F.trim(text)
    if kind == "organisation":
        text = F.regexp_replace(text, r"(?U)\s*\([^)]*\)", "")
        names = F.transform(F.split(F.regexp_replace(text, r"(?U)\s+", " "), ";"), lambda x: F.trim(x))
        return F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))), F.array().cast("array<string>"))
    return text


def remap(c: Column, mapping: dict[str, str]) -> Column:
    """Listed values replaced, others kept."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c), c) if mapping else c


def map_list(c: Column, f, separator: str = ";", joiner: str = "; ") -> Column:
    """Each item of a delimited list mapped; empty ones dropped; null if none is left."""
    items = F.filter(F.transform(F.split(c, separator), lambda x: f(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(items) > 0, F.array_join(items, joiner))


def without_parentheses(c: Column) -> Column:
    """P24"""
    return F.regexp_replace(c, r"\([^)]*\)", "")


def search_title(c: Column) -> Column:
    """A title as a query keeps it: the separator of alternatives becomes a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\|", " "), r"(?U)\s+", " "))


def simplified_title(c: Column) -> Column:
    """Cut at the colon, punctuation to spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(c, ":", 1), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def slug(c: Column, length: int = 60, empty: str = "unnamed") -> Column:
    """Lower-case letters and digits joined by hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, length), "-+$", "")
    return F.coalesce(F.when(s != "", s), F.lit(empty))


# ------------------------------------------------------------------ organisations
# Words that two names of one organisation may differ in.
STOP_WORDS = r"\b(the|of|and)\b"
COMPANY_SUFFIXES = r"\b(ltd|limited|plc|llp|lp|inc|incorporated|gmbh|bv|cic|uk)\b"

# Types of organisations in order of precedence, with the words that show them.
ORGANISATION_TYPES = (
    ("healthcare", r"\bnhs\b|\bhospital\b|\bhealth board\b|\bhealth trust\b"),
    ("education", r"universit|\bcollege\b|\bucl\b|london school of|\blondon sch\b|\bpolytechnic\b|\bschool of\b"),
    ("company", r"\bltd\b|\blimited\b|\bplc\b|\bp l c\b|\bllp\b|\binc\b|\bincorporated\b|\bcorp\b|\bcorporation\b|\bgmbh\b|\bcompany\b|\bholdings\b|\bpartnership\b|\blp\b|\bbv\b|\bab\b|\bcyf\b|\bpty\b"),
    ("government", r"\bcouncil\b|\bborough\b|\bgovernment\b|\bdefra\b|\bministry\b|\bcounty\b|\bagency\b|\bnational health\b"),
    ("nonprofit", r"\binstitute\b|\binstitution\b|\bcentre\b|\bcenter\b|\blaborator|\bacademy\b|\bfoundation\b|\bsociety\b|\bassociation\b|\btrust\b|\bmuseum\b|\bresearch council\b|\bcharity\b|\bcic\b|\bcatapult\b|\bsurvey\b"),
)
RESEARCH_WORDS = r"\binstitute\b|\bcentre\b|\bcenter\b|\blaborator|\bacademy\b|\bfoundation\b|\bsociety\b|\bassociation\b|\bcatapult\b|\bcouncil\b|\bsurvey\b|\bmuseum\b|\bobservatory\b"


def organisation_key(c: Column, fold: bool = True) -> Column:
    """ASCII, lower case, punctuation to spaces, without the/of/and. ``fold=False`` for names known to be ASCII."""
    text = F.lower(F.trim(ascii_fold(c) if fold else c))
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 ]", " "), STOP_WORDS, " ")
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def company_key(c: Column, fold: bool = True) -> Column:
    """The organisation key without legal suffixes; full stops are deleted first."""
    key = organisation_key(F.regexp_replace(c, r"\.", ""), fold)
    return F.trim(F.regexp_replace(F.regexp_replace(key, COMPANY_SUFFIXES, " "), r"\s+", " "))


def _forms(c: Column) -> list[Column]:
    low = F.lower(c)
    return [F.trim(F.regexp_replace(F.regexp_replace(low, r"\.", to), r"\s+", " ")) for to in ("", " ")]


def organisation_type(c: Column) -> Column:
    """The first type of which a word occurs, with stops deleted or as spaces."""
    forms = _forms(c)
    out = F
    for label, pattern in ORGANISATION_TYPES:
        out = out.when(reduce(lambda a, b: a | b, [f.rlike(pattern) for f in forms]), label)
    return out.otherwise("unknown")


def organisation_type_of_variants(variants: Column) -> Column:
    """Rules in order, each over all variants."""
    out = F
    for label, pattern in ORGANISATION_TYPES:
        out = out.when(F.exists(variants, lambda v: reduce(lambda a, b: a | b, [f.rlike(pattern) for f in _forms(v)])), label)
    return out.otherwise("unknown")


def needs_lookup(kind: Column, name: Column) -> Column:
    """All but companies, and companies named like research bodies."""
    return (kind != "company") | F.lower(name).rlike(RESEARCH_WORDS)


def name_shape(c: Column) -> Column:
    """How a personal name is written; stops don't count. Null for null."""
    words = F.filter(F.split(F.regexp_replace(c, r"[,.]", ""), r"(?U)\s+"), lambda w: w != "")
    initials = F.forall(F.slice(words, 2, 1000), lambda w: F.length(w) <= 2)
    return (
        F.when(c.isNull(), None)
        .when(c.contains(","), "comma form")
        .when(F.size(words) < 2, "single token")
        .when(initials, "surname + initials")
        .when(F.size(words) == 2, "two parts")
        .otherwise("three or more parts")
    )


# ------------------------------------------------------------------ screening
# Patterns of the three tiers.
TIER1 = (r"circular econom\w*", r"circular \w+ econom\w*", r"circular \w+ \w+ econom\w*", r"industrial symbiosis", r"urban mining", r"remanufactur\w*", r"circular bioeconom\w*", r"cradle[\s-]to[\s-]cradle", r"reverse logistics")
TIER2 = (
    r"circularity",
    r"technical cycle",
    r"biological cycle",
    r"refurbish\w*",
    r"secondary material\w*",
    r"non-virgin",
    r"virgin material\w*",
    r"design out waste",
    r"regenerative production",
    r"regenerati\w*\s+(?:nature|natural system\w*|design)",
    r"industrial ecology",
)
TIER3 = (r"recycl\w*", r"reus\w*", r"re-us\w*", r"repair\w*", r"recover\w*", r"repurpos\w*", r"closed[\s-]loop", r"anaerobic digestion", r"waste hierarchy", r"resource efficien\w*")


def matched_patterns(text: Column, patterns) -> Column:
    """The patterns that occur at the start of a word, any case."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?iU)\b{p}"), F.lit(p)) for p in patterns]))


def screen(df: DataFrame, *columns: str, tiers=(TIER1, TIER2, TIER3)) -> DataFrame:
    """Adds tier1, tier2, tier3 (matched patterns) and decision (keep or drop).

    Kept: one of tier 1, two of tier 2, or one of tier 2 with one of tier 3.
    """
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    df = df.withColumns({f"tier{i}": matched_patterns(text, t) for i, t in enumerate(tiers, 1)})
    n = [F.size(f"tier{i}") for i in (1, 2, 3)]
    return df.withColumn("decision", F.when((n[0] >= 1) | (n[1] >= 2) | ((n[1] >= 1) & (n[2] >= 1)), "keep").otherwise("drop"))


# ------------------------------------------------------------------ casts
# Words for true and false.
TRUE_VALUES = ("true", "t", "yes", "y", "1", "1.0")
FALSE_VALUES = ("false", "f", "no", "n", "0", "0.0")


def to_boolean(c: Column) -> Column:
    """P03"""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*TRUE_VALUES), True).when(text.isin(*FALSE_VALUES), False)


def to_number(c: Column) -> Column:
    """Null where the text is no number."""
    return c.cast("string").try_cast("double")


def to_timestamp_ms(c: Column) -> Column:
    """From milliseconds since the epoch."""
    return F.timestamp_millis(c.cast("string").try_cast("double").cast("bigint"))


def day_text(c: Column) -> Column:
    """A time's day as year, month and day; the year in four digits or, after 9999, in as many as it has, without a sign."""
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd"), r"^\+", "")

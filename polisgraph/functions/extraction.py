"""Facts taken out of names and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Committees that no single candidate controls.
NOT_A_CANDIDATE = (
    r"Political Action Committee",
    r"\bPAC\b",
    r"\b(?:Yes|No) on\b",
    r"^Committee for\b",
    r"&",
    r",.*,",
    r"\b(?:Alliance|Coalition|Initiative|Foundation)\b",
    r"^Stay\b",
)

# Where a committee's name holds its candidate's, in order.
CANDIDATE_IN_NAME = (
    r"^Friends of (.+?) for ",
    r"Committee to (?:Re-)?Elect (.+?)(?:\s+for\s+|\s+District\b|\s+\d{4})",
    r"^Re-Elect (.+?) for ",
    r"^Elect (.+?) for ",
    r"^(.+?) for .+\b\d{4}\b",
)


def candidate_name(committee: str) -> Column:
    """The candidate's name in a committee's; null if there is none or it holds a digit."""
    c = F.col(committee)
    out = []
    for pattern in CANDIDATE_IN_NAME:
        name = F.regexp_replace(F.trim(F.regexp_extract(c, f"(?i){pattern}", 1)), r"\s+", " ")
        out.append(F.when((name != "") & ~name.rlike("[0-9]"), name))
    skip = F.lit(False)
    for pattern in NOT_A_CANDIDATE:
        skip = skip | c.rlike(f"(?i){pattern}")
    return F.when(~skip, F.coalesce(*out))


# Phrases that tell the form of minutes, the first that fits; other minutes are of the last form.
MINUTES_FORMS = (
    (r"M/s\s+Supervisor\s+\w", "bos"),
    (r"moved\s+by\s+Supervisor\s+\w+\s+and\s+seconded\s+by\s+Supervisor", "bos"),
    (r"MOTION:\s+It was M/S/C", "cortemadera"),
    (r"\w+\s+moved,\s+seconded by\s+(?:Councilmember|Vice Mayor|Mayor)\s+\w+", "sausalito"),
)
OTHER_MINUTES = "novato"

# Items and headings by which forms of agendas are told, and how often they must occur.
AGENDA_MARKS = {
    "tiburon": r"(?:CC|AI|PH)-\d+\.",
    "bos": r"CA\s*-\s*\d+\.",
    "number_letter": r"(?m)^\s+\d+\.[A-Z]\.?\s+",
    "letter_number": r"(?m)^\s+[A-Z]\.\d+\.\s+",
    "letter_heading": r"(?m)^\s*[A-Z]\.\s+[A-Z][A-Z]",
    "number_heading": r"(?m)^\s*\d+\.\s+[A-Z][A-Z\s/&]{3,}",
    "number_item": r"(?m)^\s*\d+\.\s+[A-Z]",
}
AGENDA_SECTIONS = r"(?i)CONSENT CALENDAR|PUBLIC HEARING|APPROVAL OF|ADJOURN"

# Numbers of resolutions and ordinances.
RESOLUTION = r"(?i)Resolution No\.\s*([\d-]+)"
ORDINANCE = r"(?i)Ordinance(?:\s+No\.?)?\s+(\d+)"

# Words that no cluster's name may hold, and how many words it has.
BANNED_IN_NAMES = ("influence", "controversial", "scandal", "scandalous", "alleged", "corrupt", "corruption", "shady", "questionable")
NAME_WORDS = (2, 7)


def minutes_form(text: str) -> Column:
    """The form of minutes by the first phrase that fits."""
    out = F.lit(OTHER_MINUTES)
    for pattern, form in reversed(MINUTES_FORMS):
        out = F.when(F.col(text).rlike(f"(?i){pattern}"), form).otherwise(out)
    return F.when(F.col(text).isNotNull(), out)


def agenda_form(text: str) -> Column:
    """The form of an agenda by its items, or else its headings; null if none is told."""
    n = {name: F.size(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))) for name, pattern in AGENDA_MARKS.items()}
    plain = (n["number_letter"] == 0) & (n["letter_number"] == 0) & (n["number_item"] >= 3) & F.col(text).rlike(AGENDA_SECTIONS)
    return (
        F.when(n["tiburon"] >= 2, "tiburon")
        .when(n["bos"] >= 3, "bos")
        .when((n["number_letter"] > n["letter_number"]) & (n["number_letter"] >= 2), "civicplus")
        .when(n["letter_number"] >= 2, "granicus")
        .when((n["number_heading"] > n["letter_heading"]) & (n["number_heading"] >= 3), "civicplus")
        .when(n["letter_heading"] >= 3, "granicus")
        .when(plain, "fairfax")
    )


def numbers(text: str, pattern: str) -> Column:
    """All numbers that a pattern's first group finds, in order."""
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))


def fit_name(name: str, words: str) -> Column:
    """Whether a proposed name has two to seven words, none of them banned, and shares one with ``words`` (an array)."""
    low = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    count = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    banned = F.lit(False)
    for word in BANNED_IN_NAMES:
        banned = banned | low.contains(word)
    shared = F.arrays_overlap(F.filter(F.split(low, "[^a-z]+"), lambda w: w != ""), F.col(words))
    return count.between(*NAME_WORDS) & ~banned & F.coalesce(shared, F.lit(False))

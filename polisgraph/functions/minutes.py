"""Votes out of meeting minutes and items out of agendas: rules per form, run over Arrow batches of texts.

``votes`` and ``agenda_rows`` take any table with an id and a text and give one row per vote, or per section and item, in the
order of the text.  The form is told by ``extraction.minutes_form`` and ``extraction.agenda_form`` unless a column names it.

A rule finds motions by a pattern and reads each one's names and outcome in the part of the text after it: up to the
next motion, in a window, or in the next line that fits.  Null texts, and texts without a form, give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.functions.extraction import agenda_form, minutes_form

# Words that open, carry and close motions in the four forms of minutes.
_WORD = r"(\w+(?:['\-]\w+)*)"
_TITLED = r"(?:(?:Mayor\s+Pro\s+Tem|Vice\s+Mayor|Mayor|Councilmember|Councilwoman|Councilman)\s+)?" + _WORD
_SEATED = r"(?:Councilmember|Vice Mayor|Mayor)\s+" + _WORD
ROLL_CALL = (
    r"COUNCIL ACTION(?:\s+ON\s+MAIN\s+MOTION)?:\s*(?:Upon motion by|Motion made by|Upon substitute motion (?:made )?by)\s+" + _TITLED + r"\s+and\s+seconded\s*\n?\s*by\s+" + _TITLED
    + r",?\s+the City Council voted\s+(\d+-\d+(?:-\d+)?)\s+via roll call\s+(?:to\s+)?\s*\n?\s*(.+?)(?=\n\s*AYES:)"
)
NO_SECOND = r"COUNCIL MOTION:\s*Upon motion by\s+" + _TITLED + r"\s+there was no\s*\n?\s*second"
NEXT_BLOCK = r"\nCOUNCIL (ACTION|MOTION):"
MOVED_SECONDED = r"MOTION:\s+It was M/S/C\s+\(" + _WORD + "/" + _WORD + r"\)\s+to\s+(.+?)(?=\nROLL CALL VOTE:)"
IN_FAVOR = r"ROLL CALL VOTE:\s+(\d+-\d+)\s*(?:\(" + _WORD + r"\s+opposed\))?\s+in favor"
PROSE = _SEATED + r"\s+moved,\s+seconded by\s+" + _SEATED + r",\s+and\s+(unanimously\s+carried|carried\s+\d+-\d+(?:\s*\([^)]+\))?)"
PROSE_MOTION = r"(?:unanimously\s+carried|carried\s+\d+-\d+(?:\s*\([^)]+\))?)\s*,\s+to\s+(.+?)(?=\n\n|\Z)"
DISSENTING, CARRIED = r"\((\w+)\s+dissenting\)", r"carried\s+(\d+-\d+)"
SUPERVISORS = r"M/s\s+Supervisor\s+" + _WORD + r"\s+-\s+Supervisor\s+" + _WORD + r"\s+to\s+(.+?)\.\s*AYES:\s*(\w+)"
SPECIAL = r"(?:Motion\s+to\s+)?(.+?)moved\s+by\s+Supervisor\s+" + _WORD + r"\s+and\s+seconded\s+by\s+Supervisor\s+" + _WORD
LISTS = {name: rf"{name.upper()}:\s*(.+)" for name in ("ayes", "noes", "recused", "absent")}
ENDED, PASSED = r"Motion (carried|failed)\.", r"Motion\s+(passed|failed)\."
UNSECONDED = "motion failed — no second"
QUOTES = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"'})
BLOCK_LINES, PROSE_WINDOW, SPECIAL_WINDOW = 40, 500, 800

# Headings and items of the five forms of agendas.
LETTERED = (r"^\s*([A-Z])\.\s+([A-Z][A-Z /&]+)", r"^\s+([A-Z])\.(\d+)\.\s+(.+)")
NUMBERED = (r"^\s*(\d+)\.\s+([A-Z][A-Z\s/&]+)", r"^\s+(\d+)\.([A-Z])\.?\s+(.+)")
COUNTY_SECTION = r"^(Consent Agenda [A-Z]|Public Hearing|Board (?:Action|Business))"
COUNTY_ITEM, REQUEST = r"^CA\s*-\s*(\d+)\.\s*(.*)", r"Request\s+(.+?)(?:\n|$)"
HEARING_WINDOW, LONGEST_TITLE, HEADING_CHARS = 2000, 200, 80
PLAIN_SECTIONS = (
    ("consent calendar", "Consent Calendar"), ("public hearing", "Public Hearing"), ("public comment", "Public Comment"), ("closed session", "Closed Session"), ("action item", "Action Items"),
    ("new business", "New Business"), ("old business", "Old Business"), ("approval of agenda", "Procedural"), ("approval of minutes", "Procedural"),
)
NO_ITEMS = ("call to order", "roll call", "adjournment", "pledge")
CODED = {"CC": "Consent Calendar", "AI": "Action Items", "PH": "Public Hearings"}
CODED_HEADINGS = (("consent calendar", "Consent Calendar"), ("action item", "Action Items"), ("public hearing", "Public Hearings"), ("staff briefing", "Staff Briefing"))
NO_CODED_ITEMS = ("email", "attend", "zoom", "call-in")


# ---------------------------------------------------------------- votes


@dataclass
class Vote:
    mover: str
    seconder: str | None = None
    tally: str | None = None
    motion: str = ""
    ayes: list[str] = field(default_factory=list)
    noes: list[str] = field(default_factory=list)
    recused: list[str] = field(default_factory=list)
    absent: list[str] = field(default_factory=list)
    outcome: str = "carried"


_FOUND = re.S | re.I


def _first(pattern: str, text: str) -> str | None:
    found = re.search(pattern, text, re.I)
    return found.group(1) if found else None


def _names(raw: str | None) -> list[str]:
    names = [n.strip().upper() for n in (raw or "").split(",")]
    return [n for n in names if n] if names != ["NONE"] else []


def _flat(text: str) -> str:
    return " ".join(text.split())


def _roll_call(text: str, m: re.Match) -> Vote:
    rest = text[m.end() :]
    stop = re.search(NEXT_BLOCK, rest, re.I)
    block = rest[: stop.start()] if stop else "\n".join(rest.split("\n")[:BLOCK_LINES])
    lists = {name: _names(_first(pattern, block)) for name, pattern in LISTS.items()}
    return Vote(m[1].upper(), m[2].upper(), m[3], _flat(m[4]), outcome=(_first(ENDED, block) or "unknown").lower(), **lists)


def _no_second(text: str, m: re.Match) -> Vote:
    return Vote(m[1].upper(), motion=UNSECONDED, outcome="failed")


def _moved_seconded(text: str, m: re.Match) -> Vote | None:
    roll = re.compile(IN_FAVOR, re.I).search(text, m.end())
    return Vote(m[1], m[2], roll[1], _flat(m[3]), noes=[roll[2].upper()] if roll[2] else []) if roll else None


def _prose(text: str, m: re.Match) -> Vote:
    motion = re.search(PROSE_MOTION, text[m.start() : m.start() + PROSE_WINDOW], _FOUND)
    against = _first(DISSENTING, m[3])
    return Vote(m[1], m[2], _first(CARRIED, m[3]), _flat(motion[1]).rstrip(".") if motion else "", noes=[against.upper()] if against else [])


def _supervisors(text: str, m: re.Match) -> Vote:
    return Vote(m[1], m[2], motion=_flat(m[3]), ayes=_names(m[4]))


def _special(text: str, m: re.Match) -> Vote:
    window = text[m.start() : m.start() + SPECIAL_WINDOW]
    failed = (_first(PASSED, window) or "").lower() == "failed"
    return Vote(m[2], m[3], motion=_flat(m[1]).rstrip("."), ayes=_names(_first(LISTS["ayes"], window)), noes=_names(_first(LISTS["noes"], window)), outcome="failed" if failed else "carried")


#: Per form: whether curly quotes are made straight, and the rules.
MINUTES: dict[str, tuple[bool, tuple[tuple[str, Callable], ...]]] = {
    "novato": (True, ((NO_SECOND, _no_second), (ROLL_CALL, _roll_call))),
    "cortemadera": (False, ((MOVED_SECONDED, _moved_seconded),)),
    "sausalito": (True, ((PROSE, _prose),)),
    "bos": (False, ((SUPERVISORS, _supervisors), (SPECIAL, _special))),
}


def votes_of(text: str, form: str) -> list[Vote]:
    """All votes in the order of the text."""
    straight, rules = MINUTES[form]
    text = text.translate(QUOTES) if straight else text
    found = [(m.start(), k, vote) for k, (pattern, read) in enumerate(rules) for m in re.finditer(pattern, text, _FOUND) if (vote := read(text, m)) is not None]
    return [vote for *_, vote in sorted(found, key=lambda x: x[:2])]


# ---------------------------------------------------------------- agendas


@dataclass
class Entry:
    """A section (without a number) or an item."""

    section: str
    section_name: str
    number: str | None = None
    title: str | None = None


def _outline(patterns: tuple[str, str]) -> Callable[[str], Iterator[Entry]]:
    """Headings with a label, and items that name their heading's label."""
    heading, item = (re.compile(p, re.M) for p in patterns)

    def read(text: str) -> Iterator[Entry]:
        names: dict[str, str] = {}
        for m in heading.finditer(text):
            names.setdefault(m[1], m[2].strip())
        yield from (Entry(label, name) for label, name in names.items())
        yield from (Entry(m[1], names.get(m[1], ""), m[2], m[3].strip()) for m in item.finditer(text))

    return read


def _county(text: str) -> Iterator[Entry]:
    for m in re.finditer(COUNTY_SECTION, text, re.M | re.I):
        yield Entry(m[1].strip()[:2].upper(), m[1].strip())
    for m in re.finditer(COUNTY_ITEM, text, re.M):
        yield Entry("CA", "Consent Agenda", m[1], m[2].strip())
    at = text.lower().find("public hearing")
    requests = re.findall(REQUEST, text[at : at + HEARING_WINDOW]) if at > 0 else []
    yield from (Entry("PH", "Public Hearing", str(k), title.strip()[:LONGEST_TITLE]) for k, title in enumerate(requests, 1))


class _Sections:
    """The section that a line is in, by words of short lines; each section is told once."""

    def __init__(self, words):
        self.words, self.name, self.told = words, "General", []

    def read(self, line: str, first_only: bool) -> Iterator[Entry]:
        for word, name in self.words:
            if word in line.lower() and len(line) < HEADING_CHARS:
                self.name = name
                if name not in self.told:
                    self.told.append(name)
                    yield Entry(name[:2].upper(), name)
                if first_only:
                    return


def _plain(text: str) -> Iterator[Entry]:
    at = _Sections(PLAIN_SECTIONS)
    for line in map(str.strip, text.split("\n")):
        yield from at.read(line, True)
        m = re.match(r"(\d+)\.\s+([A-Z].+)", line)
        if m and not any(w in m[2].lower() for w in NO_ITEMS):
            yield Entry(at.name[:2].upper(), at.name, m[1], m[2].strip()[:LONGEST_TITLE])


def _coded(text: str) -> Iterator[Entry]:
    lines = [line.strip() for line in text.split("\n")]
    told: list[str] = []
    code = re.compile(rf"({'|'.join(CODED)})-(\d+)\.?\s*(.*)")
    starts = re.compile(rf"(?:{'|'.join(CODED)})-\d+")
    for k, line in enumerate(lines):
        if m := code.match(line):
            below = (x[:LONGEST_TITLE] for x in lines[k + 1 : k + 5] if x and not starts.match(x))
            if m[1] not in told:
                told.append(m[1])
                yield Entry(m[1], CODED[m[1]])
            yield Entry(m[1], CODED[m[1]], m[2], m[3].strip() or next(below, ""))
    if told:
        return
    at = _Sections(CODED_HEADINGS)
    for line in lines:
        yield from at.read(line, False)
        m = re.match(r"(\d+)\.\s+(.+)", line)
        if m and not any(w in line.lower() for w in NO_CODED_ITEMS):
            yield Entry(at.name[:2].upper(), at.name, m[1], m[2][:LONGEST_TITLE])


AGENDAS: dict[str, Callable[[str], Iterator[Entry]]] = {"granicus": _outline(LETTERED), "civicplus": _outline(NUMBERED), "bos": _county, "fairfax": _plain, "tiburon": _coded}


def entries_of(text: str, form: str) -> list[Entry]:
    """All sections and items; sections come in the order in which the form tells them."""
    return list(AGENDAS[form](text)) if text.strip() else []


# ---------------------------------------------------------------- over tables

_STRINGS = T.ArrayType(T.StringType())
_VOTE = [("mover", T.StringType()), ("seconder", T.StringType()), ("tally", T.StringType()), ("motion", T.StringType()), ("ayes", _STRINGS), ("noes", _STRINGS), ("recused", _STRINGS), ("absent", _STRINGS), ("outcome", T.StringType())]
_ENTRY = [("section", T.StringType()), ("section_name", T.StringType()), ("number", T.StringType()), ("title", T.StringType())]


def _rows(fields: list[tuple[str, T.DataType]], read: Callable, known) -> Callable:
    kinds = [pa.list_(pa.string()) if t is _STRINGS else pa.string() for _, t in fields]
    names = ["id", "form", "at", *(n for n, _ in fields)]

    def run(batches):
        for batch in batches:
            ids, texts, forms = batch.columns
            take, form, at, out = [], [], [], []
            for k, (text, f) in enumerate(zip(texts.to_pylist(), forms.to_pylist(), strict=True)):
                for place, row in enumerate(read(text, f) if text is not None and f in known else [], 1):
                    take.append(k)
                    form.append(f)
                    at.append(place)
                    out.append([getattr(row, n) for n, _ in fields])
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(fields), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), pa.array(form, pa.string()), pa.array(at, pa.int32()), *columns], names)

    return run


def _over(texts: DataFrame, id_col: str, text: str, form, fields, read, known) -> DataFrame:
    rows = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")).select("id", "text", form("text").alias("form")) if callable(form) else texts.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(form).alias("form"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("form", T.StringType()), T.StructField("at", T.IntegerType()), *(T.StructField(n, t) for n, t in fields)])
    return rows.mapInArrow(_rows(fields, read, known), schema)


def votes(texts: DataFrame, id_col: str = "id", text: str = "text", form: str | Callable = minutes_form) -> DataFrame:
    """One row per vote: ``id, form, at, mover, seconder, tally, motion, ayes, noes, recused, absent, outcome``."""
    return _over(texts, id_col, text, form, _VOTE, votes_of, MINUTES)


def agenda_rows(texts: DataFrame, id_col: str = "id", text: str = "text", form: str | Callable = agenda_form) -> DataFrame:
    """One row per section (without a number) and item: ``id, form, at, section, section_name, number, title``."""
    return _over(texts, id_col, text, form, _ENTRY, entries_of, AGENDAS)

"""Text functions as Column expressions: normalisation, extraction by pattern, cleanup, defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the record format.
SERIAL = r"\b(?:TM|JV|WM|MM|[A-Z]{2})\d{8,12}\b"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE = rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b"
CLASS_HEADER = r"CLASS\s*:\s*([\d,\s]+)"
CLASS_LINE = r"^\s*CLASS\s*:\s*[\d,\s]+\s*$"
COMPANY_WORDS = ("SDN", "BHD", "LTD", "INC", "PTY", "CORP", "LLC", "PTE", "CO.")
CLASS_BOILERPLATE = r"All included in Class \d+\.?"
COMPLETENESS = (("serial_number", 0.25), ("registration_date", 0.10), ("class_indices", 0.15), ("applicant_name", 0.20), ("agent_details", 0.10))
LONG_DESCRIPTION, LONG_DESCRIPTION_WEIGHT = 50, 0.20
PREVIEW = 120
#: Characters that are white space.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PASSWORD_MARKS = r'[!@#$%^&*(),.?":{}|<>]'


def stripped(c: Column) -> Column:
    """A text without white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def normalized(c: Column) -> Column:
    """Upper case letters A-Z and digits alone."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def without_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def scrubbed(description: Column) -> Column:
    """A description without the boilerplate about its class."""
    return F.trim(F.regexp_replace(description, f"(?i){CLASS_BOILERPLATE}", ""))


def combined(name: Column, description: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))


def embeddable(c: Column) -> Column:
    """What is embedded for a query text: blank and n/a count as the word empty."""
    blank = F.coalesce(F.trim(c), F.lit(""))
    return F.when((blank == "") | (F.lower(blank) == "n/a"), F.lit("empty")).otherwise(c)


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column, default: str | None = "") -> Column:
    return F.coalesce(*map(filled, columns), *([] if default is None else [F.lit(default)]))


def or_na(c: Column) -> Column:
    return first_filled(c, default="N/A")


def preview(c: Column, width: int = PREVIEW) -> Column:
    return F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)


def file_safe(c: Column, width: int | None = None) -> Column:
    """A text without the characters that file names may not hold."""
    clean = F.regexp_replace(c, r'[\\/*?:"<>|]', "")
    return clean if width is None else F.substring(clean, 1, width)


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def serial_of(c: Column) -> Column:
    """The first serial number in a text, else null."""
    return filled(F.regexp_extract(c, SERIAL, 0))


def date_text(c: Column) -> Column:
    """The first date in a text as it stands there, else null."""
    return filled(F.regexp_extract(c, f"(?i){DATE}", 0))


def date_of(c: Column) -> Column:
    """The first date in a text as a date, else null."""
    found = F.initcap(F.regexp_replace(date_text(c), r"\s+", " "))
    return F.coalesce(F.try_to_date(found, "d MMMM yyyy"), F.try_to_date(found, "d MMM yyyy"))


def class_text(c: Column) -> Column:
    """What a class header lists, else an empty text."""
    return stripped(F.regexp_extract(c, f"(?im){CLASS_HEADER}", 1))


def class_numbers(c: Column) -> Column:
    """A class list as an array of integers."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))


def is_upper(c: Column) -> Column:
    """Whether a text has cased characters and all of them are upper case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def has_company_word(c: Column) -> Column:
    upper = F.upper(c)
    return reduce(lambda a, b: a | b, [F.contains(upper, F.lit(w)) for w in COMPANY_WORDS])


def owner_parts(block: Column) -> tuple[Column, Column]:
    """Name and address of an applicant block, split at its first semicolon."""
    parts = F.split(block, ";", 2)
    return F.trim(parts[0]), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def named(line: Column) -> Column:
    """The name that a translation or transliteration line gives, empty if that is blank, null if it gives none."""
    quoted, spelled = "[\"'](.*?)[\"']", r"(?i)transliteration:\s*(.+)"
    cut = F.regexp_replace(F.regexp_extract(line, spelled, 1), r"\s+(?:Registration|The|This|Class).*$", "")
    lower = F.lower(line)
    translated = F.contains(lower, F.lit("translation"))
    return F.when(translated & line.rlike(quoted), stripped(F.regexp_extract(line, quoted, 1))).when(~translated & line.rlike(spelled), stripped(cut))


def translated_name(line: Column) -> Column:
    """The name that a translation or transliteration line gives, else null."""
    return filled(named(line))


def name_in_notes(description: Column) -> Column:
    """The name in a description's note on a translation or, without one, on a transliteration, else null."""
    quoted, spelled = r"Mark\s+translation:\s*[\"']([^\"']+)[\"']", r"Mark\s+transliteration:\s*([A-Za-z\s]+?)(?=\s*[A-Z]|\.|$)"
    return stripped(F.when(description.rlike(quoted), F.regexp_extract(description, quoted, 1)).when(description.rlike(spelled), F.regexp_extract(description, spelled, 1)))


def clean_description(c: Column, serial: Column | None = None, date: Column | None = None) -> Column:
    """A description without notes on the mark, its own serial and date, and class headers."""
    for pattern in (
        r"Mark\s+translation:[^.]+\.\s*",
        r"Mark\s+transliteration:[^.]+\.\s*",
        r"Mark\s+translation:[^A-Z]+",
        r"Mark\s+transliteration:[^A-Z]+",
        r"(?i)Registration of this trademark[^.]+\.",
    ):
        c = F.regexp_replace(c, pattern, "")
    for own in (serial, date):
        if own is not None:
            c = F.when(F.coalesce(own, F.lit("")) == "", c).otherwise(F.replace(c, own, F.lit("")))
    for pattern in (r"(?i)CLASS\s*:\s*[\d,\s]+", r"\bCLASS\s+\d+\b"):
        c = F.regexp_replace(c, pattern, "")
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), "^[;:,. ]+", "")


def completeness(record: dict[str, Column]) -> Column:
    """The weighted share of fields that are there; record maps field names to columns."""
    there = [F.when(F.coalesce(record[f], F.lit("")) != "", F.lit(w)).otherwise(F.lit(0.0)) for f, w in COMPLETENESS]
    long = F.when(F.char_length(record["description"]) > LONG_DESCRIPTION, F.lit(LONG_DESCRIPTION_WEIGHT)).otherwise(F.lit(0.0))
    return reduce(lambda a, b: a + b, [*there, long])


def tokens(c: Column) -> Column:
    """Lower-case words; leading and trailing white space makes none."""
    return F.array_remove(F.split(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+"), "")


def password_strength(c: Column) -> Column:
    """weak, medium or strong by how many of five tests a password passes."""
    passed = reduce(lambda a, b: a + b, [c.rlike(p).cast("int") for p in (".{8,}", "[A-Z]", "[a-z]", "[0-9]", PASSWORD_MARKS)])
    return F.when(passed <= 2, "weak").when(passed <= 4, "medium").otherwise("strong")


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def batch_is_valid(batch: Column) -> Column:
    return F.coalesce(batch.rlike(r"^\d{1,2}$"), F.lit(False))


def year_is_valid(year: Column, latest: Column | None = None) -> Column:
    """Whether a text is a year of four digits that isn't after the latest, the current one if none is given."""
    return F.coalesce(year.rlike(r"^\d{4}$") & (year.try_cast("int") <= (F.year(F.current_date()) if latest is None else latest)), F.lit(False))


def display_label(file_name: Column, batch: Column, year: Column, serial: Column, key: Column) -> Column:
    """What a record is listed as: its file, else batch/year, else its serial, else its id."""
    batch_file = F.when(filled(batch).isNotNull() & filled(year).isNotNull(), F.concat(batch, F.lit("/"), year, F.lit(".pdf")))
    return F.coalesce(filled(file_name), batch_file, filled(serial), F.concat(F.lit("id-"), key.cast("string")))

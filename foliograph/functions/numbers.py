"""Cell values as a spreadsheet shows them, by their number format.

A format is read once, into a few numbers and literals for each of its sections; values then are formatted by column expressions
(``displayed``, ``date_displayed``) where the format is known when the plan is made, and by a vectorised function where it is a column.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Masks of digits; patterns of dates, the first that is found counts, with what they show.
MASK = re.compile(r"[0#][0#,]*(?:\.([0#]+))?")
DATES = [
    (r"yyyy[-/.]mm[-/.]dd", "%Y-%m-%d", "yyyy-MM-dd"),
    (r"yy[-/.]mm[-/.]dd", "%y-%m-%d", "yy-MM-dd"),
    (r"mm[-/.]dd[-/.]yyyy", "%m-%d-%Y", "MM-dd-yyyy"),
    (r"m/d/yyyy", "%m/%d/%Y", "MM/dd/yyyy"),
    (r"yyyy[-/.]mm", "%Y-%m", "yyyy-MM"),
    (r"mm[-/.]dd", "%m-%d", "MM-dd"),
]
PLAIN = ("", "General", "@")


@dataclass(frozen=True)
class Section:
    """What one section of a format shows around a number; places is None where it shows no number."""

    before: str
    places: int | None
    thousands: bool
    percent: bool
    after: str


def sections(fmt: str) -> list[str]:
    """The parts between semicolons that are neither quoted nor escaped."""
    found = re.findall(r'((?:\\.|"[^"]*"?|[^;\\"]|\\$)*)(;|$)', fmt, re.S)
    out = [text for text, _ in found]
    return out[:-1] if len(out) > 1 and found[-2][1] == "" else out


def literal(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", re.sub(r'"([^"]*)"', r"\1", text))


@lru_cache(maxsize=4096)
def compiled(fmt: str) -> tuple[Section, ...]:
    """The sections of a format: for numbers over 0, under 0 and 0, as far as it has them."""
    out = []
    for part in sections(fmt):
        shown = re.sub(r"\[[^\]]*\]", "", part)
        mask = MASK.search(shown)
        if mask:
            whole = mask[0].partition(".")[0]
            out.append(Section(literal(shown[: mask.start()]), len(mask[1] or ""), "," in whole, "%" in shown, literal(shown[mask.end() :])))
        else:
            out.append(Section(literal(shown), None, False, False, ""))
    return tuple(out)


def general(value: float) -> str:
    return str(int(value)) if isinstance(value, int) or float(value).is_integer() else f"{value:.10g}"


def _shown(value: float, s: Section) -> str:
    if s.places is None:
        return s.before
    return f"{s.before}{value * 100 if s.percent else value:{',' if s.thousands else ''}.{s.places}f}{s.after}"


def _date(value: dt.date, fmt: str) -> str:
    for pattern, shown, _ in DATES:
        if re.search(pattern, fmt, re.I):
            return value.strftime(shown)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ") if value.hour or value.minute or value.second else value.date().isoformat()
    return value.isoformat()


def display(value, fmt: str | None) -> str:
    """Never raises; None is an empty text, and what is neither a number nor a date is its own text."""
    if value is None or value is pd.NaT:
        return ""
    if isinstance(value, dt.date):
        return _date(value, fmt or "")
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    try:
        if (fmt or "") in PLAIN:
            return general(value)
        parts = compiled(fmt)
        at = 1 if value < 0 and len(parts) > 1 else 2 if value == 0 and len(parts) > 2 else 0
        return ("-" if value < 0 and len(parts) == 1 else "") + _shown(abs(float(value)), parts[at])
    except (ValueError, OverflowError):
        return str(value)


@F.pandas_udf(T.StringType())
def cell_display(value: pd.Series, fmt: pd.Series) -> pd.Series:
    return pd.Series([display(None if pd.isna(v) else v, None if pd.isna(f) else f) for v, f in zip(value, fmt)])


def fixed(value: Column, places: int, thousands: bool = False) -> Column:
    """A fixed number of decimals of the exact binary value, without Python."""
    text = F.format_number(value, places)
    return text if thousands else F.replace(text, F.lit(","), F.lit(""))


def displayed(value: Column, fmt: str) -> Column:
    """A number as ``fmt`` shows it; a null is an empty text. Plain formats are those of whole numbers."""
    if fmt in PLAIN:
        return F.coalesce(F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string")), F.lit(""))
    parts = compiled(fmt)

    def show(s: Section) -> Column:
        if s.places is None:
            return F.lit(s.before)
        amount = F.abs(value.cast("double")) * (100 if s.percent else 1)
        return F.concat(F.lit(s.before), fixed(amount, s.places, s.thousands), F.lit(s.after))

    below = show(parts[1]) if len(parts) > 1 else F.concat(F.lit("-"), show(parts[0]))
    zero = show(parts[2]) if len(parts) > 2 else show(parts[0])
    return F.coalesce(F.when(value < 0, below).when(value == 0, zero).when(value > 0, show(parts[0])), F.lit(""))


def displayed_by(value: Column, fmt: Column, formats: list[str]) -> Column:
    """As ``displayed`` for the formats given, which are few in any workbook; others by the vectorised function."""
    out = F.when(F.lit(False), F.lit(""))
    for f in formats:
        out = out.when(fmt == f, displayed(value, f))
    return out.otherwise(cell_display(value.cast("double"), fmt))


def excel_date(value: Column, fmt: Column) -> Column:
    """A date or time by its format; one without a known pattern in ISO form, with the time if it has any."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, _, spark in DATES:
        out = out.when(fmt.rlike(f"(?i){pattern}"), F.date_format(value, spark))
    at = value.cast("timestamp")
    timed = F.date_format(at, "HH:mm:ss") != "00:00:00"
    return out.otherwise(F.when(timed, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd")))

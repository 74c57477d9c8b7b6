"""Text fields: clean-up, numbers, dates, null spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that pad delimited fields.
PADDING = " \t\",\r\n"
NA_SPELLINGS = ["", "N/A", "NA", "NULL", "UNK", "UNKNOWN", "-", "NaN"]


def stripped(text: Column, pad: str = PADDING) -> Column:
    return F.trim(text, F.lit(pad))


def null_spellings(text: Column, spellings: list[str] = NA_SPELLINGS) -> Column:
    """Null where the trimmed text spells a missing value."""
    return F.when(~F.trim(text).isin(spellings), text)


#: What spells a missing value in tables of single instruments.
SPELLINGS_OF = {"REMS": ["UNK", "NULL"], "CRISM": ["N/A"]}


def null_spellings_of(text: Column, instrument: Column, spellings: dict[str, list[str]] = SPELLINGS_OF, other: list[str] = NA_SPELLINGS) -> Column:
    """Null where the trimmed text spells a missing value for that instrument; ``other`` holds for instruments not named and null ones."""
    out = null_spellings(text, other)
    for name, own in spellings.items():
        out = F.when(instrument == name, null_spellings(text, own)).otherwise(out)
    return out


def ascii_integer(text: Column, base: int = 10) -> Column:
    """Exact integer of base 2, 8, 10 or 16 as decimal(38,0); null where it is none."""
    t = F.trim(text)
    if base == 10:
        return F.when(t.rlike("^[+-]?[0-9]{1,38}$"), t.try_cast("decimal(38,0)"))
    digits = {2: "[01]{1,64}", 8: "[0-7]{1,21}", 16: "[0-9A-Fa-f]{1,16}"}[base]
    return F.when(t.rlike(f"^{digits}$"), F.conv(t, base, 10).try_cast("decimal(38,0)"))


def ascii_real(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def ascii_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def canonical_lines(text: Column) -> Column:
    """CR and CR LF line ends as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


_TIMES = ["", "'T'HH", "'T'HH:mm", "'T'HH:mm:ss", "'T'HH:mm:ss.SSSSSS"]


def archive_date(text: Column) -> Column:
    """Timestamp of a date by year-month-day or by day of year, cut off anywhere after the year.

    Blanks and a Z at the end are dropped. What is no date is null.
    """
    t = F.regexp_replace(F.trim(text), "Z$", "")
    parts = F.split(t, "T")
    day, time = parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    length = F.length(time)
    by_day = {
        "yyyy": day.rlike("^[0-9]{4}$"),
        "yyyy-MM": day.rlike("^[0-9]{4}-[0-9]{2}$"),
        "yyyy-DDD": day.rlike("^[0-9]{4}-[0-9]{3}$"),
        "yyyy-MM-dd": day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    }
    by_time = {_TIMES[0]: length == 0, _TIMES[1]: length == 2, _TIMES[2]: length == 5, _TIMES[3]: length == 8, _TIMES[4]: length > 8}
    out = F.lit(None).cast("timestamp")
    for d, fits in by_day.items():
        for clock, long in by_time.items():
            if clock and d in ("yyyy", "yyyy-MM"):
                continue
            out = F.when(fits & long, F.try_to_timestamp(t, F.lit(d + clock))).otherwise(out)
    return out

"""Text rules as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

# Four leading digits, or a shorter text made of digits only.
YEAR_PATTERN = "^([0-9]{4}|[0-9]{1,3}$)"

# Text markers that stand for "no value" in the raw tables.
MISSING_MARKERS = ("NA", "0", "")

# Substrings of a lowered title that mark a variant recording.
VARIANT_MARKERS = (
    "remix",
    "instrumental",
    "(inst",
    "sped up",
    "slowed",
    "version",
    " ver.",
    " live",
    "(live",
)


def ascii_lower(col: Column) -> Column:
    """Lower A-Z only, so that every character keeps its position."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def any_case(literal: str) -> str:
    """Pattern for a literal text in any ASCII case. Positions are those of the text
    itself, which lowering a copy of it would not guarantee outside ASCII."""
    return f"(?i)\\Q{literal}\\E"


def contains_ci(col: Column, needle: str) -> Column:
    """SQL ``LIKE '%needle%'`` without regard to case; wildcards in needle are literal."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return col.ilike(f"%{escaped}%")


def has_any_marker(col: Column, markers=VARIANT_MARKERS) -> Column:
    """True when the lowered text holds at least one marker; NULL text gives NULL."""
    lowered = F.lower(col)
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(lowered, F.lit(marker))
    return found


def has_nondigit(col: Column) -> Column:
    return col.rlike("[^0-9]")


def cut_before(col: Column, delimiter: str, ignore_case: bool = False) -> Column:
    """Text before the first delimiter, or the whole text when it is absent."""
    if not ignore_case:
        return F.substring_index(col, delimiter, 1)
    return F.split(col, any_case(delimiter), 2)[0]


def decade_of_date(col: Column) -> Column:
    """``1987-05-02`` -> ``1980s``."""
    return F.concat(F.substring(col, 1, 3), F.lit("0s"))


def decade_ladder(col: Column, first: int = 1950, last: int = 2020) -> Column:
    """First-match ladder over ISO dates held as text, newest decade first."""
    out = None
    for start in range(last, first - 1, -10):
        test = col >= F.lit(str(start))
        out = F.when(test, f"{start}s") if out is None else out.when(test, f"{start}s")
    return out.otherwise(F.lit("earlier"))


def year4(col: Column) -> Column:
    """The first four characters as a number, NULL unless all of them are digits."""
    return F.regexp_extract(col, YEAR_PATTERN, 1).try_cast("int")


def strip_quotes(col: Column) -> Column:
    return F.replace(col, F.lit('"'), F.lit(" "))


def duration_text(millis: Column) -> Column:
    """Milliseconds as ``m:ss``; empty text for NULL and zero."""
    seconds = F.call_function("div", millis, F.lit(1000))
    minutes = F.call_function("div", millis, F.lit(60000))
    shown = F.concat(
        minutes.cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")
    )
    return F.when(millis.isNull() | (millis == 0), F.lit("")).otherwise(shown)


# Audience tiers, from few listeners to many.
TIER_LABELS = ("hidden gem", "middle band", "buried anthem")


def tier(listeners: Column, low: int = 200_000, high: int = 1_000_000) -> Column:
    """Audience tier; an unknown audience counts as the middle one."""
    number = F.when(listeners < low, 0).when(listeners >= high, 2).otherwise(1)
    return F.get(F.array(*map(F.lit, TIER_LABELS)), number)


def ratio(top: Column, bottom: Column) -> Column:
    """Floating ratio; NULL instead of an error when the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))

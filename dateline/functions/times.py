"""Finding and reading the publication time of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.functions.text import java_trim

# Words that mark a time attribute.
TIME_WORDS = ("time", "date", "timestamp", "published", "updated", "datetime")

# English month names, matched with their case.
MONTHS = (
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
)
_SHORT = [name[:3] for name in MONTHS]
_ANY_MONTH = "|".join(dict.fromkeys([*MONTHS, *_SHORT]))

# Years a timestamp of microseconds can hold.
_YEARS = (-290_000, 294_000)

_ISO = (
    r"^([0-9]{4}|-[0-9]{4,9}|[+][0-9]{5,9})-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{0,9})?"
    r"(Z|[+-][0-9]{2}:[0-9]{2}(:[0-9]{2})?)$"
)


# Columns added one dict after the other; built once, applied to any table.
Stages = list[dict[str, Column]]


def apply(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage)
    return df


def contains_digit(text: Column) -> Column:
    """True for a one-line text holding an ASCII digit."""
    one_line = ~text.rlike(r"[\n\r\x{85}\x{2028}\x{2029}]")
    return F.coalesce(text.rlike("[0-9]") & one_line, F.lit(False))


def time_attribute(attrs: Column, text: Column) -> Column:
    """The raw time of an element given its attributes (in document order) and text.

    First an attribute whose name holds a time word and whose value has a digit, then
    any attribute whose value has a digit, then the text if it has one, else empty.
    """
    dated = F.filter(
        F.transform(
            attrs, lambda a: F.struct(F.lower(a["k"]).alias("k"), java_trim(a["v"]).alias("v"))
        ),
        lambda a: contains_digit(a["v"]),
    )
    named = F.filter(dated, lambda a: a["k"].rlike("|".join(TIME_WORDS)))
    shown = java_trim(text)
    return F.coalesce(
        F.get(named, 0)["v"], F.get(dated, 0)["v"], F.when(contains_digit(shown), shown), F.lit("")
    )


def _month(name: Column) -> Column:
    table = F.create_map(
        *[F.lit(x) for i, name_ in enumerate(MONTHS) for x in (name_, i + 1)],
        *[F.lit(x) for i, name_ in enumerate(_SHORT) if name_ not in MONTHS for x in (name_, i + 1)],
    )
    return F.try_element_at(table, name)


# Below, a text that does not have the shape becomes null first. Its parts are then null
# too, so no part of a failed shape is converted and no exception is raised and caught.


def _first_of_month(year: Column, month: Column, years: tuple[int, int] = (1, 9999)) -> Column:
    fits = year.between(*years) & month.between(1, 12)
    return F.make_date(F.when(fits, year), month, F.lit(1))


def _midnight(year: Column, month: Column, day: Column) -> Column:
    """Start of a day; a day past the month's end (up to 31) is the month's last day."""
    first = _first_of_month(year.cast("int"), month)
    number = day.cast("long")
    inside = F.least(number, F.dayofmonth(F.last_day(first))).cast("int")
    return F.when(number.between(1, 31), F.date_add(first, inside - 1)).cast("timestamp")


def _iso_instant(fitting: Column) -> Column:
    """An upper-case text known to have the ISO shape."""
    year = F.regexp_extract(fitting, "^([+-]?[0-9]+)-", 1).cast("int")
    fitting = F.regexp_replace(fitting, "^[+-]?[0-9]+(?=-)", "0000")  # so that places are fixed

    def number(start: int, length: int = 2) -> Column:
        return F.substring(fitting, start, length).cast("int")

    hour, minute, second = number(12), number(15), number(18)
    fraction = F.regexp_extract(fitting, r"^.{19}\.?([0-9]*)", 1)
    zone = F.regexp_extract(fitting, "(Z|[+-][0-9:]+)$", 1)
    shift = F.when(zone != "Z", zone)
    away = (
        F.substring(shift, 2, 2).cast("int") * 3600
        + F.substring(shift, 5, 2).cast("int") * 60
        + F.when(F.length(shift) == 9, F.substring(shift, 8, 2).cast("int")).otherwise(0)
    )
    zone_fits = (
        F.substring(shift, 5, 2).between("00", "59")
        & ((F.length(shift) < 9) | F.substring(shift, 8, 2).between("00", "59"))
        & (away <= 18 * 3600)
    )
    clock_fits = (
        ((hour <= 23) & (minute <= 59) & (second <= 59))
        # The end of a day is the start of the next; a leap second is the one before.
        | ((hour == 24) & (minute == 0) & (second == 0) & fraction.rlike("^0*$"))
        | ((hour == 23) & (minute == 59) & (second == 60))
    )
    first = _first_of_month(year, number(6), _YEARS)
    day = number(9)
    day_fits = day.between(1, F.dayofmonth(F.last_day(first)))
    seconds = hour * 3600 + minute * 60 + F.least(second, F.lit(59))
    offset = F.coalesce(F.when(shift.startswith("-"), -away).otherwise(away), F.lit(0))
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("long")
    at = (
        F.unix_date(F.date_add(first, day - 1)).cast("long") * 86400 + seconds - offset
    ) * 1000000 + micros
    return F.when(day_fits & clock_fits & F.coalesce(zone_fits, F.lit(True)), F.timestamp_micros(at))


def time_stages(raw: str, run_ts: Column, out: str) -> Stages:
    """``out``: a raw time read as epoch milliseconds, epoch seconds, ISO instant,
    English date, or the first date-like run inside a longer text (short month names
    only), in that order; anything else is the time of the run.

    The shapes are separate stages, so each pattern is matched once per row.
    """
    text = F.col("_text")
    day = "0{0,17}[0-9]{1,2}"
    day_first = F.when(text.rlike(f"^{day} ({_ANY_MONTH}) [0-9]{{4}}$"), F.split(text, " "))
    month_first = F.when(text.rlike(f"^({_ANY_MONTH}) {day}, [0-9]{{4}}$"), F.split(text, ",? "))
    embedded = F.regexp_extract(text, r"([0-9]{1,2} [A-Za-z]{3,} [0-9]{4})", 1)
    return [
        {"_text": java_trim(F.col(raw))},
        {
            "_millis": F.when(text.rlike("^[0-9]{13}$"), text),
            "_seconds": F.when(text.rlike("^[0-9]{10}$"), text),
            "_iso": F.when(F.upper(text).rlike(_ISO), F.upper(text)),
            "_month_first": month_first,
            "_words": F.coalesce(day_first, F.split(F.nullif(embedded, F.lit("")), " ")),
        },
        {
            "_year": F.coalesce(F.get("_month_first", 2), F.get("_words", 2)),
            "_month": F.coalesce(F.get("_month_first", 0), F.get("_words", 1)),
            "_day": F.coalesce(F.get("_month_first", 1), F.get("_words", 0)),
            # A run inside a longer text counts only with a short month name.
            "_whole": F.col("_month_first").isNotNull()
            | (F.array_join("_words", " ") == text)
            | F.get("_words", 1).isin(_SHORT),
        },
        {"_month": F.when(F.col("_whole"), _month(F.col("_month")))},
        {
            out: F.coalesce(
                F.timestamp_millis(F.col("_millis").cast("long")),
                F.timestamp_seconds(F.col("_seconds").cast("long")),
                _iso_instant(F.col("_iso")),
                _midnight(F.col("_year"), F.col("_month"), F.col("_day")),
                run_ts,
            )
        },
    ]


def with_parsed_time(df: DataFrame, raw: str, run_ts: Column, out: str) -> DataFrame:
    """Add ``out``: the raw time read by ``time_stages``."""
    return apply(df, time_stages(raw, run_ts, out)).select(*df.columns, out)

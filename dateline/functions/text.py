"""Ids, hosts, URLs, cleaning and text forms of article fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
UNICODE_BLANKS = "".join(
    map(
        chr,
        (
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ),
    )
)
# The characters Java's String.trim() removes.
JAVA_BLANKS = "".join(chr(c) for c in range(0x21))

# Stored time text, batch name and file suffixes.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
BATCH_FORMAT = "yyyy'Y'MM'M'dd'D'_HH'h'mm'm'ss's'"
SUFFIXES = {"JSON": ".json", "JSONL": ".jsonl", "PARQUET": ".parquet"}


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends, as Python's ``strip``."""
    return F.btrim(text, F.lit(UNICODE_BLANKS))


def java_trim(text: Column) -> Column:
    """Remove characters up to U+0020 from both ends, as Java's ``trim``."""
    return F.btrim(text, F.lit(JAVA_BLANKS))


def clean_body(body: Column) -> Column:
    """Line feeds become blanks, then both ends are stripped."""
    return strip(F.translate(body, "\n", " "))


def has_body(body: Column) -> Column:
    """True for a body that is present and not blank; null counts as absent."""
    return F.coalesce(strip(body) != "", F.lit(False))


def article_id(url: Column) -> Column:
    """Hex SHA-256 of the article URL."""
    return F.sha2(url, 256)


def embedding_id(ident: Column, cleaned_body: Column) -> Column:
    """Hex SHA-256 of the article id, or of the cleaned body where it has none."""
    return F.sha2(F.coalesce(ident, cleaned_body), 256)


def host_of(url: Column) -> Column:
    """Host of a URL, ``unknown`` where there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("unknown"))


def domain_label(host: Column) -> Column:
    """Second-to-last dot label (``www.bbc.co.uk`` gives ``co``); null for one label."""
    return F.try_element_at(F.split(host, r"\."), F.lit(-2))


def robots_url(host: Column) -> Column:
    return F.concat(F.lit("https://"), host, F.lit("/robots.txt"))


def file_suffix(fmt: Column) -> Column:
    """File suffix of a format name; null for an unknown one."""
    suffix = F.lit(None).cast("string")
    for name, value in SUFFIXES.items():
        suffix = F.when(fmt == name, F.lit(value)).otherwise(suffix)
    return suffix


def time_text(ts: Column) -> Column:
    """UTC time as stored text (the session time zone must be UTC)."""
    return F.date_format(ts, TIME_FORMAT)


def batch_name(run_ts: Column, domain: Column, suffix: Column, per_site: bool = True) -> Column:
    """Name of one run's output; sites run together get their own name each."""
    parts = [F.lit("articles_"), F.date_format(run_ts, BATCH_FORMAT)]
    if per_site:
        parts += [F.lit("_"), domain]
    return F.concat(*parts, suffix)


def display_name(ident: Column, source: Column, title: Column) -> Column:
    return F.format_string("(%s) %s - %s", ident, source, title)

"""Levels, timestamps and JSON fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from timberline import constants as K
from timberline.functions.text import blank_to_null, lookup, squeeze

_CLOCK = (r"^\s*\d{4}-\d{1,2}-\d{1,2}(?:\s+\d{1,2}:\d{1,2}:\d{1,2}(?:[.,]\d{1,6})?"
          r"|T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?)Z?\s*$")
_SYSLOG = r"^\s*[A-Za-z]{3}\s+\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\s*$"
_ACCESS = r"^\s*\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2}\s+[+-]\d{4}\s*$"
_WINDOWS = r"(?i)^\s*\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{1,2}:\d{1,2}\s+[AP]M\s*$"
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"


def normalize_level(c: Column) -> Column:
    """Level word from a text log to one of the six levels."""
    return F.coalesce(lookup(F.lower(F.trim(c)), K.TEXT_LEVELS), F.lit("UNKNOWN"))


def _utc(instant: Column) -> Column:
    """An instant as a naive UTC timestamp, whatever the session zone."""
    zone = F.current_timezone()
    return F.convert_timezone(zone, F.lit("UTC"), instant.cast("timestamp_ntz"))


def _naive(text: Column, pattern: str) -> Column:
    """Parse in UTC and keep the wall clock."""
    return _utc(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(pattern + " Z")))


def parse_timestamp(c: Column, default_year: int = 1900) -> Column:
    """The text timestamp shapes; anything else is null, nothing is guessed.

    Year-less syslog stamps get ``default_year``; stamps with an offset become UTC.
    """
    clock = F.translate(c, "T,Z", " .")
    return (
        F.when(c.rlike(_CLOCK), squeeze(clock).try_cast("timestamp_ntz"))
        .when(c.rlike(_SYSLOG),
              _naive(F.concat(F.lit(f"{default_year} "), F.initcap(squeeze(c))),
                     "yyyy MMM d H:m:s"))
        .when(c.rlike(_ACCESS),
              _utc(F.try_to_timestamp(squeeze(c), F.lit("d/MMM/yyyy:H:m:s Z"))))
        .when(c.rlike(_WINDOWS), _naive(F.upper(squeeze(c)), "M/d/yyyy h:m:s a"))
    )


def json_map(c: Column) -> Column:
    """A JSON object as map of typed values; null when the text is not an object."""
    return F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")


def string_map(c: Column) -> Column:
    return F.from_json(c, "map<string,string>", {"allowSingleQuotes": "false"})


def first_key(fields: Column, names: list[str]) -> Column:
    """Value of the first name present, as text; a JSON null reads ``None``."""
    return F.coalesce(*[
        F.when(F.map_contains_key(fields, F.lit(n)), F.coalesce(fields[n], F.lit("None")))
        for n in names
    ])


def first_filled(fields: Column, names: list[str]) -> Column:
    """The first name with a non-empty value."""
    return F.coalesce(*[blank_to_null(fields[n]) for n in names])


def alias_key(fields: Column, names: list[str]) -> Column:
    """The actual key for an alias list: per alias exact first, then ignoring case."""
    keys = F.map_keys(fields)

    def any_case(name: str) -> Column:
        return F.try_element_at(F.filter(keys, lambda k: F.lower(k) == name), F.lit(1))

    return F.coalesce(*[
        F.coalesce(F.when(F.array_contains(keys, n), F.lit(n)), any_case(n)) for n in names
    ])


def json_level(value: Column) -> Column:
    """Numeric levels by range, words by the JSON level table."""
    text = value.cast("string")
    kind = F.schema_of_variant(value)
    number = text.try_cast("double")
    by_number = (
        F.when(number <= 20, F.lit("DEBUG")).when(number <= 30, F.lit("INFO"))
        .when(number <= 40, F.lit("WARNING")).when(number <= 50, F.lit("ERROR"))
        .otherwise(F.lit("CRITICAL"))
    )
    by_word = F.coalesce(lookup(F.lower(F.trim(text)), K.JSON_LEVELS), F.lit("UNKNOWN"))
    return F.when(kind == "BIGINT", by_number).otherwise(by_word)


def json_timestamp(value: Column) -> Column:
    """Epoch seconds or milliseconds as numbers, ISO shapes as text, else null."""
    text = value.cast("string")
    kind = F.schema_of_variant(value)
    number = text.try_cast("double")
    micros = F.when(number > 1e12, number * 1e3).otherwise(number * 1e6)
    epoch = _utc(F.timestamp_micros(F.round(micros).cast("bigint")))
    is_number = (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")
    plain = F.regexp_replace(F.regexp_replace(text, "Z$", ""), r"\+00:00", "")
    iso = F.when(plain.rlike(_ISO_DATE),
                 F.regexp_replace(plain, "T", " ").try_cast("timestamp_ntz"))
    return F.when(is_number, epoch).when(kind == "STRING", F.coalesce(iso, parse_iso_loose(text)))


def parse_iso_loose(text: Column) -> Column:
    """ISO date-times whose parts are not zero padded."""
    plain = F.regexp_replace(text, "Z$", "")
    shape = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?$"
    return F.when(plain.rlike(shape), F.regexp_replace(plain, "T", " ").try_cast("timestamp_ntz"))

"""Scalar checks and normalisations of identifiers, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit(value: Column, at: int) -> Column:
    return F.substring(value, at, 1).cast("int")


def afm_valid(value: Column) -> Column:
    """Nine digits of which the last is the weighted sum of the others, mod 11 and mod 10."""
    total = sum((digit(value, i + 1) * (1 << (8 - i)) for i in range(8)), F.lit(0))
    return value.rlike(r"^[0-9]{9}$") & (total % 11 % 10 == digit(value, 9))


def amka_valid(value: Column, as_of_year: Column | int | None = None) -> Column:
    """Eleven digits that begin with a date of birth, DDMMYY, not later than the year given."""
    year = F.year(F.current_date()) if as_of_year is None else F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    yy = F.substring(value, 5, 2).cast("int")
    full = F.when(yy <= year % 100, F.lit(2000) + yy).otherwise(F.lit(1900) + yy)
    date = F.try_to_date(F.concat(F.substring(value, 1, 4), full.cast("string")), "ddMMyyyy")
    return value.rlike(r"^[0-9]{11}$") & date.isNotNull() & (full <= year)


def iban_valid(value: Column) -> Column:
    """Mod-97 of the rearranged number is 1."""
    plain = F.upper(F.regexp_replace(value, r"[\s\-]", ""))
    moved = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))
    digits = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    rest = F.aggregate(F.filter(F.split(F.array_join(digits, ""), ""), lambda c: c != ""), F.lit(0), lambda r, c: (r * 10 + c.cast("int")) % 97)
    return plain.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (rest == 1)


def header_key(value: Column) -> Column:
    """Case-folded header with white space squeezed; a final sigma folds to sigma."""
    return F.replace(F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))), F.lit("ς"), F.lit("σ"))


def greek_phone(value: Column) -> Column:
    """Ten national digits of a Greek number, else null."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    local = F.when(digits.startswith("0030"), F.substring(digits, 5, 99)).when(digits.startswith("30") & (F.length(digits) == 12), F.substring(digits, 3, 99)).otherwise(digits)
    return F.when(local.rlike(r"^(2[0-9]|69)[0-9]{8}$"), local)


_DATED = r"^(.*?)[/\-][0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{4}$"
_YEAR = r"^(.*?\S)\s*/\s*(?:19|20)[0-9]{2}$"


def _without_date(value: Column) -> Column:
    """value without its trailing date; null if it has none or is nothing else."""
    head = F.regexp_extract(F.trim(value), _DATED, 1)
    return F.when(F.trim(value).rlike(_DATED) & (F.regexp_replace(head, r"[/\\\-]", "") != ""), head)


def _without_year(value: Column) -> Column:
    return F.when(F.trim(value).rlike(_YEAR), F.regexp_extract(F.trim(value), _YEAR, 1))


def serial_of(value: Column) -> Column:
    """A reference without its trailing date, or else without its trailing year."""
    return F.coalesce(_without_date(value), _without_year(value), value)


def serial_without_date_and_year(value: Column) -> Column:
    """A reference without its trailing date, and then without a year before that."""
    serial = F.coalesce(_without_date(value), value)
    return F.coalesce(_without_year(serial), serial)

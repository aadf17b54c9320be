"""What counts as a value: missing numbers, identifiers written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number at or below this is a no-data mark of a raster, not a measurement.
NO_DATA = -1e30


def is_present(c: Column | str) -> Column:
    """Whether a number is neither null nor NaN nor a no-data mark; as a filter it reaches the scan."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (c > NO_DATA)


def present(c: Column | str) -> Column:
    """The number, or NULL where it is null, NaN or a no-data mark."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(is_present(c), c)


def as_number(c: Column | str) -> Column:
    """An identifier written with blanks, zeros in front or a decimal part as a long; NULL if it is no number."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(F.regexp_replace(c, r"[\s ]+", ""), r"^\+?([0-9]{1,18})(?:\.0*)?$", 1)
    return F.when(digits != "", digits.try_cast("long"))

"""Reusable column expressions; all of them are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: where a text is cut into words. '!' and '.' count as blanks, next to the characters on which
# Python's str.split() breaks: Unicode white space, which (?U)\s stands for, and four separators.
WORD_BREAKS = r"(?U)[!.\x1c-\x1f\s]+"


def rounded(value: Column, digits: int = 2) -> Column:
    """Half-up rounding that does not depend on the last bits of a floating point sum.

    The value passes through decimal(30,8) first; numbers outside that range (and NaN or infinity) are
    rounded as doubles.
    """
    exact = F.round(value.try_cast("decimal(30,8)"), digits).cast("double")
    return F.coalesce(exact, F.round(value.cast("double"), digits))


def clean_double(value: Column) -> Column:
    """The value as double, with NaN turned into null so that both count as missing."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def is_missing(value: Column, type_name: str) -> Column:
    """Null test that also counts NaN in floating point columns."""
    if type_name in ("float", "double"):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def map_values(value: Column, mapping: Mapping) -> Column:
    """Replace each listed value; a value without an entry becomes null.

    Meant for short mappings written in code. Join with a mapping table for anything that grows.
    """
    result = None
    for old, new in mapping.items():
        result = F.when(value == F.lit(old), F.lit(new)) if result is None else result.when(
            value == F.lit(old), F.lit(new)
        )
    if result is None:
        raise ValueError("mapping is empty")
    return result


def token_array(cell: Column, sep: str = ",", keep_blank: bool = False) -> Column:
    """Split a delimited cell into an array of tokens without surrounding blanks."""
    tokens = F.split(F.trim(cell), rf" *\Q{sep}\E *")
    return tokens if keep_blank else F.array_remove(tokens, "")


def word_array(text: Column) -> Column:
    """Lower-case words of a text, cut at white space, '!' and '.'; may start or end with an empty one."""
    return F.split(F.lower(text), WORD_BREAKS)

"""Typing and cleaning of all-string tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import decade_of


@dataclass(frozen=True)
class ColumnSpec:
    """One output column: where it comes from, its new name and how it is typed.

    kind is one of date, text (trimmed), raw (unchanged), double, int.
    """

    source: str
    name: str
    kind: str


def whole_number(cell: Column) -> Column:
    """The int a cell stands for, null where its number has a fraction or is no int."""
    number = cell.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def typed_column(spec: ColumnSpec, strict: bool = False) -> Column:
    """Typing expression of one column.

    Malformed cells become null, and "3.0" counts as the int 3 ("3.7" is malformed). With strict=True the plain casts are used,
    which raise on such cells under ANSI mode.
    """
    cell = F.col(f"`{spec.source}`")
    if spec.kind == "date":
        typed = F.to_date(cell) if strict else F.try_to_date(cell)
    elif spec.kind == "text":
        typed = F.trim(cell)
    elif spec.kind == "raw":
        typed = cell
    elif spec.kind == "double":
        typed = cell.cast("double") if strict else cell.try_cast("double")
    elif spec.kind == "int":
        typed = cell.cast("int") if strict else whole_number(cell)
    else:
        raise ValueError(f"unknown kind {spec.kind!r} for column {spec.name!r}")
    return typed.alias(spec.name)


def standardize(df: DataFrame, specs: Iterable[ColumnSpec], strict: bool = False) -> DataFrame:
    """Project the raw table to its typed columns."""
    return df.select(*[typed_column(spec, strict) for spec in specs])


def clean(
    df: DataFrame,
    required: Sequence[str],
    blank_as_null: bool = False,
    text_columns: Sequence[str] = (),
) -> DataFrame:
    """Drop rows with a null in a required column.

    Blank text survives by default, although the missing-value report counts it; blank_as_null=True drops
    rows whose listed text columns are blank as well.
    """
    kept = df.dropna(subset=list(required))
    if blank_as_null:
        for name in text_columns:
            kept = kept.where(F.trim(F.col(name)) != "")
    return kept


def with_year_and_decade(
    df: DataFrame, date: str, year: str = "release_year", decade: str = "decade"
) -> DataFrame:
    return df.withColumn(year, F.year(date)).withColumn(decade, decade_of(F.col(year)))

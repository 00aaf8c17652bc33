"""Column expressions shared by the operators."""

from tabulon.functions.columns import (
    clean_double,
    decade_of,
    is_missing,
    map_values,
    rounded,
    token_array,
    word_array,
)

__all__ = [
    "clean_double",
    "decade_of",
    "is_missing",
    "map_values",
    "rounded",
    "token_array",
    "word_array",
]

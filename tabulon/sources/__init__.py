"""Reading and writing of tables."""

from tabulon.sources.delimited import (
    literal_table,
    read_delimited,
    read_many,
    write_delimited,
    write_report,
)
from tabulon.sources.records import raw_records, read_records
from tabulon.sources.shared import materialize, register_views, release, shared_folder, table_scope

__all__ = [
    "literal_table",
    "materialize",
    "raw_records",
    "read_delimited",
    "read_many",
    "read_records",
    "register_views",
    "release",
    "shared_folder",
    "table_scope",
    "write_delimited",
    "write_report",
]

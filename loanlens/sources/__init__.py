"""Sources and sinks: CSV reader, fixture tables, catalog inspection, table writes."""

from .catalog import preview, profile, schema_listing
from .csv import read_table, read_tables
from .fixtures import load_fixture_tables
from .schemas import SCHEMAS, TABLE_FILES, TABLES
from .sinks import buckets_for, checkpoint_dir, save, scratch_path

__all__ = [
    "preview", "profile", "schema_listing", "read_table", "read_tables", "load_fixture_tables",
    "SCHEMAS", "TABLE_FILES", "TABLES", "buckets_for", "checkpoint_dir", "save", "scratch_path",
]

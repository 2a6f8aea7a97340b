"""Tables in and results out."""

from tidemark.sources.catalog import TableCatalog
from tidemark.sources.delimited import parse_lines, parse_schema, read_folder, read_table
from tidemark.sources.sinks import pipe_lines, write_parquet, write_pipe, write_sqlite

__all__ = ["TableCatalog", "parse_lines", "parse_schema", "pipe_lines", "read_folder", "read_table", "write_parquet", "write_pipe", "write_sqlite"]

"""Reading and writing tables."""

from lexmesh.sources.tables import all_words, read_table, write_table

__all__ = ["all_words", "read_table", "write_table"]

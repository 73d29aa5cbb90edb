"""The functions in Structured Streaming."""

from lexmesh.streaming.linkage import code_counts, first_records, match_stream

__all__ = ["code_counts", "first_records", "match_stream"]

"""Sources and sinks."""

from .tables import finite, latest_labels, load_table, nan_to_null, publish, read_features, read_json_document, read_jsonl, read_many, scratch, stored, write_features, write_json_document, write_jsonl, write_table

__all__ = ["finite", "latest_labels", "load_table", "nan_to_null", "publish", "read_features", "read_json_document", "read_jsonl", "read_many", "scratch", "stored", "write_features", "write_json_document", "write_jsonl", "write_table"]

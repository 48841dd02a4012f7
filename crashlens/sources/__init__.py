"""Sources and sinks: loaders, writers, schemas and sample views."""

from crashlens.sources.io import (Checked, all_rejected, apply_types, csv_headers, load_checked, load_table,
                                  load_tables, load_tables_checked, preview, result_path, row_count, scan_csv,
                                  write_result)

__all__ = ["Checked", "all_rejected", "apply_types", "csv_headers", "load_checked", "load_table", "load_tables",
           "load_tables_checked", "preview", "result_path", "row_count", "scan_csv", "write_result"]

"""Tables in and out: Parquet by name, JDBC and CSV."""

from tallyspark.sources.tables import add_source, csv_sink, jdbc_table, json_rows, table, upsert

__all__ = ["add_source", "csv_sink", "jdbc_table", "json_rows", "table", "upsert"]

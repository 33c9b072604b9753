from hookflow.sources.csv_batch import csv_batch_stats, csv_chunks, ingest_csv
from hookflow.sources.external import read_external_events

__all__ = ["csv_batch_stats", "csv_chunks", "ingest_csv", "read_external_events"]

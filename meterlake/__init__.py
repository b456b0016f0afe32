"""Telemetry analytics on PySpark: ingest, privacy, canonical vocabulary, accounting, time series, traces, sessions."""

"""Operators for preparing training text: dedup, decontamination, scans,
scoring, encoding and sharding. Nothing else in the library imports this."""

"""Referential archiving for Spark: closure, copy, verification, purge and resume over versioned Parquet tables."""

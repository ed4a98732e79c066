"""Replayable, correctness-first ingestion of change logs on Spark."""

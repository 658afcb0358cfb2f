"""Surge detection and attribution over annotated, time-stamped corpora, planned by Spark."""

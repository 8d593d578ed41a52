"""Governance analytics over text corpora and activity traces, as Spark jobs."""

"""Batches of client events to daily aggregates, cohorts and reports, as Spark jobs."""

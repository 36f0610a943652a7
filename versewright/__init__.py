"""Timed-text analytics and corpus preparation as Spark jobs."""

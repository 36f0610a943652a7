"""All registered queries of the timed-text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compare_queries, edit_queries, editor_queries, format_queries, group_queries, job_queries, line_queries, linked_queries, match_queries, project_queries, repair_queries, result_queries, shape_queries, solver_queries, song_queries, stat_queries, stateful_queries, store_queries, stream_queries, text_queries, timing_queries, track_queries

MODULES = (timing_queries, text_queries, compare_queries, stat_queries, edit_queries, stream_queries, line_queries, group_queries, shape_queries, repair_queries, editor_queries, format_queries, match_queries, job_queries, solver_queries, linked_queries, stateful_queries, song_queries, track_queries, project_queries, result_queries, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

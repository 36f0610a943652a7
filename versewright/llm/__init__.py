"""Operators for large training-corpus pipelines.

Nothing outside this subpackage imports it.  Every operator takes and
returns DataFrames; the registered queries live in :mod:`.queries`.
"""

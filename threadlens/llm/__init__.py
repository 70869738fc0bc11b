"""Operators of a training-data pipeline: captures, fingerprints, scans,
deduplication, decontamination, tokenisation and language identification.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames, works on whole texts and all rows, and treats a null text
as an empty one. ``registry`` holds the queries and their DuckDB SQL.
"""

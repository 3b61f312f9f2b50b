"""Operators on DataFrames: recognition, arbitration, mapping, redaction, restoring, evaluation, review."""

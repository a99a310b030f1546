"""Operators of a training-data pipeline, one module each.

Every operator takes DataFrames and returns a DataFrame; nothing outside this folder
imports it. ``queries.py`` registers the operators over the benchmark tables.
"""

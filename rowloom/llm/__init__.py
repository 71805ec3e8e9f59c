"""Training-data operators: ten corpus components and their registered queries.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
plus column names, ignores all other columns, and documents its handling of
nulls, empty and very long texts, repeated rows and empty tables.
"""

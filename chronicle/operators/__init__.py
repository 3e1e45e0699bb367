"""Operators on canonical tables, as functions of DataFrames."""

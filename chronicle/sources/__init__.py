"""Readers: raw tables or files to canonical events, as functions of DataFrames."""

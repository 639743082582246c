"""Operators for building training corpora: each takes and returns DataFrames."""

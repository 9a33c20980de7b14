"""Operators of postglean; each takes and returns DataFrames."""

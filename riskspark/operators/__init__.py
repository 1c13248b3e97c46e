"""Operators over series, blocks, paths, chains and forecasts; each takes and returns DataFrames."""

"""Readers: driver tables as return series, price panels, volatility levels, option chains and scenario paths."""

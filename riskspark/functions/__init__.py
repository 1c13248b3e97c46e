"""Column functions: normal and chi-square tails, rolling windows, drawdowns, option prices, test statistics."""

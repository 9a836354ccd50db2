"""Reusable DataFrame operators: null tools, joins, running sums, quantiles, splits."""

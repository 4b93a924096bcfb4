"""Operators for preparing training text: rules, filters, joins, mixing, packing, scoring."""

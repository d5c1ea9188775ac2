"""Filters, statistics, search, index maintenance and message identity over DataFrames."""

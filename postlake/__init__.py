"""Mail archives as DataFrames: sources, listing filters, statistics, full-text search and sinks."""

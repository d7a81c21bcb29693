"""Writers of results, logs, reports and tables."""

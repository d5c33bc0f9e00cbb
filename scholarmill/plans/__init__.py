"""Sessions, stage tables and the query catalogue."""

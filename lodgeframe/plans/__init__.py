"""Ready-made reports, their display shapes, and the query catalogue."""

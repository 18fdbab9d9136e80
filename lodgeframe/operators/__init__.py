"""Operators over a bookings DataFrame: cleaning, profiling, search, aggregation, upsert."""

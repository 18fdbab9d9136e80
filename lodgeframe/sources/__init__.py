"""Readers and writers: CSV uploads, bookings tables, documents, JSON hits."""

"""Bookings analytics expressed as lazy Spark DataFrame operators."""

"""Recurring uploads as Structured Streaming."""

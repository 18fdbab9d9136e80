"""Column expressions shared by operators and reports."""

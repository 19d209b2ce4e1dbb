"""Operators that prepare training data: ten operators, their queries and SQL."""

"""Operators for preparing training data: ten corpus operators, their queries and their SQL."""

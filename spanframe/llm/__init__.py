"""Operators that prepare training text from the library's records."""

"""Operators that prepare training data; nothing outside of this subpackage imports it."""

"""Operators that prepare training data at large scale. Nothing outside this subpackage imports it."""

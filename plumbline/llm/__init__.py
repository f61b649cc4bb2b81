"""Operators for training-corpus preparation. Nothing outside this subpackage imports it."""

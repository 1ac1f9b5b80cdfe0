"""Operators for training-text corpora. Nothing outside this subpackage imports it."""

"""Operators on text corpora and their queries. Nothing outside this subpackage imports it."""

"""Operators for large text corpora and their vectors; nothing else in the library imports this subpackage."""

"""Operators on text corpora and learned matching.  Nothing outside this subpackage imports it."""

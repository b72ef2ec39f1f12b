"""Operators on large text collections. Nothing outside this subpackage imports it."""

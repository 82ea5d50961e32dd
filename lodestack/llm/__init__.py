"""Operators over training corpora. Nothing outside this subpackage imports it."""

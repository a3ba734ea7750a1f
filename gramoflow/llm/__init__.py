"""Operators for text and language-model data; nothing outside this subpackage imports it."""

"""Readers, guards and writers."""

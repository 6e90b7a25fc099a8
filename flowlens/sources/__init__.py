"""Readers, schema checks and writers."""

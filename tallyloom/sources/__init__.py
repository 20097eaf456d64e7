"""Readers and writers of assessment data."""

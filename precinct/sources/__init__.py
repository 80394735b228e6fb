"""Readers, writers and the incident views over the test tables."""

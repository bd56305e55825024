"""Readers and writers of the study tables."""

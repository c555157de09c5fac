"""Readers and writers of timed text."""

"""Operators of a training-data pipeline over transcripts, edited texts and documents."""

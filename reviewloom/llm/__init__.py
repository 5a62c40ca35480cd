"""Operators of a training-data pipeline: deduplication, filters, scoring, packing and audits of text corpora."""

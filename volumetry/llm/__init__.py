"""Corpus operators: from raw pages and documents to token matrices."""

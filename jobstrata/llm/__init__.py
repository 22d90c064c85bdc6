"""Corpus operators over the description texts of job postings: filters, duplicates, mixing, token files."""
